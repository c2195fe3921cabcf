"""What the dialect answers where engines differ: bounds, literals, labels, aliases, atomic statements, keys that are null."""

import pytest

import tessera


@pytest.fixture
def db(spark, tmp_path):
    with tessera.open(f"file://{tmp_path}/db", spark) as db:
        db.execute("CREATE TABLE t (id INT PRIMARY KEY, age INT, name TEXT UNIQUE)")
        db.execute("INSERT INTO t VALUES (1, 30, 'a'), (2, 25, 'b'), (5, 40, 'c'), (8, -3, NULL), (9, NULL, NULL)")
        db.execute("CREATE TABLE u (id INT, age INT)")
        db.execute("INSERT INTO u VALUES (1, 7), (NULL, 8), (5, NULL)")
        yield db


@pytest.mark.parametrize(("where", "ids"), [
    ("id < 5", [1, 2]), ("id <= 5", [1, 2, 5]), ("5 > id", [1, 2]), ("5 <= id", [5, 8, 9]), ("id = 5 AND id >= 2", [5]), ("id = 5 AND id >= 6", []),
    ("id > 1 AND id >= 5 AND 9 > id", [5, 8]), ("age = -3", [8]), ("age < -2", [8]), ("-age > 2", [8]),
])
def test_bounds(db, where, ids):
    """The same with and without an index."""
    found = lambda: sorted(r[0] for r in db.execute(f"SELECT id FROM t WHERE {where}"))
    assert found() == ids
    db.create_index("by_age", "t", ["age"])
    assert found() == ids


def test_order_of_an_aggregates_columns(db):
    assert db.execute("SELECT COUNT(*), name FROM t GROUP BY name ORDER BY name") == [(1, "a"), (1, "b"), (1, "c")]
    assert db.result_columns_for("SELECT MAX(age), COUNT(*), name FROM t GROUP BY name") == ["MAX(age)", "COUNT(*)", "name"]
    for text in ("SELECT age, COUNT(*) FROM t", "SELECT age, COUNT(*) FROM t GROUP BY name", "SELECT SUM(*) FROM t", "SELECT * FROM t GROUP BY name"):
        with pytest.raises(tessera.EngineError):
            db.sql(text)
    with pytest.raises(tessera.TypeMismatchError):
        db.sql("SELECT SUM(name) FROM t")


def test_equal_names_stay_apart(db):
    columns, rows = db.execute_with_columns("SELECT a.age, b.age FROM t a JOIN u b ON a.id = b.id ORDER BY a.id")
    assert len(columns) == 2 and columns[0] == "age" and columns[1] != "age"
    assert rows == [(30, 7), (40, None)]


def test_order_by_honours_the_alias(db):
    text = "SELECT a.id FROM t a JOIN u b ON a.id = b.id ORDER BY {}"
    assert db.execute(text.format("a.age DESC")) == [(5,), (1,)]
    assert db.execute(text.format("b.age")) == [(1,), (5,)]
    assert db.execute(text.format("b.age DESC")) == [(5,), (1,)]


@pytest.mark.parametrize("text", [
    "INSERT INTO t VALUES (20, 1, 'x'), (20, 2, 'y')", "INSERT INTO t VALUES (21, 1, 'x'), (1, 2, 'y')", "INSERT INTO t VALUES (22, 1, 'a')",
    "UPDATE t SET id = 1 WHERE id = 2", "UPDATE t SET name = 'a' WHERE id > 1", "UPDATE t SET age = 'word'",
])
def test_a_failed_statement_leaves_everything(db, text):
    before = sorted(db.execute("SELECT id, age FROM t"), key=str)
    with pytest.raises(tessera.EngineError):
        db.execute(text)
    assert sorted(db.execute("SELECT id, age FROM t"), key=str) == before


def test_a_key_that_is_null_repeats(db):
    db.execute("INSERT INTO t VALUES (NULL, 1, NULL), (NULL, 2, NULL)")
    assert db.execute("SELECT COUNT(*), COUNT(id) FROM t") == [(7, 5)]


def test_null_join_keys(db, spark):
    db.execute("INSERT INTO t VALUES (NULL, 1, NULL)")
    text = "SELECT t.age, u.age FROM t JOIN u ON t.id = u.id"
    assert sorted(db.execute(text), key=str) == [(30, 7), (40, None)]
    with tessera.open(db.store.path, spark, null_safe_on=True) as safe:
        assert sorted(safe.execute(text), key=str) == [(1, 8), (30, 7), (40, None)]


def test_a_using_column_is_one(db):
    assert sorted(db.execute("SELECT id FROM t JOIN u USING (id)")) == [(1,), (5,)]
    assert db.result_columns_for("SELECT * FROM t JOIN u USING (id)") == ["id", "age", "name"]


@pytest.mark.parametrize(("text", "kind"), [
    ("SELECT t.id FROM t JOIN u ON t.id = u.nope", tessera.UnknownColumnError), ("SELECT id FROM t WHERE NOT nope", tessera.UnknownColumnError), ("SELECT id FROM t WHERE -nope > 1", tessera.UnknownColumnError),
    ("SELECT zzz.id FROM t", tessera.UnknownAliasError), ("SELECT id FROM t ORDER BY zzz.id", tessera.UnknownAliasError), ("DROP TABLE missing", tessera.UnknownTableError),
])
def test_everything_is_checked_before_it_runs(db, text, kind):
    with pytest.raises(kind):
        db.execute(text)


def test_parameters_of_every_kind(db):
    import datetime as dt
    import decimal

    db.execute("CREATE TABLE v (d DATE, n DECIMAL(10,2), b BLOB, w DATETIME)")
    row = (dt.date(2024, 2, 29), decimal.Decimal("1.50"), b"\x00\xff", dt.datetime(2024, 2, 29, 1, 2, 3))
    db.execute("INSERT INTO v VALUES (?, ?, ?, ?)", row)
    assert db.execute("SELECT * FROM v") == [row]
    assert db.execute("SELECT n FROM v WHERE d = ? AND b = ?", row[::2]) == [row[1:2]]
