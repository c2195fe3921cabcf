"""Several handles on one database: lost races, vacuum, isolation, compaction, sorted files, the stream, the prompt."""

import threading

import pytest
from pyspark.sql import functions as F

import tessera
from tessera import cli
from tessera.operators import dml
from tessera.sources.store import Manifest
from tessera.streaming.sink import append_stream


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/db"


@pytest.fixture
def db(spark, path):
    with tessera.open(path, spark) as db:
        db.execute("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
        db.execute("INSERT INTO t VALUES (1, 10)")
        yield db


def directories(db):
    return {f"t/{s.getPath().getName()}" for s in db.store.fs.listStatus(db.store._path("t"))}


def test_one_of_two_commits_from_a_base_fails(db, spark, path):
    other = tessera.open(path, spark)
    db.begin()
    db.execute("INSERT INTO t VALUES (2, 20)")
    other.execute("INSERT INTO t VALUES (3, 30)")
    with pytest.raises(tessera.EngineError):
        db.commit()
    assert sorted(r[0] for r in db.execute("SELECT id FROM t")) == [1, 3]
    assert directories(db) == set(db.store.current().tables["t"].files)  # the loser has left nothing


def test_a_manifest_number_is_given_once(db):
    base = db.store.current()
    db.store.commit(base.copy(), base.version)
    with pytest.raises(tessera.EngineError):
        db.store.commit(base.copy(), base.version)
    assert db.store.current().version == base.version + 1
    assert not [s for s in db.store.fs.listStatus(db.store._path("")) if s.getPath().getName().startswith(".manifest")]


def test_a_damaged_manifest_is_not_skipped(db):
    version = db.store.current().version + 1
    stream = db.store.fs.create(db.store._path(f"manifest-{version}.json"), False)
    stream.write(bytearray(b'{"version": '))
    stream.close()
    with pytest.raises(tessera.EngineError, match="damaged"):
        db.execute("SELECT id FROM t")


def test_concurrent_writers_lose_nothing(db, spark, path):
    done, lost = [], []

    def work(k):
        handle = tessera.open(path, spark)
        for i in range(3):
            try:
                handle.execute(f"INSERT INTO t VALUES ({100 * k + i}, 0)")
                done.append(100 * k + i)
            except tessera.EngineError:
                lost.append(100 * k + i)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(1, 4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(done) + len(lost) == 9 and done
    assert sorted(r[0] for r in db.execute("SELECT id FROM t")) == sorted([1, *done])


def test_vacuum_spares_open_transactions_and_recent_snapshots(db, spark, path):
    other = tessera.open(path, spark)
    before = other.sql("SELECT id FROM t")
    db.begin()
    db.execute("INSERT INTO t VALUES (2, 20)")
    other.execute("CREATE TABLE u (a INT)") and other.vacuum()
    assert other.vacuum() == []
    db.rollback()
    db.execute("DELETE FROM t")
    assert other.vacuum() == [] and [r.id for r in before.collect()] == [1]
    assert other.vacuum(older_than=0) and directories(db) == set()


def test_a_commit_notices_that_its_rows_are_gone(db):
    new = db.store.current()
    new.tables["t"].files.append("t/gone")
    with pytest.raises(tessera.EngineError, match="gone"):
        db.store.commit(new, new.version)


@pytest.mark.parametrize(("level", "sees"), [(tessera.IsolationLevel.READ_COMMITTED, 2), (tessera.IsolationLevel.SERIALIZABLE, 1)])
def test_isolation(db, spark, path, level, sees):
    reader = tessera.open(path, spark, isolation=level)
    with reader.transaction():
        assert reader.execute("SELECT COUNT(*) FROM t") == [(1,)]
        db.execute("INSERT INTO t VALUES (2, 20)")
        assert reader.execute("SELECT COUNT(*) FROM t") == [(sees,)]
        if level is tessera.IsolationLevel.READ_COMMITTED:  # its first write is based on what it sees, and pins it
            reader.execute("INSERT INTO t VALUES (3, 30)")
            assert reader.execute("SELECT COUNT(*) FROM t") == [(3,)]
    assert db.execute("SELECT COUNT(*) FROM t") == [(3 if sees == 2 else 2,)]


def test_connections(db):
    with db.connection() as one, db.connection() as two:
        one.execute("INSERT INTO t VALUES (5, 0)")
        assert two.execute("SELECT COUNT(*) FROM t") == [(2,)]
        with one.transaction():
            one.execute("DELETE FROM t")
            assert two.execute("SELECT COUNT(*) FROM t") == [(2,)]
    assert db.execute("SELECT COUNT(*) FROM t") == [(0,)]


def test_append_checks_the_batch_and_the_old_rows(db, spark):
    rows = lambda *ids: spark.createDataFrame([(i, 0) for i in ids], "id long, v long")
    for bad in (rows(7, 7), rows(1, 8)):
        with pytest.raises(tessera.ConstraintViolation):
            db.append("t", bad)
    with pytest.raises(tessera.NotNullViolation):
        db.execute("CREATE TABLE n (a INT NOT NULL)")
        db.append("n", spark.createDataFrame([(None,)], "a long"))
    db.append("t", rows(8, 9))
    assert sorted(r[0] for r in db.execute("SELECT id FROM t")) == [1, 8, 9]


def test_bounds_of_keys_hide_no_clash(db, spark, monkeypatch):
    """Directories whose keys lie elsewhere are not read; every other clash is found, after merging and rewriting too."""
    monkeypatch.setattr(dml, "MERGED", 4)
    db.execute("CREATE TABLE k (a INT, b TEXT UNIQUE, c INT)")
    db.create_index("pair", "k", ["a", "c"], unique=True)
    long = "z" * 100
    for row in ("1, 'm', 1", f"5, '{long}', 1", "NULL, NULL, 1", "9, 'a', NULL", "7, 'q', 2"):
        db.execute(f"INSERT INTO k VALUES ({row})")
    for merged in (False, True, True):
        if merged:
            db.compact("k")
        for row in ("1, 'x', 1", "6, 'm', 1", f"6, '{long}', 1", "7, 'y', 2", "20, 'a', 20", "7, 'q', 9"):
            with pytest.raises(tessera.ConstraintViolation):
                db.execute(f"INSERT INTO k VALUES ({row})")
        db.execute(f"INSERT INTO k VALUES ({30 + merged}, NULL, 1), (NULL, NULL, 1)") if not merged else None
    db.execute("UPDATE k SET a = a + 100, b = b + '!'")
    db.execute("INSERT INTO k VALUES (1, 'm', 1)")
    for row in ("101, 'x', 1", "0, 'm!', 0", "1, 'new', 1"):
        with pytest.raises(tessera.ConstraintViolation):
            db.execute(f"INSERT INTO k VALUES ({row})")


def test_compaction_merges_only_like_sizes(db, spark, monkeypatch):
    monkeypatch.setattr(dml, "MERGED", 4)
    monkeypatch.setattr(dml, "LEAST_BYTES", 5_000)
    db.append("t", spark.range(1000, 60_000).select(F.col("id"), F.rand(1).alias("v") * 0 + F.col("id")))
    large = db.store.current().tables["t"].files[-1]
    for i in range(2, 12):
        db.execute(f"INSERT INTO t VALUES ({i}, 0)")
    files = db.store.current().tables["t"].files
    assert large in files and len(files) < 9
    assert db.execute("SELECT COUNT(*) FROM t") == [(59_011,)]


def scanned(df):
    df.collect()
    stack, rows = [df._jdf.queryExecution().executedPlan()], []
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if "Scan" in node.nodeName():
            rows.append(node.metrics().get("numOutputRows").get().value())
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return sum(rows)


def test_an_index_skips_files(spark, tmp_path):
    db = tessera.open(f"file://{tmp_path}/x", spark)
    db.execute("CREATE TABLE o (k INT, v INT)")
    db.append("o", spark.range(40_000).select((F.col("id") * 7919 % 40_000).alias("k"), F.col("id").alias("v")))
    probe = "SELECT v FROM o WHERE k >= 100 AND k < 120"
    plan = db.explain(probe)
    assert "PushedFilters: [IsNotNull(k)" in plan or "GreaterThanOrEqual(k,100)" in plan
    before = scanned(db.sql(probe))
    db.execute("CREATE INDEX by_k ON o (k)")
    assert scanned(db.sql(probe)) <= before / 2 and len(db.execute(probe)) == 20


def test_equi_part_of_a_mixed_condition_stays_a_key(spark, db):
    db.execute("CREATE TABLE u (id INT, w INT)")
    plan = db.explain("SELECT t.id FROM t JOIN u ON t.id = u.id AND t.v < u.w")
    assert "NestedLoop" not in plan and "Join" in plan


def test_names_under_aliases(db):
    for text, kind in (("SELECT t.id FROM t AS a", tessera.BareTableNameError), ("SELECT id FROM t AS a JOIN u AS b ON a.id = b.id", tessera.AmbiguousColumnError)):
        with pytest.raises(kind):
            db.execute("CREATE TABLE u (id INT)") if "JOIN" in text else None
            db.sql(text)


def test_index_and_table_statements(db):
    db.create_index("pair", "t", ["id", "v"], unique=True)
    with pytest.raises(ValueError):
        db.create_index("pair", "t", ["v"])
    db.drop_index("pair")
    with pytest.raises(ValueError):
        db.drop_index("pair")
    db.execute("DROP TABLE t")
    with pytest.raises(tessera.UnknownTableError):
        db.execute("DROP TABLE t")


def test_callers_session_is_left_alone(db, spark):
    assert spark.conf.get("spark.sql.caseSensitive") == "false" and db.spark.conf.get("spark.sql.caseSensitive") == "true"


def test_stream_counts_no_batch_twice(db, spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.range(50, 80).select("id", F.lit(1).cast("long").alias("v")).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("id long, v long").parquet(source)
        append_stream(db, "t", stream, f"file://{tmp_path}/mark", availableNow=True).awaitTermination()
        assert db.execute("SELECT COUNT(*) FROM t") == [(31,)]


def test_prompt(db, path, capsys):
    assert cli.shown(db, "SELECT id, v FROM t").splitlines()[-1] == "(1 row)"
    assert "|  1 | 10 |" in cli.shown(db, "SELECT id, v FROM t") and cli.shown(db, "DELETE FROM t WHERE id = 99") == "0 row(s)"
    assert cli.shown(db, "SELECT id FROM t WHERE id > 5").endswith("(no rows)")
    assert cli.shown(db, "SELECT id, v FROM t", "line") == "id = 1\nv = 10\n\n(1 row)" and cli.shown(db, "SELECT id, v FROM t", "plain") == "id | v\n1 | 10"
    state = {"history": ["x"], "mode": "table"}
    assert cli.command(db, ".tables", state) == "t" and "PRIMARY KEY" in cli.command(db, ".schema t", state)
    assert cli.command(db, ".mode line", state) == "line" and cli.command(db, ".exit", state) is None and ".tables" in cli.command(db, ".help", state)
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert "tessera" in capsys.readouterr().out


def test_manifest_round_trip():
    assert Manifest.loads(Manifest().dumps()) == Manifest()
