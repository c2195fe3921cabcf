"""Queries over the test tables: the dialect's text beside the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Database
from .plans.compiler import compile_select
from .plans.parser import parse
from .sources.scratch import scratch_path

_SEG = "nullif(c_mktsegment, 'BUILDING')"
#: Tables with nulls, derived as the generated ones hold none.
_DERIVED: dict[str, tuple[str, str]] = {
    "cust": ("customer", f"c_custkey, c_name, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_nationkey END AS c_nationkey, c_acctbal, {_SEG} AS seg"),
    "docs": ("documents", "doc_id, lang, n_chars, text AS body"),
}
_CUST = f"(SELECT {_DERIVED['cust'][1]} FROM customer)"
_SUM = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

# name -> (text in the dialect, output names or None, SQL)
SELECTS: dict[str, tuple[str, list[str] | None, str]] = {
    "scan_all": ("SELECT * FROM nation", None, "SELECT * FROM nation"),
    "project_columns": ("SELECT n_name, n_nationkey FROM nation", None, "SELECT n_name, n_nationkey FROM nation"),
    "project_literal": ("SELECT n_name, 7, 'x' FROM nation", ["n_name", "seven", "x"], "SELECT n_name, CAST(7 AS BIGINT) AS seven, 'x' AS x FROM nation"),
    "project_expr": ("SELECT n_name, n_nationkey + 2 * 3 FROM nation", ["n_name", "v"], "SELECT n_name, CAST(n_nationkey + 6 AS BIGINT) AS v FROM nation"),
    "project_qualified": ("SELECT n.n_name FROM nation AS n", None, "SELECT n_name FROM nation"),
    "filter_eq": ("SELECT c_custkey, seg FROM cust WHERE seg = 'MACHINERY'", None, f"SELECT c_custkey, seg FROM {_CUST} WHERE seg = 'MACHINERY'"),
    "filter_ne_keeps_null": ("SELECT c_custkey, seg FROM cust WHERE seg != 'MACHINERY'", None, f"SELECT c_custkey, seg FROM {_CUST} WHERE seg IS DISTINCT FROM 'MACHINERY'"),
    "filter_range": ("SELECT c_custkey FROM cust WHERE c_acctbal >= 100.5 AND c_acctbal < 5000", None, "SELECT c_custkey FROM customer WHERE c_acctbal >= 100.5 AND c_acctbal < 5000"),
    "filter_and_or": ("SELECT c_custkey FROM cust WHERE seg = 'MACHINERY' AND c_acctbal > 0 OR c_nationkey <= 7", None, f"SELECT c_custkey FROM {_CUST} WHERE coalesce(seg = 'MACHINERY' AND c_acctbal > 0, false) OR coalesce(c_nationkey <= 7, false)"),
    "filter_not_null_true": ("SELECT c_custkey FROM cust WHERE NOT c_nationkey > 10", None, f"SELECT c_custkey FROM {_CUST} WHERE NOT coalesce(c_nationkey > 10, false)"),
    "filter_not_nested": ("SELECT c_custkey FROM cust WHERE NOT (c_nationkey > 10 AND seg = 'MACHINERY')", None, f"SELECT c_custkey FROM {_CUST} WHERE NOT (coalesce(c_nationkey > 10, false) AND coalesce(seg = 'MACHINERY', false))"),
    "filter_is_null": ("SELECT c_custkey FROM cust WHERE seg IS NULL", None, f"SELECT c_custkey FROM {_CUST} WHERE seg IS NULL"),
    "filter_is_not_null": ("SELECT c_custkey FROM cust WHERE seg IS NOT NULL", None, f"SELECT c_custkey FROM {_CUST} WHERE seg IS NOT NULL"),
    "filter_eq_null": ("SELECT c_custkey FROM cust WHERE seg = NULL", None, f"SELECT c_custkey FROM {_CUST} WHERE seg IS NULL"),
    "filter_truthy": ("SELECT c_custkey FROM cust WHERE c_nationkey", None, f"SELECT c_custkey FROM {_CUST} WHERE coalesce(c_nationkey <> 0, false)"),
    "filter_cross_type": ("SELECT c_custkey FROM cust WHERE seg != 5", None, "SELECT c_custkey FROM customer"),
    "and_or_value": ("SELECT c_custkey, seg AND c_name, seg OR c_name FROM cust", ["c_custkey", "a", "o"], f"SELECT c_custkey, CASE WHEN seg <> '' THEN c_name ELSE seg END AS a, CASE WHEN seg <> '' THEN seg ELSE c_name END AS o FROM {_CUST}"),
    "arith_add_sub_mul": ("SELECT l_orderkey, l_linenumber, l_orderkey + l_partkey, l_orderkey - l_partkey, l_orderkey * l_linenumber FROM lineitem", ["l_orderkey", "l_linenumber", "a", "b", "c"], "SELECT l_orderkey, l_linenumber, l_orderkey + l_partkey AS a, l_orderkey - l_partkey AS b, l_orderkey * l_linenumber AS c FROM lineitem"),
    "true_division": ("SELECT p_partkey, p_size / 4 FROM part", ["p_partkey", "v"], "SELECT p_partkey, CAST(p_size AS DOUBLE) / 4 AS v FROM part"),
    "unary_minus": ("SELECT p_partkey, -p_size FROM part", ["p_partkey", "v"], "SELECT p_partkey, CAST(-p_size AS INTEGER) AS v FROM part"),
    "text_concat": ("SELECT p_partkey, p_brand + '/' + p_type FROM part", ["p_partkey", "v"], "SELECT p_partkey, p_brand || '/' || p_type AS v FROM part"),
    "date_literal_filter": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATETIME '1996-01-01T00:00:00'", None, "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'"),
    "datetime_literal_filter": ("SELECT o_orderkey FROM orders WHERE o_orderdate < DATETIME '1995-06-17 12:30:00'", None, "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-17 12:30:00'"),
    "decimal_literal_filter": ("SELECT p_partkey FROM part WHERE p_size > DECIMAL '24.5'", None, "SELECT p_partkey FROM part WHERE p_size > 24.5"),
    "index_equality": ("SELECT * FROM orders WHERE o_orderkey = 100", None, "SELECT * FROM orders WHERE o_orderkey = 100"),
    "index_range": ("SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 500", None, "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 500"),
    "index_lt": ("SELECT o_orderkey FROM orders WHERE o_orderkey < 50", None, "SELECT o_orderkey FROM orders WHERE o_orderkey < 50"),
    "index_merged_bounds": ("SELECT o_orderkey FROM orders WHERE o_orderkey > 10 AND o_orderkey >= 40 AND 90 > o_orderkey", None, "SELECT o_orderkey FROM orders WHERE o_orderkey >= 40 AND o_orderkey < 90"),
    "inner_join_on": ("SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey", None, "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey"),
    "inner_join_theta": ("SELECT a.n_name, b.r_name FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey", None, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey"),
    "left_join_unmatched": ("SELECT d.doc_id, l.quality FROM docs d LEFT JOIN labels l ON d.doc_id = l.doc_id", None, "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "join_using": ("SELECT doc_id, lang, toxic FROM docs JOIN labels USING (doc_id)", None, "SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)"),
    "left_join_using": ("SELECT * FROM docs LEFT JOIN labels USING (doc_id)", None, "SELECT d.doc_id, lang, n_chars, text AS body, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "self_join": ("SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", ["a", "b"], "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    "three_way_join": ("SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", None, "SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "six_table_join": ("SELECT r_name, COUNT(*) FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY r_name", ["r_name", "n"], "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY r_name"),
    "join_where_after": ("SELECT d.doc_id FROM docs d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL AND d.lang = 'en'", None, "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL AND d.lang = 'en'"),
    "join_star_dedup": ("SELECT * FROM docs d JOIN labels l ON d.doc_id = l.doc_id", None, "SELECT d.doc_id, lang, n_chars, text AS body, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"),
    "join_null_keys": ("SELECT c_custkey, n_name FROM cust LEFT JOIN nation ON c_nationkey = n_nationkey", None, f"SELECT c_custkey, n_name FROM {_CUST} LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "count_star": ("SELECT COUNT(*) FROM lineitem", ["n"], "SELECT count(*) AS n FROM lineitem"),
    "count_col_skips_null": ("SELECT COUNT(*), COUNT(seg) FROM cust", ["n", "k"], f"SELECT count(*) AS n, count(seg) AS k FROM {_CUST}"),
    "sum_avg_min_max": ("SELECT SUM(c_nationkey), AVG(c_nationkey), MIN(c_acctbal), MAX(c_acctbal) FROM cust", ["s", "a", "lo", "hi"], f"SELECT CAST(sum(c_nationkey) AS BIGINT) AS s, avg(c_nationkey) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM {_CUST}"),
    "min_max_text": ("SELECT MIN(c_name), MAX(c_name) FROM customer", ["lo", "hi"], "SELECT min(c_name) AS lo, max(c_name) AS hi FROM customer"),
    "agg_empty_input": ("SELECT COUNT(*), SUM(c_custkey), MIN(c_name) FROM customer WHERE c_custkey < 0", ["n", "s", "m"], "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s, min(c_name) AS m FROM customer WHERE c_custkey < 0"),
    "group_by_one": ("SELECT l_returnflag, COUNT(*), SUM(l_linenumber) FROM lineitem GROUP BY l_returnflag", ["l_returnflag", "n", "s"], "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag"),
    "group_by_two": ("SELECT l_returnflag, l_linestatus, MAX(l_shipdate) FROM lineitem GROUP BY l_returnflag, l_linestatus", ["f", "s", "m"], "SELECT l_returnflag AS f, l_linestatus AS s, max(l_shipdate) AS m FROM lineitem GROUP BY ALL"),
    "group_by_drops_null": ("SELECT seg, COUNT(*) FROM cust GROUP BY seg", ["seg", "n"], f"SELECT seg, count(*) AS n FROM {_CUST} WHERE seg IS NOT NULL GROUP BY seg"),
    "group_by_no_agg": ("SELECT seg FROM cust GROUP BY seg", None, f"SELECT DISTINCT seg FROM {_CUST} WHERE seg IS NOT NULL"),
    "agg_over_join": ("SELECT n_name, COUNT(*), MAX(o_totalprice) FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o_totalprice > 1000 GROUP BY n_name ORDER BY n_name", ["n_name", "n", "m"], "SELECT n_name, count(*) AS n, max(o_totalprice) AS m FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000 GROUP BY n_name"),
    "group_order": ("SELECT c_nationkey, COUNT(*) FROM customer GROUP BY c_nationkey ORDER BY c_nationkey DESC LIMIT 5", ["k", "n"], "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY k ORDER BY k DESC LIMIT 5"),
    "order_asc_nulls_last": ("SELECT c_custkey, seg FROM cust ORDER BY seg, c_custkey", None, f"SELECT c_custkey, seg FROM {_CUST} ORDER BY seg ASC NULLS LAST, c_custkey"),
    "order_desc_nulls_first": ("SELECT c_custkey, seg FROM cust ORDER BY seg DESC, c_custkey", None, f"SELECT c_custkey, seg FROM {_CUST} ORDER BY seg DESC NULLS FIRST, c_custkey"),
    "order_multi_key": ("SELECT c_custkey FROM cust ORDER BY c_nationkey DESC, c_custkey", None, f"SELECT c_custkey FROM {_CUST} ORDER BY c_nationkey DESC NULLS FIRST, c_custkey"),
    "order_hidden_column": ("SELECT c_name FROM customer ORDER BY c_custkey DESC LIMIT 10", None, "SELECT c_name FROM customer ORDER BY c_custkey DESC LIMIT 10"),
    "limit": ("SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 3", None, "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 3"),
    "limit_offset": ("SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 4 OFFSET 7", None, "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 4 OFFSET 7"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
}


def _select(text: str, names: list[str] | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def table(name: str) -> DataFrame:
            base, columns = _DERIVED.get(name, (name, "*"))
            df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
            return df if columns == "*" else df.selectExpr(*_split(columns))

        out = compile_select(parse(text), table)
        return out if names is None else out.toDF(*names)

    return run


def _split(columns: str) -> list[str]:
    out, depth = [""], 0
    for ch in columns:
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def _customers(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(scratch_path(spark), spark)
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT NOT NULL, nation INT, balance FLOAT, seg TEXT)")
    raw = spark.read.parquet(f"{sf_dir}/customer.parquet")
    db.append("t", raw.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.expr(_SEG).alias("seg")))
    return db


_T = f"(SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance, {_SEG} AS seg FROM customer)"


def _after(*statements: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = _customers(spark, sf_dir)
        for s in statements:
            db.execute(s)
        return db.sql("SELECT * FROM t")

    return run


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .errors import ConstraintViolation

    db = _customers(spark, sf_dir)
    for s in ("INSERT INTO t VALUES (900001, 'a', 1, 1.0, 'x'), (900001, 'b', 1, 1.0, 'x')", "INSERT INTO t (id, seg) VALUES (900002, 'x')", "UPDATE t SET name = NULL", "UPDATE t SET id = 1"):
        try:
            db.execute(s)
        except ConstraintViolation:
            continue
        raise AssertionError(s)
    return db.sql("SELECT * FROM t")


def _rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    for s in ("BEGIN", "DELETE FROM t", "INSERT INTO t (id, name) VALUES (1, 'z')", "ROLLBACK"):
        db.execute(s)
    return db.sql("SELECT * FROM t")


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    before = db.sql("SELECT * FROM t")
    db.execute("DELETE FROM t WHERE id > 10")
    return before


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(scratch_path(spark), spark)
    db.execute("CREATE TABLE v (a INT, b FLOAT, c TEXT, d BOOL, e DATE, f TIME, g DATETIME, h DECIMAL, i BLOB, j JSON)")
    db.execute("INSERT INTO v VALUES (-7, 2.5, 'it''s', TRUE, DATE '2024-02-29', TIME '12:34:56', DATETIME '2024-02-29T01:02:03', DECIMAL '12345.6789', BLOB '000102', JSON '{\"b\": [1, null], \"a\": 1}'), (NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)")
    return db.sql("SELECT * FROM v").selectExpr("a", "b", "c", "d", "e", "cast(f as string) f", "g", "cast(h as double) h", "hex(i) i", "j")


def _indexed(select: str, then: str = ""):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(scratch_path(spark), spark)
        db.register_parquet("c", f"{sf_dir}/customer.parquet")
        db.execute("CREATE TABLE o (id INT PRIMARY KEY, customer INT)")
        db.append("o", spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")))
        db.execute("CREATE INDEX by_customer ON o (customer)")
        if then:
            db.drop_index("by_customer")
        return db.sql(select)

    return run


def _composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unique index over two columns refuses a repeated pair, and takes the same value in one of them."""
    from .errors import ConstraintViolation

    db = Database(scratch_path(spark), spark)
    db.execute("CREATE TABLE l (a INT, b INT)")
    db.append("l", spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")).distinct())
    db.create_index("pair", "l", ["a", "b"], unique=True)
    db.execute("INSERT INTO l VALUES (-1, 1), (-1, 2)")
    for s in ("INSERT INTO l VALUES (-1, 2)", "UPDATE l SET b = 1 WHERE a = -1"):
        try:
            db.execute(s)
        except ConstraintViolation:
            continue
        raise AssertionError(s)
    return db.sql("SELECT * FROM l")


def _dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(scratch_path(spark), spark)
    for s in ("CREATE TABLE kept (a INT)", "CREATE TABLE gone (a INT)", "DROP TABLE gone", "DROP TABLE IF EXISTS gone"):
        db.execute(s)
    return spark.createDataFrame([(t,) for t in db.list_tables()], "name string")


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(scratch_path(spark), spark)
    db.register("o", spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day")))
    return db.sql("SELECT id, day - DATE '1995-01-01' FROM o").toDF("id", "days").withColumn("days", F.col("days").cast("bigint"))


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(scratch_path(spark), spark)
    db.register_parquet("r", f"{sf_dir}/region.parquet")
    return db.sql("SELECT r_name FROM r").toDF("name")


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty INSERTs, whose directories are merged by size on the way."""
    db = _customers(spark, sf_dir)
    for i in range(40):
        db.execute(f"INSERT INTO t (id, name) VALUES ({900000 + i}, 'n')")
    db.compact("t")
    return db.sql("SELECT * FROM t")


STATES: dict[str, tuple[Callable, str]] = {
    "ddl_insert_roundtrip": (_after("INSERT INTO t VALUES (900001, 'new', 3, 1.5, NULL), (900002, 'o', NULL, 2, 'S')"), f"SELECT * FROM {_T} UNION ALL VALUES (900001, 'new', 3, 1.5, NULL), (900002, 'o', NULL, 2.0, 'S')"),
    "insert_column_subset": (_after("INSERT INTO t (name, id) VALUES ('sub', 900003)"), f"SELECT * FROM {_T} UNION ALL SELECT 900003, 'sub', NULL, NULL, NULL"),
    "update_expr": (_after("UPDATE t SET nation = nation + 1, name = name + '!' WHERE nation > 10 AND seg = 'MACHINERY'"), f"SELECT id, CASE WHEN p THEN name || '!' ELSE name END AS name, CASE WHEN p THEN nation + 1 ELSE nation END AS nation, balance, seg FROM (SELECT *, coalesce(nation > 10 AND seg = 'MACHINERY', false) AS p FROM {_T})"),
    "update_no_where": (_after("UPDATE t SET nation = id, id = id + 5"), f"SELECT id + 5 AS id, name, id AS nation, balance, seg FROM {_T}"),
    "delete_where": (_after("DELETE FROM t WHERE nation >= 12"), f"SELECT * FROM {_T} WHERE NOT nation >= 12"),
    "delete_keeps_null": (_after("DELETE FROM t WHERE seg < 'H'"), f"SELECT * FROM {_T} WHERE NOT coalesce(seg < 'H', false)"),
    "constraint_state": (_failed, f"SELECT * FROM {_T}"),
    "rollback_state": (_rolled_back, f"SELECT * FROM {_T}"),
    "snapshot_state": (_snapshot, f"SELECT * FROM {_T}"),
    "index_created_equality": (_indexed("SELECT id, customer FROM o WHERE customer = 17"), "SELECT o_orderkey AS id, o_custkey AS customer FROM orders WHERE o_custkey = 17"),
    "index_created_range": (_indexed("SELECT id, customer FROM o WHERE customer >= 20 AND customer < 60"), "SELECT o_orderkey AS id, o_custkey AS customer FROM orders WHERE o_custkey >= 20 AND o_custkey < 60"),
    "index_created_join": (_indexed("SELECT id, c_name FROM o JOIN c ON customer = c_custkey"), "SELECT o_orderkey AS id, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "index_dropped": (_indexed("SELECT id, customer FROM o WHERE customer < 9", "DROP"), "SELECT o_orderkey AS id, o_custkey AS customer FROM orders WHERE o_custkey < 9"),
    "index_composite_unique": (_composite, "SELECT DISTINCT l_orderkey AS a, l_linenumber AS b FROM lineitem UNION ALL SELECT -1, 1 UNION ALL SELECT -1, 2"),
    "drop_table_state": (_dropped, "SELECT 'kept' AS name"),
    "date_difference": (_dates, "SELECT o_orderkey AS id, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders"),
    "register_parquet": (_registered, "SELECT r_name AS name FROM region"),
    "compacted_state": (_compacted, f"SELECT * FROM {_T} UNION ALL SELECT 900000 + range, 'n', NULL, NULL, NULL FROM range(40)"),
    "types_roundtrip": (_types, "SELECT CAST(-7 AS BIGINT) AS a, CAST(2.5 AS DOUBLE) AS b, 'it''s' AS c, true AS d, DATE '2024-02-29' AS e, '12:34:56' AS f, TIMESTAMP '2024-02-29 01:02:03' AS g, CAST(12345.6789 AS DOUBLE) AS h, '000102' AS i, '{\"a\":1,\"b\":[1,null]}' AS j UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _select(text, names) for k, (text, names, _) in SELECTS.items()} | {k: f for k, (f, _) in STATES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, _, sql) in SELECTS.items()} | {k: sql for k, (_, sql) in STATES.items()}
