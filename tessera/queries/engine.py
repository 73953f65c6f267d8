"""Queries that go through the engine: DML on a scratch copy, prepared statements, row policies, SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_engine
from ..sources import scan
from .registry import query


def _copy(spark, d, ddl: str, rows):
    e = scratch_engine(spark, {t: f"{d}/{t}.parquet" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")})
    e.sql(ddl)
    e.bulk_insert("t", rows)
    return e


_CUSTOMER = "CREATE TABLE t (c_custkey BIGINT PRIMARY KEY, c_name TEXT NOT NULL, c_nationkey BIGINT, c_acctbal DOUBLE, c_mktsegment TEXT)"


@query("dml_insert", "SELECT r_regionkey::BIGINT AS k, r_name AS v FROM region UNION ALL VALUES (100, 'it''s'), (101, NULL)")
def _(spark, d):
    r = scan(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))
    e = _copy(spark, d, "CREATE TABLE t (k BIGINT PRIMARY KEY, v TEXT)", r)
    e.sql("INSERT INTO t VALUES (100, 'it''s'), (101, NULL)")
    return e.sql("SELECT * FROM t")


@query("dml_update", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey <= 500 THEN c_acctbal + 5000 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, d):
    e = _copy(spark, d, _CUSTOMER, scan(spark, d, "customer"))
    e.sql("UPDATE t SET c_acctbal = c_acctbal + 5000 WHERE c_mktsegment = 'BUILDING' AND c_custkey <= 500")
    return e.sql("SELECT c_custkey, c_acctbal FROM t")


@query("dml_delete", "SELECT c_custkey, c_name FROM customer WHERE NOT (c_acctbal < 0)")
def _(spark, d):
    e = _copy(spark, d, _CUSTOMER, scan(spark, d, "customer"))
    e.sql("DELETE FROM t WHERE c_acctbal < 0")
    return e.sql("SELECT c_custkey, c_name FROM t")


@query("ddl_add_column", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS email FROM customer UNION ALL SELECT -1, 'x@example.org'")
def _(spark, d):
    e = _copy(spark, d, _CUSTOMER, scan(spark, d, "customer"))
    e.sql("ALTER TABLE t ADD COLUMN email TEXT")
    e.sql("INSERT INTO t (c_custkey, c_name, email) VALUES (-1, 'n', 'x@example.org')")
    return e.sql("SELECT c_custkey, email FROM t")


@query("txn_commit", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS s FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey > 10 UNION ALL SELECT -5, 1.5)")
def _(spark, d):
    e = _copy(spark, d, _CUSTOMER, scan(spark, d, "customer"))
    e.sql("BEGIN")
    e.sql("DELETE FROM t WHERE c_custkey <= 10")
    e.sql("INSERT INTO t (c_custkey, c_name, c_acctbal) VALUES (-5, 'new', 1.5)")
    e.sql("COMMIT")
    return e.sql("SELECT count(*) AS n, round(sum(c_acctbal), 2) AS s FROM t")


@query("txn_rollback", "SELECT count(*) AS n FROM customer")
def _(spark, d):
    e = _copy(spark, d, _CUSTOMER, scan(spark, d, "customer"))
    e.sql("BEGIN")
    e.sql("DELETE FROM t")
    e.sql("ROLLBACK")
    return e.sql("SELECT count(*) AS n FROM t")


@query("rls_view", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    e = _copy(spark, d, _CUSTOMER, scan(spark, d, "customer"))
    e.sql("ALTER TABLE t ENABLE ROW LEVEL SECURITY")
    e.sql("CREATE POLICY p ON t USING (c_mktsegment = CURRENT_USER)")
    e.sql("SET ROLE 'BUILDING'")
    return e.sql("SELECT c_custkey FROM t")


@query("prepared", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000.5")
def _(spark, d):
    e = scratch_engine(spark, {"orders": f"{d}/orders.parquet"})
    e.sql("PREPARE q AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = $1 AND o_totalprice > $2")
    return e.sql("EXECUTE q ('F', 200000.5)")


@query("analyze_stats", "SELECT 't' AS \"table\", 'r_name' AS \"column\", count(*) AS n_rows, count(DISTINCT r_name) AS n_distinct FROM region UNION ALL SELECT 't', 'r_regionkey', count(*), count(DISTINCT r_regionkey) FROM region")
def _(spark, d):
    e = _copy(spark, d, "CREATE TABLE t (r_regionkey BIGINT PRIMARY KEY, r_name TEXT)", scan(spark, d, "region"))
    return e.sql("ANALYZE TABLE t")


@query("sql_vector_order", "SELECT vec_id FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST(list_resize([1.0], 64, 0.0) AS DOUBLE[])), vec_id LIMIT 5")
def _(spark, d):
    e = scratch_engine(spark, {"embeddings": f"{d}/embeddings.parquet"})
    point = "[" + ",".join(["1.0", *["0.0"] * 63]) + "]"
    return e.sql(f"SELECT vec_id FROM embeddings ORDER BY embedding <-> '{point}', vec_id LIMIT 5")


def _sql(spark, d, text: str, *tables: str):
    return scratch_engine(spark, {t: f"{d}/{t}.parquet" for t in tables}).sql(text)


@query("sql_casts", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS txt, c_custkey % 2 = 1 AS odd, false AS none, DATE '2026-05-20' AS day, [CAST(1 AS FLOAT), CAST(2.5 AS FLOAT)] AS v, CAST(c_nationkey AS BIGINT) AS n, CAST(c_custkey AS DOUBLE) AS f FROM customer")
def _(spark, d):
    return _sql(spark, d, "SELECT c_custkey, CAST(c_custkey AS TEXT) AS txt, CAST(CAST(c_custkey % 2 AS VARCHAR) AS BOOLEAN) AS odd, CAST('' AS BOOLEAN) AS none, CAST('2026-05-20' AS DATE) AS day, CAST('[1, 2.5]' AS VECTOR(2)) AS v, CAST(CAST(c_nationkey AS TEXT) AS INT) AS n, CAST(c_custkey AS FLOAT) AS f FROM customer", "customer")


@query("sql_trim", "SELECT n_nationkey, n_name AS t, length(n_name) AS n FROM nation")
def _(spark, d):
    return _sql(spark, d, "SELECT n_nationkey, TRIM(concat(' \t\u2003', n_name, '\n ')) AS t, CAST(LENGTH(TRIM(concat('\n', n_name))) AS INT) AS n FROM nation", "nation")


@query("sql_count_empty", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return _sql(spark, d, "SELECT COUNT() AS n FROM orders WHERE o_orderstatus = 'F'", "orders")


_HALF = "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS x FROM customer"


@query("sql_nulls_last", f"SELECT k, x FROM ({_HALF}) q WHERE k > (SELECT max(c_custkey) - 9 FROM customer) ORDER BY x ASC NULLS LAST, k LIMIT 7")
def _(spark, d):
    return _sql(spark, d, f"SELECT k, x FROM ({_HALF}) q WHERE k > (SELECT max(c_custkey) - 9 FROM customer) ORDER BY x, k LIMIT 7", "customer")


@query("sql_nulls_first", f"SELECT k, x FROM ({_HALF}) q ORDER BY x DESC NULLS FIRST, k DESC LIMIT 5")
def _(spark, d):
    return _sql(spark, d, f"SELECT k, x FROM ({_HALF}) q ORDER BY x DESC, k DESC LIMIT 5", "customer")


# equal keys: rows count up, where a RANGE frame would give each row its whole partition
@query("sql_default_frame", "SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation")
def _(spark, d):
    return _sql(spark, d, "SELECT n_regionkey, CAST(COUNT(*) OVER (PARTITION BY n_regionkey ORDER BY n_regionkey) AS BIGINT) AS n FROM nation", "nation")


@query("sql_recursive", "WITH RECURSIVE e AS (SELECT n_nationkey a, n_regionkey b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation), r(k) AS (SELECT CAST(0 AS BIGINT) UNION SELECT CAST(b AS BIGINT) FROM e JOIN r ON a = k) SELECT k, n_name FROM r JOIN nation ON n_nationkey = k")
def _(spark, d):
    return _sql(spark, d, "WITH RECURSIVE e AS (SELECT n_nationkey a, n_regionkey b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation), r(k) AS (SELECT CAST(0 AS BIGINT) UNION SELECT b FROM e JOIN r ON a = k) SELECT k, n_name FROM r JOIN nation ON n_nationkey = k", "nation")


@query("sql_recursive_all", "WITH RECURSIVE t(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM t WHERE n < 6) SELECT n FROM t")
def _(spark, d):
    return _sql(spark, d, "WITH RECURSIVE t(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM t WHERE n < 6) SELECT n FROM t")


@query("dml_delete_self", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > (SELECT avg(c_acctbal) FROM customer))")
def _(spark, d):
    rows = scan(spark, d, "customer")
    e = _copy(spark, d, _CUSTOMER, rows.where("c_custkey % 2 = 0 and c_acctbal < 4000"))
    e.bulk_insert("t", rows.where("not (c_custkey % 2 = 0 and c_acctbal < 4000)"))
    e.sql("DELETE FROM t WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM t)")
    return e.sql("SELECT c_custkey FROM t")


@query("dml_update_self", "SELECT c_custkey, CASE WHEN c_acctbal = (SELECT min(c_acctbal) FROM customer) THEN (SELECT max(c_acctbal) FROM customer) ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, d):
    rows = scan(spark, d, "customer")
    e = _copy(spark, d, _CUSTOMER, rows.where("c_custkey <= 700"))
    e.bulk_insert("t", rows.where("c_custkey > 700"))
    e.sql("UPDATE t SET c_acctbal = (SELECT MAX(c_acctbal) FROM t) WHERE t.c_acctbal = (SELECT MIN(c_acctbal) FROM t)")
    return e.sql("SELECT c_custkey, c_acctbal FROM t")


@query("bulk_load", "SELECT count(*) AS n, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem")
def _(spark, d):
    e = scratch_engine(spark)
    e.sql("CREATE TABLE t (l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE)")
    e.bulk_insert("t", scan(spark, d, "lineitem"))
    return e.sql("SELECT COUNT(*) AS n, MIN(l_orderkey) AS low, MAX(l_orderkey) AS high FROM t")


@query("encrypt_round_trip", "SELECT c_custkey, c_name FROM customer")
def _(spark, d):
    from ..sources import decrypt_column, encrypt_column

    key, aad = bytes(range(16)), F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"), F.lit("/c_name"))
    df = scan(spark, d, "customer", ["c_custkey", "c_name"])
    return decrypt_column(encrypt_column(df, "c_name", key, aad), "c_name", key, aad)
