"""Scans, filters, grouping, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relational import having, ordered, top
from ..sources import literal_row, point_lookup, scan
from .registry import query

c = F.col


@query("scan_project", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    return scan(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])


@query("point_lookup", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 77")
def _(spark, d):
    return point_lookup(scan(spark, d, "orders"), "o_orderkey", 77, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("index_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def _(spark, d):
    return point_lookup(scan(spark, d, "customer"), "c_nationkey", 7, ["c_custkey", "c_name"])


@query("star_expand", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def _(spark, d):
    n, r = scan(spark, d, "nation").alias("n"), scan(spark, d, "region").alias("r")
    return n.join(r, c("n.n_regionkey") == c("r.r_regionkey")).select("n.*", "r.r_name")


@query("literal_select", "SELECT CAST(4 * 5 AS BIGINT) AS prod, CAST(1 AS DOUBLE) / 2 AS half, CAST(10 % 3 AS BIGINT) AS rest, NOT true AS neg, 'it''s' AS quoted, NULL::BIGINT AS nothing")
def _(spark, d):
    return literal_row(spark, prod=(F.lit(4) * 5).cast("long"), half=F.lit(1) / 2, rest=(F.lit(10) % 3).cast("long"), neg=~F.lit(True), quoted=F.lit("it's"), nothing=F.lit(None).cast("long"))


@query("arith_precedence", "SELECT CAST(10 - 3 - 2 AS BIGINT) AS a, CAST(2 * 3 + 1 AS BIGINT) AS b, CAST(-2 + 5 AS BIGINT) AS c, CAST((1 + 2) * 3 AS BIGINT) AS d")
def _(spark, d):
    return spark.sql("SELECT CAST(10 - 3 - 2 AS BIGINT) AS a, CAST(2 * 3 + 1 AS BIGINT) AS b, CAST(-2 + 5 AS BIGINT) AS c, CAST((1 + 2) * 3 AS BIGINT) AS d")


@query("key_only_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, d):
    return scan(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("filter_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_tax <> 0 AND l_linenumber <= 4 AND l_extendedprice > 1000")
def _(spark, d):
    return scan(spark, d, "lineitem", ["l_orderkey", "l_linenumber"], (c("l_quantity") >= 45) & (c("l_discount") < 0.03) & (c("l_tax") != 0) & (c("l_linenumber") <= 4) & (c("l_extendedprice") > 1000))


@query("filter_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND NOT (o_totalprice > 150000)")
def _(spark, d):
    return scan(spark, d, "orders", ["o_orderkey"], ((c("o_orderstatus") == "F") | (c("o_orderstatus") == "P")) & ~(c("o_totalprice") > 150000))


@query("filter_in", "SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 5, 9)")
def _(spark, d):
    return scan(spark, d, "part", ["p_partkey", "p_brand"], c("p_size").isin(1, 5, 9))


@query("filter_not_in", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def _(spark, d):
    return scan(spark, d, "customer", ["c_custkey"], ~c("c_mktsegment").isin("BUILDING", "MACHINERY"))


@query("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'")
def _(spark, d):
    return scan(spark, d, "lineitem", ["l_orderkey", "l_linenumber"], c("l_shipdate").between(F.expr("TIMESTAMP_NTZ'1996-01-01'"), F.expr("TIMESTAMP_NTZ'1996-03-31'")))


@query("filter_not_between", "SELECT p_partkey FROM part WHERE p_retailprice NOT BETWEEN 950 AND 1500")
def _(spark, d):
    return scan(spark, d, "part", ["p_partkey"], ~c("p_retailprice").between(950, 1500))


@query("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'")
def _(spark, d):
    return scan(spark, d, "part", ["p_partkey", "p_name"], c("p_name").like("%a_e%"))


@query("filter_not_like", "SELECT c_custkey, c_name FROM customer WHERE c_name NOT LIKE '%1'")
def _(spark, d):
    return scan(spark, d, "customer", ["c_custkey", "c_name"], ~c("c_name").like("%1"))


def _with_nulls(spark, d):
    """Customers beside their large orders: null where there is none."""
    o = scan(spark, d, "orders", ["o_custkey", "o_orderkey"], c("o_totalprice") > 200000)
    return scan(spark, d, "customer", ["c_custkey"]).join(o, c("c_custkey") == c("o_custkey"), "left")


_NULLS = "customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey"


@query("filter_is_null", f"SELECT c_custkey FROM {_NULLS} WHERE o_orderkey IS NULL")
def _(spark, d):
    return _with_nulls(spark, d).where(c("o_orderkey").isNull()).select("c_custkey")


@query("filter_is_not_null", f"SELECT c_custkey, o_orderkey FROM {_NULLS} WHERE o_orderkey IS NOT NULL")
def _(spark, d):
    return _with_nulls(spark, d).where(c("o_orderkey").isNotNull()).select("c_custkey", "o_orderkey")


@query("filter_unprojected", "SELECT p_name FROM part WHERE p_size BETWEEN 3 AND 7 AND p_type IN (SELECT min(p_type) FROM part)")
def _(spark, d):
    p = scan(spark, d, "part")
    return p.where(c("p_size").between(3, 7)).join(p.agg(F.min("p_type").alias("t")), c("p_type") == c("t"), "left_semi").select("p_name")


@query("agg_global", "SELECT count(*) AS n, count(l_quantity) AS nq, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 4) AS a, min(l_shipdate) AS lo, max(l_returnflag) AS hi FROM lineitem")
def _(spark, d):
    return scan(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count("l_quantity").alias("nq"), F.round(F.sum("l_quantity"), 2).alias("s"), F.round(F.avg("l_quantity"), 4).alias("a"), F.min("l_shipdate").alias("lo"), F.max("l_returnflag").alias("hi"))


@query("agg_empty", "SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_tax) AS lo FROM lineitem WHERE l_quantity < 0")
def _(spark, d):
    return scan(spark, d, "lineitem", None, c("l_quantity") < 0).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"), F.avg("l_quantity").alias("a"), F.min("l_tax").alias("lo"))


@query("agg_count_nulls", f"SELECT count(*) AS n, count(o_orderkey) AS k FROM {_NULLS}")
def _(spark, d):
    return _with_nulls(spark, d).agg(F.count("*").alias("n"), F.count("o_orderkey").alias("k"))


@query("agg_group", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag")
def _(spark, d):
    return scan(spark, d, "lineitem", None, c("l_quantity") > 10).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("agg_group_multi", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS s, round(avg(l_discount), 4) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def _(spark, d):
    return scan(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_extendedprice"), 2).alias("s"), F.round(F.avg("l_discount"), 4).alias("a"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count("*").alias("n"))


@query("agg_cast", "SELECT l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY l_linestatus")
def _(spark, d):
    return scan(spark, d, "lineitem").groupBy("l_linestatus").agg(F.sum(c("l_quantity").cast("long")).alias("q"))


@query("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def _(spark, d):
    return having(scan(spark, d, "orders"), ["o_custkey"], {"n": F.count("*"), "s": F.round(F.sum("o_totalprice"), 2)}, c("n") > 12)


@query("having_unselected", "SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING sum(c_acctbal) > 0")
def _(spark, d):
    return having(scan(spark, d, "customer"), ["c_nationkey"], {"s": F.sum("c_acctbal")}, c("s") > 0).select("c_nationkey")


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(spark, d):
    return scan(spark, d, "lineitem", ["l_returnflag", "l_linestatus"]).distinct()


@query("group_no_agg", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority")
def _(spark, d):
    return scan(spark, d, "orders", ["o_orderstatus", "o_orderpriority"]).dropDuplicates()


@query("sort_multi", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey")
def _(spark, d):
    return ordered(scan(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"]), "c_mktsegment", ("c_acctbal", "desc"), "c_custkey")


@query("sort_expr", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice * -1, o_orderkey")
def _(spark, d):
    return scan(spark, d, "orders", ["o_orderkey", "o_totalprice"]).orderBy(c("o_totalprice") * -1, "o_orderkey")


@query("sort_nulls_last", f"SELECT c_custkey, o_orderkey FROM {_NULLS} ORDER BY o_orderkey ASC NULLS LAST, c_custkey")
def _(spark, d):
    return ordered(_with_nulls(spark, d).select("c_custkey", "o_orderkey"), "o_orderkey", "c_custkey")


@query("sort_nulls_first", f"SELECT c_custkey, o_orderkey FROM {_NULLS} ORDER BY o_orderkey DESC NULLS FIRST, c_custkey")
def _(spark, d):
    return ordered(_with_nulls(spark, d).select("c_custkey", "o_orderkey"), ("o_orderkey", "desc"), "c_custkey")


@query("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def _(spark, d):
    return top(scan(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"]), 100, ("l_extendedprice", "desc"), "l_orderkey", "l_linenumber")


@query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 35")
def _(spark, d):
    return ordered(scan(spark, d, "orders", ["o_orderkey"]), "o_orderkey").offset(35).limit(20)


@query("limit_zero", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0")
def _(spark, d):
    return ordered(scan(spark, d, "orders", ["o_orderkey"]), "o_orderkey").limit(0)


@query("offset_only", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
def _(spark, d):
    return ordered(scan(spark, d, "nation", ["n_nationkey"]), "n_nationkey").offset(20)


@query("events_hourly", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    from ..streaming import windowed_counts

    w = windowed_counts(scan(spark, d, "events"))
    return w.select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
