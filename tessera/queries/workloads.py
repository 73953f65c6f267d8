"""Benchmark queries: order-processing ones and staff-audit ones on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relational import anti, top
from ..operators.window import ranking
from ..sources import point_lookup, scan
from .registry import query

c = F.col


@query("tpch_q03", "SELECT l_orderkey, l_extendedprice, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15'")
def _(spark, d):
    cu = scan(spark, d, "customer", ["c_custkey"], c("c_mktsegment") == "BUILDING")
    o = scan(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"], c("o_orderdate") < F.expr("TIMESTAMP_NTZ'1995-03-15'"))
    return scan(spark, d, "lineitem", ["l_orderkey", "l_extendedprice"]).join(o.join(cu, c("o_custkey") == c("c_custkey")), c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_extendedprice", "o_orderdate")


@query("tpch_q06", "SELECT l_extendedprice, l_discount FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 24")
def _(spark, d):
    return scan(spark, d, "lineitem", ["l_extendedprice", "l_discount"], (c("l_discount") > 0.05) & (c("l_quantity") < 24))


@query("tpch_q07", "SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def _(spark, d):
    return scan(spark, d, "lineitem", ["l_orderkey"]).join(scan(spark, d, "orders", ["o_orderkey"]), c("l_orderkey") == c("o_orderkey"), "left_semi")


@query("tpch_q08", "WITH revenue AS (SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_discount < 0.1) SELECT o_orderkey FROM orders JOIN revenue ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def _(spark, d):
    revenue = scan(spark, d, "lineitem", ["l_orderkey"], c("l_discount") < 0.1)
    return scan(spark, d, "orders", ["o_orderkey"], c("o_orderstatus") == "F").join(revenue, c("o_orderkey") == c("l_orderkey")).select("o_orderkey")


@query("tpch_q09", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return scan(spark, d, "customer", ["c_custkey"], c("c_mktsegment") == "BUILDING").unionAll(scan(spark, d, "orders", ["o_custkey"], c("o_orderstatus") == "F")).distinct()


@query("tpch_q10", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer")
def _(spark, d):
    return scan(spark, d, "customer").select("c_custkey", F.row_number().over(ranking(["c_mktsegment"], ["c_custkey"])).cast("long").alias("rn"))


@query("tpch_q12", "SELECT CAST(l_quantity AS BIGINT) AS qty FROM lineitem WHERE CAST(l_quantity AS BIGINT) > 10")
def _(spark, d):
    return scan(spark, d, "lineitem").select(c("l_quantity").cast("long").alias("qty")).where("qty > 10")


# -- staff audit: nations stand for agencies, segments for departments, customers for staff, orders for payslips --


@query("hr_count", "SELECT count(*) AS n FROM customer")
def _(spark, d):
    return scan(spark, d, "customer").agg(F.count("*").alias("n"))


@query("hr_headcount_agency", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 10")
def _(spark, d):
    return top(scan(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), 10, ("n", "desc"), "c_nationkey")


@query("hr_headcount_dept", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment")
def _(spark, d):
    return scan(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_mktsegment")


@query("hr_mass", "SELECT round(sum(o_totalprice), 2) AS mass FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return scan(spark, d, "orders", None, c("o_orderstatus") == "F").agg(F.round(F.sum("o_totalprice"), 2).alias("mass"))


@query("hr_avg_by_dept", "SELECT c_mktsegment, round(avg(o_totalprice), 4) AS a FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment ORDER BY a DESC LIMIT 10")
def _(spark, d):
    o = scan(spark, d, "orders", ["o_custkey", "o_totalprice"], c("o_orderstatus") == "F")
    j = o.join(scan(spark, d, "customer", ["c_custkey", "c_mktsegment"]), c("c_custkey") == c("o_custkey"))
    return top(j.groupBy("c_mktsegment").agg(F.round(F.avg("o_totalprice"), 4).alias("a")), 10, ("a", "desc"))


@query("hr_country", "SELECT n_name, count(c_custkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name LIMIT 10")
def _(spark, d):
    j = scan(spark, d, "customer", ["c_custkey", "c_nationkey"]).join(scan(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    return top(j.groupBy("n_name").agg(F.count("c_custkey").alias("n")), 10, ("n", "desc"), "n_name")


@query("hr_having_large", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 55 ORDER BY n DESC, c_nationkey")
def _(spark, d):
    return scan(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).where("n > 55").orderBy(F.desc("n"), "c_nationkey")


@query("hr_top_salaries", "SELECT c_name, c_acctbal, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey ORDER BY c_acctbal DESC, c_name LIMIT 15")
def _(spark, d):
    j = scan(spark, d, "customer").join(scan(spark, d, "nation"), c("n_nationkey") == c("c_nationkey")).select("c_name", "c_acctbal", "n_name")
    return top(j, 15, ("c_acctbal", "desc"), "c_name")


@query("hr_left_join", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def _(spark, d):
    return scan(spark, d, "nation").join(scan(spark, d, "supplier"), c("s_nationkey") == c("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


@query("hr_in_subquery", "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) ORDER BY c_name LIMIT 10")
def _(spark, d):
    o = scan(spark, d, "orders", ["o_custkey"], c("o_totalprice") > 250000)
    return top(scan(spark, d, "customer").join(o, c("c_custkey") == c("o_custkey"), "left_semi").select("c_name"), 10, "c_name")


@query("hr_scalar_avg", "SELECT count(*) AS n FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def _(spark, d):
    cu = scan(spark, d, "customer", ["c_acctbal"])
    return cu.crossJoin(F.broadcast(cu.agg(F.avg("c_acctbal").alias("a")))).where("c_acctbal > a").agg(F.count("*").alias("n"))  # one row


@query("hr_exists", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) ORDER BY n_name LIMIT 10")
def _(spark, d):
    rich = scan(spark, d, "customer", ["c_nationkey"], c("c_acctbal") > 9900)
    return top(scan(spark, d, "nation").join(rich, c("c_nationkey") == c("n_nationkey"), "left_semi").select("n_name"), 10, "n_name")


@query("hr_not_exists", "SELECT c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) ORDER BY c_name LIMIT 5")
def _(spark, d):
    return top(anti(scan(spark, d, "customer"), scan(spark, d, "orders", None, c("o_totalprice") > 400000), "c_custkey", "o_custkey").select("c_name"), 5, "c_name")


@query("hr_cte", "WITH hc AS (SELECT n_name, count(c_custkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name) SELECT n_name, n FROM hc ORDER BY n DESC, n_name LIMIT 10")
def _(spark, d):
    hc = scan(spark, d, "customer").join(scan(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("c_custkey").alias("n"))
    return top(hc, 10, ("n", "desc"), "n_name")


@query("hr_region_mass", "SELECT r_name, round(sum(o_totalprice), 2) AS mass FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus = 'F' GROUP BY r_name ORDER BY mass DESC LIMIT 10")
def _(spark, d):
    per = scan(spark, d, "orders", None, c("o_orderstatus") == "F").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    j = per.join(scan(spark, d, "customer"), c("c_custkey") == c("o_custkey")).join(scan(spark, d, "nation"), c("n_nationkey") == c("c_nationkey")).join(scan(spark, d, "region"), c("r_regionkey") == c("n_regionkey"))
    return top(j.groupBy("r_name").agg(F.round(F.sum("s"), 2).alias("mass")), 10, ("mass", "desc"))


# -- micro-benchmarks --


@query("micro_count_where", "SELECT count(*) AS n FROM lineitem WHERE l_extendedprice > 60000")
def _(spark, d):
    return scan(spark, d, "lineitem", None, c("l_extendedprice") > 60000).agg(F.count("*").alias("n"))


@query("micro_group_by", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return scan(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("micro_sum_group", "SELECT l_linenumber, round(sum(l_extendedprice), 2) AS m FROM lineitem GROUP BY l_linenumber")
def _(spark, d):
    return scan(spark, d, "lineitem").groupBy("l_linenumber").agg(F.round(F.sum("l_extendedprice"), 2).alias("m"))


@query("micro_avg_where", "SELECT round(avg(l_extendedprice), 4) AS a FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    return scan(spark, d, "lineitem", None, c("l_returnflag") == "R").agg(F.round(F.avg("l_extendedprice"), 4).alias("a"))


@query("micro_topk", "SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 10")
def _(spark, d):
    return top(scan(spark, d, "customer", ["c_name", "c_acctbal"]), 10, ("c_acctbal", "desc"), "c_name")


@query("micro_point", "SELECT c_name FROM customer WHERE c_custkey = 100")
def _(spark, d):
    return point_lookup(scan(spark, d, "customer"), "c_custkey", 100, ["c_name"])
