"""Joins and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relational import anti, not_in, range_join, salted_join
from ..sources import scan
from .registry import query

c = F.col


@query("join_inner_n1", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, d):
    return scan(spark, d, "lineitem").join(scan(spark, d, "orders"), c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("join_key_order", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(spark, d):
    return scan(spark, d, "nation").join(scan(spark, d, "region"), c("r_regionkey") == c("n_regionkey")).select("n_name", "r_name")


@query("join_inner_3way", "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark, d):
    o, cu = scan(spark, d, "orders"), scan(spark, d, "customer")
    # orders are summed per customer before the join: what is shuffled shrinks to one row per customer
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    j = per.join(cu, c("o_custkey") == c("c_custkey")).join(scan(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(scan(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return j.groupBy("r_name").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("s"))


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000")
def _(spark, d):
    o = scan(spark, d, "orders", ["o_custkey", "o_orderkey"], c("o_totalprice") > 150000)
    return scan(spark, d, "customer", ["c_custkey"]).join(o, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("join_left_empty", "SELECT r_regionkey, n_name FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 0) ON r_regionkey = n_regionkey")
def _(spark, d):
    n = scan(spark, d, "nation", None, c("n_nationkey") < 0)
    return scan(spark, d, "region").join(n, c("r_regionkey") == c("n_regionkey"), "left").select("r_regionkey", "n_name")


@query("join_composite", "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1")
def _(spark, d):
    a = scan(spark, d, "lineitem", ["l_orderkey", "l_linenumber"])
    b = scan(spark, d, "lineitem").select(c("l_orderkey").alias("k"), (c("l_linenumber") + 1).alias("m"), "l_partkey")
    return a.join(b, (c("l_orderkey") == c("k")) & (c("l_linenumber") == c("m"))).select("l_orderkey", "l_linenumber", "l_partkey")


@query("join_null_keys", "WITH t AS (SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey) SELECT count(*) AS n FROM t a JOIN t b ON a.o_orderkey = b.o_orderkey")
def _(spark, d):
    o = scan(spark, d, "orders", None, c("o_totalprice") > 300000)
    t = scan(spark, d, "customer").join(o, c("c_custkey") == c("o_custkey"), "left").select("o_orderkey")
    return t.join(t.withColumnRenamed("o_orderkey", "k"), c("o_orderkey") == c("k")).agg(F.count("*").alias("n"))


@query("join_merge", "SELECT s_suppkey, count(*) AS n FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey")
def _(spark, d):
    return scan(spark, d, "supplier").hint("merge").join(scan(spark, d, "lineitem"), c("s_suppkey") == c("l_suppkey")).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("join_theta", "SELECT a.n_nationkey AS lo, b.n_nationkey AS hi FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
def _(spark, d):
    n = scan(spark, d, "nation", ["n_nationkey", "n_regionkey"])  # a fixed table of 25 rows
    b = F.broadcast(n.toDF("hi", "r2"))
    return n.toDF("lo", "r1").join(b, (c("lo") < c("hi")) & (c("r1") != c("r2"))).select("lo", "hi")


@query("join_range", "SELECT p_partkey, count(*) AS n FROM part JOIN customer ON c_acctbal BETWEEN p_retailprice - 5 AND p_retailprice + 5 GROUP BY p_partkey")
def _(spark, d):
    bands = scan(spark, d, "part").select("p_partkey", (c("p_retailprice") - 5).alias("lo"), (c("p_retailprice") + 5).alias("hi"))
    return range_join(scan(spark, d, "customer", ["c_acctbal"]), bands, "c_acctbal", "lo", "hi", 10).groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("join_salted", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(spark, d):
    cu = scan(spark, d, "customer").select("c_custkey", c("c_nationkey").alias("k"))
    n = scan(spark, d, "nation").select(c("n_nationkey").alias("k"), "n_name")
    return salted_join(cu, n, "k").groupBy("n_name").agg(F.count("*").alias("n"))


@query("join_where_equi", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = o_orderkey % 25")
def _(spark, d):
    return scan(spark, d, "orders").join(scan(spark, d, "customer"), c("o_custkey") == c("c_custkey")).where(c("c_nationkey") == c("o_orderkey") % 25).select("o_orderkey", "c_name")


@query("join_semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(spark, d):
    o = scan(spark, d, "orders", ["o_custkey"], c("o_totalprice") > 200000)
    return scan(spark, d, "customer", ["c_custkey"]).join(o, c("c_custkey") == c("o_custkey"), "left_semi")


@query("join_anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(spark, d):
    return not_in(scan(spark, d, "customer", ["c_custkey"]), scan(spark, d, "orders", ["o_custkey"], c("o_totalprice") > 400000), "c_custkey", "o_custkey")


@query("not_in_null_list", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN c_custkey > 0 THEN NULL ELSE c_custkey END FROM customer)")
def _(spark, d):
    nulls = scan(spark, d, "customer").select(F.when(c("c_custkey") > 0, None).otherwise(c("c_custkey")).alias("k"))
    return not_in(scan(spark, d, "nation", ["n_nationkey"]), nulls, "n_nationkey", "k")


@query("exists_corr", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def _(spark, d):
    li = scan(spark, d, "lineitem", ["l_suppkey"], c("l_quantity") > 49)
    return scan(spark, d, "supplier", ["s_suppkey"]).join(li, c("s_suppkey") == c("l_suppkey"), "left_semi")


@query("not_exists_corr", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(spark, d):
    return anti(scan(spark, d, "customer", ["c_custkey", "c_name"]), scan(spark, d, "orders", None, c("o_totalprice") > 400000), "c_custkey", "o_custkey")


@query("exists_uncorr", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20)")
def _(spark, d):
    spark_view = scan(spark, d, "nation", None, c("n_nationkey") > 20).select(F.lit(1).alias("one")).limit(1)  # one row
    return scan(spark, d, "region").join(F.broadcast(spark_view), F.lit(True), "left_semi").select("r_name")


@query("exists_empty", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey < 0)")
def _(spark, d):
    none = scan(spark, d, "nation", None, c("n_nationkey") < 0).select(F.lit(1).alias("one")).limit(1)
    return scan(spark, d, "region").join(F.broadcast(none), F.lit(True), "left_semi").select("r_name")


@query("in_corr", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = o_orderkey % 25)")
def _(spark, d):
    cu = scan(spark, d, "customer", ["c_custkey", "c_nationkey"])
    return scan(spark, d, "orders", ["o_orderkey", "o_custkey"]).join(cu, (c("o_custkey") == c("c_custkey")) & (c("c_nationkey") == c("o_orderkey") % 25), "left_semi").select("o_orderkey")


@query("not_in_corr", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = o_orderkey % 25)")
def _(spark, d):
    cu = scan(spark, d, "customer", ["c_custkey", "c_nationkey"])
    return scan(spark, d, "orders", ["o_orderkey", "o_custkey"]).join(cu, (c("o_custkey") == c("c_custkey")) & (c("c_nationkey") == c("o_orderkey") % 25), "left_anti").select("o_orderkey")


@query("scalar_subquery", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > (SELECT avg(l_quantity) FROM lineitem)")
def _(spark, d):
    scan(spark, d, "lineitem").createOrReplaceTempView("tessera_lineitem")
    return spark.sql("SELECT count(*) AS n FROM tessera_lineitem WHERE l_quantity > (SELECT avg(l_quantity) FROM tessera_lineitem)")


@query("derived_table", "SELECT status, n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus) a WHERE n > 10")
def _(spark, d):
    a = scan(spark, d, "orders").groupBy(c("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).alias("a")
    return a.where(c("a.n") > 10).select("a.status", "a.n")


@query("cte_chain", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")
def _(spark, d):
    big = scan(spark, d, "orders", ["o_custkey"], c("o_totalprice") > 100000)
    per = big.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return per.groupBy("n").agg(F.count("*").alias("customers"))
