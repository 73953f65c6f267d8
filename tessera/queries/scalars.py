"""Scalar functions, casts, vectors, windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cast_boolean, cast_date, cast_vector, epoch_to_date, l2_distance, round_half_away, trim_space
from ..operators.vector import knn
from ..operators.window import ranking, spec
from ..sources import literal_row, scan
from .registry import query

c = F.col


@query("arith", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity % 7 AS m, -l_quantity AS neg, l_quantity / 4 AS q4, l_quantity + l_linenumber - 1 AS s FROM lineitem")
def _(spark, d):
    return scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax"))).alias("charge"), (c("l_quantity") % 7).alias("m"), (-c("l_quantity")).alias("neg"), (c("l_quantity") / 4).alias("q4"), (c("l_quantity") + c("l_linenumber") - 1).alias("s"))


@query("cast_types", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS txt, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_custkey AS VARCHAR) AS DOUBLE) AS f FROM orders")
def _(spark, d):
    return scan(spark, d, "orders").select("o_orderkey", c("o_totalprice").cast("long").alias("whole"), c("o_orderkey").cast("string").alias("txt"), c("o_orderdate").cast("date").alias("day"), c("o_custkey").cast("string").cast("double").alias("f"))


@query("cast_texts", "SELECT true AS yes, false AS none, DATE '2026-05-20' AS day, DATE '1970-01-01' AS early, DATE '2001-09-09' AS late, [CAST(1 AS FLOAT), CAST(2.5 AS FLOAT)] AS v, CAST(12 AS BIGINT) AS n")
def _(spark, d):
    return literal_row(spark, yes=cast_boolean(F.lit("Yes")), none=cast_boolean(F.lit("")), day=cast_date(F.lit("2026-05-20")), early=epoch_to_date(F.lit(-5)), late=epoch_to_date(F.lit(1000000000)), v=cast_vector(F.lit("[1, 2.5]"), 2), n=F.lit("12").cast("long"))


@query("str_funcs", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, regexp_replace(concat(' ', chr(9), c_name, chr(10)), '^\\s+|\\s+$', '', 'g') AS t FROM customer")
def _(spark, d):
    return scan(spark, d, "customer").select("c_custkey", F.upper("c_name").alias("u"), F.lower("c_mktsegment").alias("l"), F.length("c_name").cast("long").alias("n"), trim_space(F.concat(F.lit(" \t"), "c_name", F.lit("\n"))).alias("t"))


@query("num_funcs", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 0) AS r FROM customer")
def _(spark, d):
    return scan(spark, d, "customer").select("c_custkey", F.abs("c_acctbal").alias("a"), round_half_away("c_acctbal").alias("r"))


@query("coalesce", "SELECT c_custkey, coalesce(o_orderkey, -1) AS k FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey")
def _(spark, d):
    o = scan(spark, d, "orders", ["o_custkey", "o_orderkey"], c("o_totalprice") > 200000)
    return scan(spark, d, "customer").join(o, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("k"))


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@query("vector_l2", "SELECT a.vec_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dist FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def _(spark, d):
    e = scan(spark, d, "embeddings")
    one = e.where(c("vec_id") == 0).select(c("embedding").alias("q")).limit(1)  # one row
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(l2_distance("embedding", "q"), 6).alias("dist"))


@query("knn_topk", f"SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[])), 6) AS dist FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[])), vec_id LIMIT 10")
def _(spark, d):
    e = scan(spark, d, "embeddings")
    row = e.where(c("vec_id") == 0).select("embedding").first()
    return knn(e.select("vec_id", "embedding"), "embedding", list(row["embedding"]), 10, "vec_id").select("vec_id", F.round("dist", 6).alias("dist"))


@query("win_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
def _(spark, d):
    return scan(spark, d, "orders").select("o_orderkey", F.row_number().over(ranking(["o_custkey"], [c("o_totalprice").desc(), "o_orderkey"])).cast("long").alias("rn"))


@query("win_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r FROM lineitem")
def _(spark, d):
    return scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.rank().over(ranking(["l_suppkey"], ["l_quantity"])).cast("long").alias("r"))


@query("win_dense_rank", "SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r FROM lineitem")
def _(spark, d):
    return scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.dense_rank().over(ranking(["l_suppkey"], ["l_quantity"])).cast("long").alias("r"))


@query("win_running_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS s FROM events")
def _(spark, d):
    return scan(spark, d, "events").select("event_id", F.round(F.sum("value").over(spec(["user_id"], ["ts", "event_id"])), 4).alias("s"))


@query("win_partition_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS a FROM orders")
def _(spark, d):
    w = spec(["o_custkey"])
    return scan(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("s"), F.round(F.avg("o_totalprice").over(w), 6).alias("a"))


@query("win_sliding_avg", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS a FROM orders")
def _(spark, d):
    return scan(spark, d, "orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(spec(["o_custkey"], ["o_orderdate", "o_orderkey"], rows=(-1, 1))), 4).alias("a"))


@query("win_following_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2) AS s FROM orders")
def _(spark, d):
    return scan(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(spec(["o_custkey"], ["o_orderkey"], rows=(W.currentRow, W.unboundedFollowing))), 2).alias("s"))


@query("win_range", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part")
def _(spark, d):
    return scan(spark, d, "part").select("p_partkey", F.sum("p_size").over(spec(["p_brand"], ["p_size"], span=(-5, 0))).alias("s"))
