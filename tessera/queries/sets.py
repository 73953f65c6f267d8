"""Set operations and recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.recursive import fixpoint
from ..operators.relational import set_chain
from ..sources import scan
from .registry import query

c = F.col
_A, _B = "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'"


def _ab(spark, d):
    a = scan(spark, d, "customer", None, c("c_mktsegment") == "BUILDING").select(c("c_custkey").alias("k"))
    b = scan(spark, d, "orders", None, c("o_orderstatus") == "F").select(c("o_custkey").alias("k"))
    return a, b


def _register(name: str, sql: str, swap: bool = False) -> None:
    first, second = (_B, _A) if swap else (_A, _B)

    @query(name, f"{first} {sql} {second}")
    def run(spark, d):
        a, b = _ab(spark, d)
        a, b = (b, a) if swap else (a, b)
        return set_chain(a, (sql.lower(), b))


_register("union_all", "UNION ALL")
_register("union_distinct", "UNION")
_register("intersect", "INTERSECT")
_register("except", "EXCEPT")
_register("except_all", "EXCEPT ALL", swap=True)


@query("intersect_all", f"{_B} INTERSECT ALL SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def _(spark, d):
    _, b = _ab(spark, d)
    return set_chain(b, ("intersect all", scan(spark, d, "orders", None, c("o_totalprice") > 200000).select(c("o_custkey").alias("k"))))  # both sides repeat keys


# another grouping of the two EXCEPTs, or the first alone, would give other rows
@query("setop_chain", f"({_A} EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000) EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 350000")
def _(spark, d):
    a, _ = _ab(spark, d)
    o = scan(spark, d, "orders")
    return set_chain(a, ("except", o.where("o_totalprice > 450000").select("o_custkey")), ("except", o.where("o_orderpriority = '1-URGENT' and o_totalprice > 350000").select("o_custkey")))


@query("setop_positional", "SELECT n_regionkey AS b, n_nationkey AS a FROM nation UNION SELECT r_regionkey AS x, r_regionkey + 100 AS y FROM region")
def _(spark, d):
    n = scan(spark, d, "nation").select(c("n_regionkey").alias("b"), c("n_nationkey").alias("a"))
    return set_chain(n, ("union", scan(spark, d, "region").select(c("r_regionkey").alias("x"), (c("r_regionkey") + 100).alias("y"))))


@query("cte_recursive", "WITH RECURSIVE t(id, parent) AS (SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey = 1 UNION SELECT n.n_nationkey, n.n_nationkey // 2 FROM nation n JOIN t ON n.n_nationkey // 2 = t.id) SELECT CAST(id AS BIGINT) AS id, CAST(parent AS BIGINT) AS parent FROM t")
def _(spark, d):
    tree = scan(spark, d, "nation").select(c("n_nationkey").cast("long").alias("n"), F.floor(c("n_nationkey") / 2).cast("long").alias("up"))
    anchor = tree.where("n = 1").select(c("n").alias("id"), c("n").alias("parent"))
    return fixpoint(anchor, lambda new: tree.join(new, c("up") == c("id")).select(c("n"), c("up")))


@query("cte_recursive_all", "WITH RECURSIVE t(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")
def _(spark, d):
    return spark.sql("WITH RECURSIVE t(n) AS (SELECT 1L UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")


@query("cte_recursive_graph", "WITH RECURSIVE e AS (SELECT n_nationkey a, n_regionkey b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation), r(k) AS (SELECT CAST(0 AS BIGINT) UNION SELECT CAST(b AS BIGINT) FROM e JOIN r ON a = k) SELECT k FROM r")
def _(spark, d):
    n = scan(spark, d, "nation").select(c("n_nationkey").cast("long").alias("a"), c("n_regionkey").cast("long").alias("b"))
    edges = n.unionAll(n.select("a", ((c("a") * 7 + 3) % 25)))
    return fixpoint(spark.sql("SELECT 0L AS k"), lambda new: edges.join(new, c("a") == c("k")).select("b"))
