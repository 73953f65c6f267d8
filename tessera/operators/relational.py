"""Joins, ordering, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(df: DataFrame, *keys: tuple[str, str] | str) -> DataFrame:
    """Total order with the engine's null places: last when ascending, first when descending."""
    out = []
    for k in keys:
        name, way = (k, "asc") if isinstance(k, str) else k
        out.append(F.col(name).asc_nulls_last() if way == "asc" else F.col(name).desc_nulls_first())
    return df.orderBy(*out)


def top(df: DataFrame, n: int, *keys: tuple[str, str] | str) -> DataFrame:
    """The first n rows of an order: partial top lists per task, merged (no full sort)."""
    return ordered(df, *keys).limit(n)


def anti(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """Rows of left without a partner: a shuffled anti join on keys known not to be null."""
    r = right.select(F.col(right_key or key).alias("__k"))
    return left.join(r, left[key] == r["__k"], "left_anti")


def not_in(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """SQL's null-aware NOT IN without a broadcast of the list.

    A null in a non-empty list lets nothing pass; a null key passes only if the list is empty. Both facts
    come from one aggregated row; the rest is an ordinary anti join.
    """
    r = right.select(F.col(right_key).alias("__k"))
    facts = r.agg(F.count("*").alias("__n"), F.count_if(F.col("__k").isNull()).alias("__nulls"))
    kept = left.join(r, left[key] == r["__k"], "left_anti").crossJoin(F.broadcast(facts))  # one row
    return kept.where((F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(key).isNotNull())).drop("__n", "__nulls")


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, coarse: int = 256) -> DataFrame:
    """Inner join of points with the ranges [low, high] that hold them, on cells of `width`: an equi-join, not a nested loop.

    Ranges of more than `coarse` cells meet points on cells `coarse` times as wide.
    """
    wide = (F.col(high) - F.col(low)) / width > coarse

    def on(r: DataFrame, cell: float) -> DataFrame:
        p = points.withColumn("__cell", F.floor(F.col(at) / cell))
        r = r.where(F.col(low) <= F.col(high)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))))
        return p.join(r, "__cell").where(F.col(at).between(F.col(low), F.col(high))).drop("__cell")

    return on(ranges.where(~wide), width).unionByName(on(ranges.where(wide), width * coarse))


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Inner equi-join whose big side has hot keys: its rows spread over `salts` sub-keys, the other side is repeated for each."""
    b = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    s = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, [key, "__salt"]).drop("__salt")


def set_chain(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """Left-associative chain of set operations, by position."""
    ops = {
        "union all": DataFrame.unionAll,
        "union": lambda a, b: a.unionAll(b).distinct(),
        "intersect": DataFrame.intersect,
        "intersect all": DataFrame.intersectAll,
        "except": DataFrame.subtract,
        "except all": DataFrame.exceptAll,
    }
    return reduce(lambda a, x: ops[x[0]](a, x[1]), rest, first)


def having(df: DataFrame, keys: list[str], aggregates: dict[str, Column], condition: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]).where(condition)
