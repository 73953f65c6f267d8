"""Recursive queries as a set fixpoint."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

MERGE = 8  # rounds kept apart before they become one table


def fixpoint(anchor: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """WITH RECURSIVE under UNION: anchor, then step(new rows) until no new row appears, however many rounds that takes.

    Semi-naive: each round sees only the rows the last one added, and drops those seen before by
    one null-safe anti join. Every round ends in a table in the folder of spark.checkpoint.dir,
    so plans stay short and executors may be lost; MERGE tables of a size become one, so that a
    round reads a number of tables that grows with the logarithm of the rounds.
    """
    spark = anchor.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or (os.path.join(tempfile.gettempdir(), "tessera-checkpoints") if spark.sparkContext.master.startswith("local") else None)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"{base.rstrip('/')}/fixpoint-{uuid.uuid4().hex}"
    schema = StructType([StructField(f.name, f.dataType, True) for f in anchor.schema])
    names = [f"c{k}" for k in range(len(schema))]
    inner = StructType([StructField(n, f.dataType, True) for n, f in zip(names, schema)])
    made = 0

    def keep(df: DataFrame) -> str:
        nonlocal made
        made += 1
        df.write.parquet(f"{folder}/{made}")
        return f"{folder}/{made}"

    def load(*paths: str) -> DataFrame:
        return spark.read.schema(inner).parquet(*paths)

    def same(a: str, b: str) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])

    levels: list[list[str]] = [[keep(anchor.to(schema).toDF(*names).distinct())]]
    delta = load(levels[0][0])
    while not delta.isEmpty():
        seen = load(*[x for level in levels for x in level])
        new = step(delta.toDF(*schema.names)).toDF(*schema.names).to(schema).toDF(*names).distinct()
        path = keep(new.alias("new").join(seen.alias("seen"), same("new", "seen"), "left_anti"))
        delta = load(path)
        levels[0].append(path)
        at = 0
        while len(levels[at]) >= MERGE:
            if at + 1 == len(levels):
                levels.append([])
            levels[at + 1].append(keep(load(*levels[at]).coalesce(max(1, 2**at))))
            levels[at] = []
            at += 1
    return load(*[x for level in levels for x in level]).toDF(*schema.names)
