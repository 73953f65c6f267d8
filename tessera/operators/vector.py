"""Exact nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import l2_to
from .relational import top


def knn(df: DataFrame, column: str, query: list[float], k: int, id_column: str, as_name: str = "dist") -> DataFrame:
    """The k rows nearest to `query` by Euclidean distance, ties by id: one scan with partial top lists."""
    return top(df.withColumn(as_name, l2_to(column, query)), k, as_name, id_column)
