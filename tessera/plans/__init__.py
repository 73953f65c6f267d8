"""Plan inspection and statistics."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explain(df: DataFrame, mode: str = "cost") -> str:
    """The plan as text: operators, row and size estimates."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def statistics(df: DataFrame) -> dict:
    """Exact row count and number of distinct values (nulls aside) per column; each column is one job that reads it alone."""
    distinct = {c: df.select(F.col(f"`{c}`").alias("v")).where("v is not null").distinct().count() for c in df.columns}
    return {"rows": df.count(), "distinct": distinct}


def shuffles(df: DataFrame) -> int:
    """Number of exchanges in the physical plan."""
    return explain(df, "formatted").count("Exchange ")
