"""Windows with the engine's default frame: ROWS from the partition's start to the current row if there is an order, else the whole partition."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql.window import WindowSpec


def spec(partition: list | None = None, order: list | None = None, rows: tuple[int, int] | None = None, span: tuple[int, int] | None = None) -> WindowSpec:
    """partition and order keys; rows: a ROWS frame; span: a true RANGE frame."""
    w = Window.partitionBy(*(partition or []))
    if order:
        w = w.orderBy(*order)
    if span is not None:
        return w.rangeBetween(*span)
    if rows is not None:
        return w.rowsBetween(*rows)
    if order:
        return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def ranking(partition: list | None, order: list) -> WindowSpec:
    """For row_number, rank and dense_rank; they need an order."""
    if not order:
        raise ValueError("ranking functions need ORDER BY")
    return Window.partitionBy(*(partition or [])).orderBy(*order)
