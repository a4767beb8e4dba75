"""Broadcasts whose size has been looked at, and positions in an order without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxis import storage

#: Rows of a frame that is broadcast at most; cameras have a few hundred bytes.
BROADCAST_ROWS = 100_000
#: Rows that one task numbers.
ONE_TASK_ROWS = 200_000


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``frame``, to be broadcast if it has ``rows`` rows at most; beyond that joins shuffle it."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def numbered(frame: DataFrame, *order: str, name: str = "position", rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Adds each row's position, from 0, in an order that must be total.

    Beyond ``rows`` rows they are dealt out by ranges, numbered within each, and moved by what the ranges before hold.
    """
    if frame.limit(rows + 1).count() <= rows:
        return frame.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    ranged = storage.materialize(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own: Column = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    moved = ranged.withColumn("_own", own).join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    return moved.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before")
