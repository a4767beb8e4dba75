"""Semi-joins against ids of any number, by a broadcast whose size is bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallaxis.llm import storage

#: Hash buckets, and so the most numbers that are ever broadcast.
BUCKETS = 1 << 20


def _bucket(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS))


def _hit(ids: DataFrame, columns: list[str], name: str) -> DataFrame:
    return F.broadcast(ids.select(_bucket(columns).alias(name)).distinct())


def thinned(frame: DataFrame, on: list[str], ids: DataFrame, id_columns: list[str] | None = None, how: str = "left_semi") -> DataFrame:
    """Rows of ``frame`` whose key falls into a bucket that a key of ``ids`` falls into: a superset of the semi-join.

    With ``how="left_anti"`` the other rows, none of which has a partner in ``ids``.
    """
    name = storage.fresh(frame.columns, "bucket")
    return frame.withColumn(name, _bucket(on)).join(_hit(ids, id_columns or on, name), name, how).drop(name)
