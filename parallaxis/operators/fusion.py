"""Fusion of depth maps into one cloud: pixels are lifted and averaged in cells of a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.functions import vectors as V
from parallaxis.operators import geometry, sizes


def lifted(depths: DataFrame, cameras: DataFrame, focal: float, cx: float, cy: float) -> DataFrame:
    """(image_id, X, Y, Z): world positions of pixels with a depth."""
    met = depths.filter("depth is not null").join(sizes.small(cameras), "image_id")
    d = F.col("depth")
    cam = [(F.col("x") - cx) / focal * d - F.col("t0"), (F.col("y") - cy) / focal * d - F.col("t1"), d - F.col("t2")]
    world = V.matvec(V.transpose(geometry.columns(*geometry.R)), cam)
    return met.select("image_id", *(w.alias(n) for w, n in zip(world, "XYZ")))


def fuse(points: DataFrame, cell: float, least: int = 1) -> DataFrame:
    """(gx, gy, gz, X, Y, Z, n, views): the mean of each grid cell that ``least`` views reach.

    Sums are combined before the shuffle, so a dense cell costs one row a task.
    """
    at = [F.floor(F.col(c) / cell).alias(g) for c, g in zip("XYZ", ("gx", "gy", "gz"))]
    by_view = points.groupBy(*at, "image_id").agg(*(F.sum(c).alias(c) for c in "XYZ"), F.count(F.lit(1)).alias("n"))
    cells = by_view.groupBy("gx", "gy", "gz").agg(*(F.sum(c).alias(c) for c in "XYZ"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("views"))
    return cells.filter(F.col("views") >= least).select("gx", "gy", "gz", *((F.col(c) / F.col("n")).alias(c) for c in "XYZ"), "n", "views")
