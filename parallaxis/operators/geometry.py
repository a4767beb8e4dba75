"""Projection, reprojection statistics, point filters, depth-map consistency and small least-squares fits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallaxis import storage
from parallaxis.functions import vectors as V
from parallaxis.operators import sizes

R = [f"r{k}" for k in range(9)]
T = ["t0", "t1", "t2"]
#: Relative depth tolerance, and views that must agree, of the depth filter.
DEPTH_TOLERANCE, MIN_CONSISTENT = 0.12, 2
#: Fixed value: decimals of a moved pixel that count.
DECIMALS = 6
#: Fixed value: the error of an observation behind its camera, in the penalised mean.
BEHIND = 999.0
#: Error limits of successive filtering rounds, and the shortest track kept.
ROUNDS, MIN_TRACK = (1.5, 1.0, 0.75), 2


def columns(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def camera_frame(point: V.Components) -> list[Column]:
    """R X + t over columns r0..r8 and t0..t2."""
    return [x + t for x, t in zip(V.matvec(columns(*R), point), columns(*T))]


def centre() -> list[Column]:
    """-R' t."""
    return [-x for x in V.matvec(V.transpose(columns(*R)), columns(*T))]


def pixel(cam: V.Components, focal: float, cx: float, cy: float) -> tuple[Column, Column]:
    return focal * cam[0] / cam[2] + cx, focal * cam[1] / cam[2] + cy


def reprojected(observations: DataFrame, points: DataFrame, cameras: DataFrame, focal: float, cx: float, cy: float) -> DataFrame:
    """Adds z and error to ``observations(point_id, image_id, u, v)``; cameras are few and joined by image."""
    met = observations.join(points, "point_id").join(cameras, "image_id")
    cam = camera_frame(columns("x", "y", "z"))
    u, v = pixel(cam, focal, cx, cy)
    error = F.sqrt((u - F.col("u")) ** 2 + (v - F.col("v")) ** 2)
    return met.select("point_id", "image_id", cam[2].alias("depth"), F.when(cam[2] > 0, error).alias("error"))


def mean_error(errors: DataFrame) -> DataFrame:
    """One row: the mean over observations in front of their cameras, 0 if there are none."""
    return errors.agg(F.coalesce(F.avg("error"), F.lit(0.0)).alias("mean_error"))


def point_errors(errors: DataFrame) -> DataFrame:
    """(point_id, mean_error, track): observations behind a camera count for the track but not for the mean."""
    return errors.groupBy("point_id").agg(F.coalesce(F.avg("error"), F.lit(0.0)).alias("mean_error"), F.count(F.lit(1)).alias("track"))


def penalised_errors(errors: DataFrame) -> DataFrame:
    """As ``point_errors``, but an observation behind its camera has the error ``BEHIND``."""
    return errors.groupBy("point_id").agg(F.avg(F.coalesce("error", F.lit(BEHIND))).alias("mean_error"), F.count(F.lit(1)).alias("track"))


def in_front(*depths: str, least: float = 0.0) -> Column:
    """Whether a point lies before all cameras that these depths are of."""
    return reduce(lambda a, b: a & b, (F.col(d) > least for d in depths))


def filter_rounds(points: DataFrame, scored: Callable[[DataFrame], DataFrame], adjusted: Callable[[DataFrame], DataFrame] | None = None, limits: tuple[float, ...] = ROUNDS, min_track: int = MIN_TRACK) -> DataFrame:
    """Drops points by limits that tighten, until a round drops none.

    ``scored(points)`` gives (point_id, mean_error, track), ``adjusted(points)`` the points moved to where they fit best
    before each round.
    """
    points = storage.materialize(points, "points")
    for limit in limits:
        moved = points if adjusted is None else storage.materialize(adjusted(points), "points")
        good = filter_points(scored(moved), limit, min_track).select("point_id")
        kept = storage.materialize(moved.join(good, "point_id", "left_semi"), "points")
        done = kept.count() == moved.count()
        storage.drop(*{id(f): f for f in (points, moved)}.values())
        points = kept
        if done:
            break
    return points


def filter_points(scored: DataFrame, limit: float, min_track: int = MIN_TRACK) -> DataFrame:
    return scored.filter((F.col("mean_error") <= limit) & (F.col("track") >= min_track))


def _nearest(scaled: str) -> Column:
    """The pixel of a coordinate times ten to ``DECIMALS``: half away from zero at the last decimal, then half to even."""
    s, r = F.col(scaled), F.rint(scaled)
    return F.rint(F.when(F.abs(s - r) == 0.5, s + F.signum(s) * 0.5).otherwise(r) / 10**DECIMALS).cast("long")


def consistent_views(depths: DataFrame, cameras: DataFrame, sources: DataFrame, focal: float, cx: float, cy: float, tolerance: float = DEPTH_TOLERANCE) -> DataFrame:
    """(image_id, x, y, depth, views): source views whose depth map agrees with each reference pixel.

    A pixel is lifted, moved into each of its sources and rounded to ``DECIMALS``, then half to even, so that places between
    two pixels do not depend on the last digits of a sine; the depth found there agrees if it is within ``tolerance`` of the
    moved depth, relative to it. One equi-join on (image, x, y), all views at once.
    """
    ref = cameras.select(F.col("image_id"), *(F.col(c).alias(f"a{c}") for c in [*R, *T]))
    src = cameras.select(F.col("image_id").alias("src_id"), *R, *T)
    # step by step, or every use of a coordinate would spell out all that it is made of
    lifted = depths.join(sizes.small(ref), "image_id")
    d = F.col("depth")
    at = {"at_x": (F.col("x") - cx) / focal * d - F.col("at0"), "at_y": (F.col("y") - cy) / focal * d - F.col("at1"), "at_z": d - F.col("at2")}
    world = V.matvec(V.transpose(columns(*(f"a{r}" for r in R))), columns(*at))
    lifted = lifted.withColumns(at).select("image_id", "x", "y", *(w.alias(f"w{k}") for k, w in enumerate(world)))
    moved = lifted.join(sources, "image_id").join(sizes.small(src), "src_id").withColumns({f"c{k}": c for k, c in enumerate(camera_frame(columns("w0", "w1", "w2")))}).filter("c2 > 0")
    u, v = pixel(columns("c0", "c1", "c2"), focal, cx, cy)
    moved = moved.select("image_id", "x", "y", "src_id", F.col("c2").alias("z"), (u * 10**DECIMALS).alias("su"), (v * 10**DECIMALS).alias("sv"))
    moved = moved.select("image_id", "x", "y", "src_id", "z", _nearest("su").alias("sx"), _nearest("sv").alias("sy"))
    other = depths.select(F.col("image_id").alias("src_id"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("depth").alias("found"))
    agree = moved.join(other, ["src_id", "sx", "sy"]).filter(F.abs(F.col("found") - F.col("z")) <= tolerance * F.col("z"))
    counted = agree.groupBy("image_id", "x", "y").agg(F.countDistinct("src_id").alias("views"))
    return depths.join(counted, ["image_id", "x", "y"], "left").withColumn("views", F.coalesce("views", F.lit(0)))


def filtered_depths(consistent: DataFrame, least: int = MIN_CONSISTENT) -> DataFrame:
    """Depths that too few views confirm become null."""
    return consistent.withColumn("depth", F.when(F.col("views") >= least, F.col("depth")))


def retention(filtered: DataFrame) -> DataFrame:
    """(image_id, kept, total) for each view, and with a null image_id for all."""
    return filtered.rollup("image_id").agg(F.count("depth").alias("kept"), F.count(F.lit(1)).alias("total"))


def rays_meet(rays: DataFrame, *by: str) -> DataFrame:
    """The point nearest to rays with centres c0..c2 and unit directions d0..d2: sum(I - dd')^-1 sum((I - dd') c)."""
    d, c = columns("d0", "d1", "d2"), columns("c0", "c1", "c2")
    m = [[(1.0 if i == j else 0.0) - d[i] * d[j] for j in range(3)] for i in range(3)]
    sums = [F.sum(m[i][j]).alias(f"m{3 * i + j}") for i in range(3) for j in range(3)]
    right = [F.sum(V.dot3(m[i], c)).alias(f"b{i}") for i in range(3)]
    solved = V.matvec(V.inverse(columns(*(f"m{k}" for k in range(9)))), columns("b0", "b1", "b2"))
    return rays.groupBy(*by).agg(*sums, *right).select(*by, *(x.alias(n) for x, n in zip(solved, "xyz")))


def circle_fit(points: DataFrame, *by: str) -> DataFrame:
    """Linear least squares of x^2 + y^2 = 2 a x + 2 b y + c over columns u, v: centre (a, b) and radius."""
    u, v, w = F.col("u"), F.col("v"), F.col("u") ** 2 + F.col("v") ** 2
    row = [2 * u, 2 * v, F.lit(1.0)]
    sums = [F.sum(row[i] * row[j]).alias(f"m{3 * i + j}") for i in range(3) for j in range(3)]
    right = [F.sum(row[i] * w).alias(f"b{i}") for i in range(3)]
    a, b, c = V.matvec(V.inverse(columns(*(f"m{k}" for k in range(9)))), columns("b0", "b1", "b2"))
    return points.groupBy(*by).agg(*sums, *right).select(*by, a.alias("a"), b.alias("b"), F.sqrt(c + a * a + b * b).alias("radius"))
