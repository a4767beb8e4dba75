"""Tracks, covisibility and source-view selection over ``observations(point_id, image_id, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxis import storage
from parallaxis.functions import vectors as V

#: The scoring range of baselines in degrees, and where the score stops growing.
MIN_BASELINE, BEST_BASELINE, MAX_BASELINE = 5.0, 30.0, 90.0
#: Observations for each partition in which images are paired and pairs counted.
PART_ROWS = 500_000
#: Fixed value: places on the ring between images whose matches count.
RING = 5
#: Depth range percentiles and margins, and the margins about the centroid for fewer than two points.
LOW, HIGH, LOW_MARGIN, HIGH_MARGIN, FEW_LOW, FEW_HIGH = 0.05, 0.95, 0.5, 1.5, 0.3, 3.0


def observation_index(observations: DataFrame) -> DataFrame:
    """(image_id, kp_id) → point_id; the last writer, the largest point, wins."""
    return observations.groupBy("image_id", "kp_id").agg(F.max("point_id").alias("point_id"))


def covisibility(observations: DataFrame) -> DataFrame:
    """(image_i, image_j, shared): points that both images see, i < j.

    Images of a point meet in a sorted join, so no task holds lists or their pairs; pairs are counted where they are
    brought together, as hardly any repeats within a task before. Partitions are as many as the rows ask for, so what a
    task counts does not grow with the input.
    """
    parts = observations.count() // PART_ROWS + 1
    seen = observations.select("point_id", "image_id").filter("point_id is not null and image_id is not null").repartition(parts, "point_id").distinct()
    other = seen.select("point_id", F.col("image_id").alias("image_j"))
    met = seen.withColumnRenamed("image_id", "image_i").join(other.hint("merge"), "point_id").filter("image_i < image_j")
    return met.select("image_i", "image_j").repartition(parts, "image_i", "image_j").groupBy("image_i", "image_j").agg(F.count(F.lit(1)).alias("shared"))


def neighbours(images: DataFrame, n: int, reach: int = RING, ids: tuple[int, int] | None = None) -> DataFrame:
    """Adds ``other``: ids at most ``reach`` places away on a ring of n, whether there are such images or not.

    With ``ids``, the smallest and largest id that there is, no others.
    """
    offset = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.array(k, k - n, k + n))
    others = F.transform(F.array_distinct(F.flatten(offset)), lambda k: F.col("image_id") + k)
    if ids is not None:
        others = F.filter(others, lambda i: i.between(*ids))
    return images.withColumn("other", F.explode(others)).filter("other <> image_id")


def correspondences(matches: DataFrame, index: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """(image_id, kp_id, point_id): the point that a keypoint's match in another image observes.

    ``matches(image_id, kp_id, other, kp_other)`` meet ``index(image_id, kp_id, point_id)`` on the other image and its
    keypoint, of ``registered(image_id)`` images only if those are given. The first image, then point, wins.
    """
    seen = index if registered is None else index.join(registered.select("image_id").distinct(), "image_id", "left_semi")
    seen = seen.select(F.col("image_id").alias("other"), F.col("kp_id").alias("kp_other"), "point_id")
    first = F.min(F.struct("other", "point_id"))
    return matches.join(seen, ["other", "kp_other"]).groupBy("image_id", "kp_id").agg(first.alias("first")).select("image_id", "kp_id", F.col("first.point_id").alias("point_id"))


def first_wins(observations: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; minima are combined before the shuffle."""
    rest = [c for c in observations.columns if c not in (key, *order)]
    return observations.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("first")).select(key, "first.*")


def untracked(new: DataFrame, tracked: DataFrame) -> DataFrame:
    """Rows whose (image_id, kp_id) no tracked row has."""
    return new.join(tracked.select("image_id", "kp_id"), ["image_id", "kp_id"], "left_anti")


def grown(matches: DataFrame, tracked: DataFrame) -> DataFrame:
    """Matches (image_i, kp_i, image_j, kp_j, place) that make new points when they are scanned in order of place.

    Neither end may be tracked, nor be taken by an earlier new point. Rounds take all matches that are the first at both
    of their ends and drop the others of those ends, which is what the scan does.
    """
    ends = lambda m: m.select(F.col("image_i").alias("image_id"), F.col("kp_i").alias("kp_id"), "place").unionByName(m.select(F.col("image_j").alias("image_id"), F.col("kp_j").alias("kp_id"), "place"))

    def without(m: DataFrame, used: DataFrame) -> DataFrame:
        for side in ("i", "j"):
            own = used.select(F.col("image_id").alias(f"image_{side}"), F.col("kp_id").alias(f"kp_{side}"))
            m = m.join(own, [f"image_{side}", f"kp_{side}"], "left_anti")
        return m

    left, taken = storage.materialize(without(matches, tracked), "matches"), None
    while not left.isEmpty():
        first = ends(left).groupBy("image_id", "kp_id").agg(F.min("place").alias("place"))
        won = first.groupBy("place").agg(F.count(F.lit(1)).alias("ends")).filter("ends = 2").select("place")
        now = storage.materialize(left.join(won, "place", "left_semi"), "new-points")
        taken = now if taken is None else taken.unionByName(now)
        left, before = storage.materialize(without(left.join(won, "place", "left_anti"), ends(now)), "matches"), left
        storage.drop(before)
    return taken if taken is not None else left


def without_images(points: DataFrame, observations: DataFrame, images: DataFrame) -> DataFrame:
    """Points that none of ``images(image_id)`` sees."""
    seen = observations.join(images.select("image_id"), "image_id", "left_semi").select("point_id")
    return points.join(seen, "point_id", "left_anti")


def lowest(frame: DataFrame, key: str, value: str, ident: str) -> DataFrame:
    """(key, ident, value) of each key's lowest value, ties to the lowest ident; nulls take no part."""
    best = frame.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min(F.struct(value, ident)).alias("b"))
    return best.select(key, F.col(f"b.{ident}").alias(ident), F.col(f"b.{value}").alias(value))


def strongest(frame: DataFrame, key: str, value: str, ident: str, n: int) -> DataFrame:
    """(key, ident, place): each key's n rows of highest value, numbered from 1 in order of ident."""
    strong = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_first(value), ident))
    kept = frame.withColumn("rn", strong).filter(F.col("rn") <= n)
    return kept.select(key, ident, F.row_number().over(Window.partitionBy(key).orderBy(ident)).cast("long").alias("place"))


def start_pairs(pairs: DataFrame, least: int, n: int) -> DataFrame:
    """The n pairs (image_i, image_j, num_inliers) of most inliers."""
    return pairs.filter(F.col("num_inliers") >= least).orderBy(F.desc("num_inliers"), "image_i", "image_j").limit(n)


def best_pair(scored: DataFrame) -> DataFrame:
    """The pair of highest score, ties to the first."""
    return scored.orderBy(F.desc("score"), "image_i", "image_j").limit(1)


def baseline_score(degrees: Column) -> Column:
    bounded = F.greatest(F.lit(MIN_BASELINE), F.least(F.lit(BEST_BASELINE), degrees))
    return F.when((degrees < MIN_BASELINE) | (degrees > MAX_BASELINE), 0.0).otherwise(F.sin(F.radians(bounded)))


def baseline_angle(a: V.Components, b: V.Components, about: V.Components) -> Column:
    """Degrees between two camera centres seen from a point."""
    return V.angle3([x - c for x, c in zip(a, about)], [x - c for x, c in zip(b, about)])


def top_sources(scored: DataFrame, n: int) -> DataFrame:
    """The n best ``src_id`` of each ``ref_id`` by score, ties to the smaller id; ranks from 1."""
    best = F.row_number().over(Window.partitionBy("ref_id").orderBy(F.desc("score"), "src_id"))
    return scored.withColumn("rank", best).filter(F.col("rank") <= n)


def source_candidates(pairs: DataFrame) -> DataFrame:
    """Both directions of ``pairs(image_i, image_j, shared, baseline_deg)`` with positive score and shared points."""
    one = pairs.select(F.col("image_i").alias("ref_id"), F.col("image_j").alias("src_id"), "shared", "baseline_deg")
    two = pairs.select(F.col("image_j").alias("ref_id"), F.col("image_i").alias("src_id"), "shared", "baseline_deg")
    scored = one.unionByName(two).withColumn("score", baseline_score(F.col("baseline_deg")) * F.col("shared"))
    return scored.filter((F.col("shared") > 0) & (F.col("score") > 0))


def ordered(frame: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, place, n): each value's place, from 0, in its key's order, and how many the key has.

    A ranking window sorts and spills; no key's values are gathered into one row.
    """
    own = frame.select(key, value).filter(F.col(value).isNotNull())
    place = F.row_number().over(Window.partitionBy(key).orderBy(value)) - 1
    return own.withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))


def _at(place: Column, value: str) -> Column:
    return F.max(F.when(F.col("place") == place, F.col(value)))


def depth_range(depths: DataFrame, key: str, depth: str) -> DataFrame:
    """Per key, widened low and high percentiles by floor index of the sorted depths."""
    low = F.floor(F.col("n") * LOW)
    high = F.least(F.floor(F.col("n") * HIGH), F.col("n") - 1)
    found = ordered(depths, key, depth).groupBy(key).agg(F.max("n").alias("n"), F.avg(depth).alias("mean"), _at(low, depth).alias("low"), _at(high, depth).alias("high"))
    few = F.col("n") < 2
    return found.select(
        key,
        F.when(few, F.col("mean") * FEW_LOW).otherwise(F.col("low") * LOW_MARGIN).alias("depth_min"),
        F.when(few, F.col("mean") * FEW_HIGH).otherwise(F.col("high") * HIGH_MARGIN).alias("depth_max"),
    )


def upper_median(frame: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): sorted[n / 2], the upper one of two middle values."""
    return ordered(frame, key, value).groupBy(key).agg(_at(F.floor(F.col("n") / 2), value).alias("median"))


def lowest_mean(frame: DataFrame, key: str, value: str, k: int = 3) -> DataFrame:
    """(key, cost): mean of the k lowest, or of all if there are fewer."""
    low = F.row_number().over(Window.partitionBy(key).orderBy(value))
    kept = frame.select(key, value).filter(F.col(value).isNotNull()).withColumn("rn", low).filter(F.col("rn") <= k)
    return kept.groupBy(key).agg(F.avg(value).alias("cost"))
