"""Descriptor matching: exact two nearest neighbours, ratio test, mutual check and pair generation.

Descriptors are rows ``(image_id, kp_id, descriptor)``. Matching packs each image's descriptors into blocks of at most
``BLOCK`` rows, joins blocks of candidate image pairs, and lets numpy rank every pair of blocks; per-block bests are
merged by a grouped sort of at most two rows a block. One image's blocks are dealt out in parts. Mutual neighbours come from one product of two blocks, by rows and
by columns. No descriptor is shuffled more than once for each block that it meets, and no task holds more than two
blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from parallaxis import storage
from parallaxis.operators import sizes

BLOCK = 2048
#: Rows of a block that are ranked at once, and parts into which the blocks of one image pair are dealt.
STRIP, PARTS = 128, 8
#: Blocks of an image that are tried, in turn, to settle that it has enough matches before all of its pairs are matched.
TRIED = (1, 8)
#: Up to this many images all pairs are candidates; beyond it each image meets its next RING neighbours on the ring.
EXHAUSTIVE_IMAGES, RING = 50, 10
#: The sentinel distance where an image has a single descriptor.
NO_SECOND = 1e30
RATIO, MIN_MATCHES = 0.75, 30


def pairs_exhaustive(images: DataFrame) -> DataFrame:
    """All (image_i, image_j) with i < j from ``images(image_id)``."""
    ids = images.select("image_id").distinct()
    return ids.select(F.col("image_id").alias("image_i")).join(ids.select(F.col("image_id").alias("image_j")), F.col("image_i") < F.col("image_j"))


def pairs_sequential(images: DataFrame, n: int, reach: int = RING) -> DataFrame:
    """Ring neighbours of positions 0 to n - 1: each image with the ``reach`` after it, once for each pair."""
    step = images.select("image_id", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("k"))
    other = (F.col("image_id") + F.col("k")) % n
    both = step.select(F.least("image_id", other).alias("image_i"), F.greatest("image_id", other).alias("image_j"))
    return both.filter("image_i <> image_j").distinct()


def candidate_pairs(images: DataFrame, n: int) -> DataFrame:
    return pairs_exhaustive(images) if n <= EXHAUSTIVE_IMAGES else pairs_sequential(images, n)


def ring_distance(a: Column, b: Column, n: Column | int) -> Column:
    return F.least(F.abs(a - b), n - F.abs(a - b))


def _pack(table: pa.Table) -> pa.Table:
    kps = table["kp_id"].to_numpy()
    order = np.argsort(kps, kind="stable")
    column = table["descriptor"].combine_chunks()
    mat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)[order]
    kind = "<f4" if mat.dtype == np.float32 else "<f8"
    return pa.table({
        "image_id": table["image_id"].slice(0, 1), "block": table["block"].slice(0, 1), "kps": pa.array([kps[order].astype("<i8").tobytes()], pa.binary()),
        "kind": pa.array([kind]), "mat": pa.array([mat.astype(kind).tobytes()], pa.binary()),
    })


def packed(descriptors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(image_id, block, kps, kind, mat): each image's descriptors in blocks, floats as floats."""
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("kp_id"))
    blocked = descriptors.select("image_id", "kp_id", "descriptor").withColumn("block", F.floor((place - 1) / block))
    kind = dict(descriptors.dtypes)["image_id"]
    return blocked.groupBy("image_id", "block").applyInArrow(_pack, f"image_id {kind}, block long, kps binary, kind string, mat binary")


def _two_best(near: np.ndarray, q: np.ndarray, r: np.ndarray, kps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the two nearest rows of r for each row of q (one if r has one): near distances choose among
    which the exact ones are taken, ties to the lower id."""
    take, found, named = min(4, len(r)), [], []
    for k in range(0, len(q), STRIP):
        at = np.argpartition(near[k : k + STRIP], take - 1, axis=1)[:, :take]
        exact, ids = ((q[k : k + STRIP, None, :] - r[at]) ** 2).sum(2), kps[at]
        best = np.lexsort((ids, exact), axis=1)[:, :2]
        found.append(np.take_along_axis(exact, best, 1))
        named.append(np.take_along_axis(ids, best, 1))
    return np.concatenate(found), np.concatenate(named)


def _ranked(both: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(n)[k] for n in b.schema.names}
                kq, kr = (np.frombuffer(row[f"kps_{s}"].as_buffer(), "<i8") for s in "qr")
                q, r = (np.frombuffer(row[f"mat_{s}"].as_buffer(), row[f"kind_{s}"].as_py()).astype(np.float64).reshape(n, -1) for s, n in (("q", len(kq)), ("r", len(kr))))
                near = q @ r.T
                near *= -2
                near += (q**2).sum(1)[:, None]
                near += (r**2).sum(1)[None]
                one, other = row["image_q"].as_py(), row["image_r"].as_py()
                sides = [(one, other, kq, _two_best(near, q, r, kr))]
                if both:
                    sides.append((other, one, kr, _two_best(near.T, r, q, kq)))
                for a, o, kps, (d, ids) in sides:
                    n, second = len(kps), d.shape[1] > 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, a, np.int64)), pa.array(np.full(n, o, np.int64)), pa.array(kps), pa.array(d[:, 0]), pa.array(ids[:, 0]), pa.array(d[:, 1]) if second else pa.nulls(n, pa.float64()), pa.array(ids[:, 1]) if second else pa.nulls(n, pa.int64())],
                        names=["image_q", "image_r", "kp_q", "d1", "k1", "d2", "k2"],
                    )

    return run


def knn2(blocks: DataFrame, pairs: DataFrame, both: bool = False, queries: DataFrame | None = None) -> DataFrame:
    """(image_q, image_r, kp_q, idx1, dist1, idx2, dist2): squared distances, ties to the lower kp_id.

    ``pairs(image_q, image_r)`` are ordered pairs; with ``both`` the opposite ones are answered too, from the same
    products. With ``queries``, blocks as well, only those are answered. A reference image with one descriptor gives
    ``NO_SECOND`` and -1.
    """
    side = lambda s: (queries if s == "q" and queries is not None else blocks).select(F.col("image_id").alias(f"image_{s}"), "block", *(F.col(c).alias(f"{c}_{s}") for c in ("kps", "kind", "mat")))
    # few images would be few tasks: blocks of an image meet another image's in parts
    one = pairs.join(side("q").withColumn("part", F.col("block") % PARTS), "image_q").drop("block")
    other = side("r").drop("block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    met = one.join(other, ["image_r", "part"]).drop("part").withColumns({c: F.col(c).cast("long") for c in ("image_q", "image_r")})
    ranked = met.mapInArrow(_ranked(both), "image_q long, image_r long, kp_q long, d1 double, k1 long, d2 double, k2 long")
    two = F.filter(F.array(*(F.struct(F.col(f"d{k}").alias("d2"), F.col(f"k{k}").alias("kp")) for k in (1, 2))), lambda b: b["kp"].isNotNull())
    merged = ranked.groupBy("image_q", "image_r", "kp_q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(two))), 1, 2).alias("best"))
    one, two = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    return merged.select(
        "image_q", "image_r", "kp_q", one["kp"].alias("idx1"), one["d2"].alias("dist1"),
        F.coalesce(two["kp"], F.lit(-1)).alias("idx2"), F.coalesce(two["d2"], F.lit(NO_SECOND)).alias("dist2"),
    )


def passes_ratio(dist1: Column, dist2: Column, ratio: float) -> Column:
    """Squared distances; a second distance of 0 passes, as duplicates do."""
    return (dist2 <= 0) | (dist1 < ratio * ratio * dist2)


def match_pairs(descriptors: DataFrame, pairs: DataFrame, ratio: float = RATIO, block: int = BLOCK) -> DataFrame:
    """(image_i, image_j, kp_i, kp_j, distance) of mutual nearest neighbours that pass the ratio test forwards.

    ``pairs(image_i, image_j)`` are distinct and i < j. An image without descriptors has no matches.
    """
    blocks = packed(descriptors, block)
    forward = pairs.select(F.col("image_i").alias("image_q"), F.col("image_j").alias("image_r"))
    found = knn2(blocks, forward, both=True)
    ahead, kp = F.col("image_q") < F.col("image_r"), lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    # a match and its counterpart name the same images and keypoints, so mutual ones meet in one grouping
    named = found.select(
        F.least("image_q", "image_r").alias("image_i"), F.greatest("image_q", "image_r").alias("image_j"), kp("kp_q", "idx1").alias("kp_i"), kp("idx1", "kp_q").alias("kp_j"),
        F.when(ahead, F.struct(passes_ratio(F.col("dist1"), F.col("dist2"), ratio).alias("ok"), F.sqrt("dist1").alias("distance"))).alias("forwards"),
    )
    met = named.groupBy("image_i", "image_j", "kp_i", "kp_j").agg(F.count(F.lit(1)).alias("sides"), F.max("forwards").alias("forwards"))
    return met.filter("sides = 2 and forwards.ok").select("image_i", "image_j", "kp_i", "kp_j", F.col("forwards.distance").alias("distance"))


def verified_pairs(matches: DataFrame, min_matches: int = MIN_MATCHES) -> DataFrame:
    """(image_i, image_j, num_inliers) of pairs with enough matches."""
    return matches.groupBy("image_i", "image_j").agg(F.count(F.lit(1)).alias("num_inliers")).filter(F.col("num_inliers") >= min_matches)


def observed(pairs: DataFrame) -> tuple[DataFrame, Observation]:
    """``pairs`` as they are, and what the job that computes them will have seen: pairs, inliers, fewest and most of one."""
    stats, n = Observation(), F.col("num_inliers")
    return pairs.observe(stats, F.count(F.lit(1)).alias("pairs"), F.sum(n).alias("inliers"), F.min(n).alias("fewest"), F.max(n).alias("most")), stats


def isolated(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """Images in no pair."""
    seen = pairs.select(F.col("image_i").alias("image_id")).union(pairs.select(F.col("image_j").alias("image_id")))
    return images.select("image_id").distinct().join(seen, "image_id", "left_anti")


def _settled(own: DataFrame, blocks: DataFrame, queries: DataFrame, pairs: DataFrame, enough: int, ratio: float) -> DataFrame:
    """(image_id): images of ``pairs(image_q, image_r)`` whose ``queries`` alone have enough matches; no image is image_r twice.

    Each such match is one of ``match_pairs``: neighbours are looked for in whole images, both ways.
    """
    found = knn2(blocks, pairs, queries=queries)
    ahead = storage.materialize(found.filter(passes_ratio(F.col("dist1"), F.col("dist2"), ratio)).select("image_q", "image_r", "kp_q", "idx1"), "matches-ahead")
    named = own.join(ahead.select(F.col("image_r").alias("image_id"), F.col("idx1").alias("kp_id")).distinct(), ["image_id", "kp_id"], "left_semi")
    back = knn2(blocks, pairs.select(F.col("image_r").alias("image_q"), F.col("image_q").alias("image_r")), queries=packed(named))
    back = back.select(F.col("image_r").alias("image_q"), F.col("image_q").alias("image_r"), F.col("idx1").alias("kp_q"), F.col("kp_q").alias("idx1"))
    many = ahead.join(back, ["image_q", "image_r", "kp_q", "idx1"]).groupBy("image_q", "image_r").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= enough)
    settled = storage.materialize(many.select(F.explode(F.array("image_q", "image_r")).alias("image_id")).distinct(), "settled-images")
    storage.drop(ahead)
    return settled


def isolated_images(descriptors: DataFrame, enough: int, ratio: float = RATIO, block: int = BLOCK, tried: tuple[int, ...] = TRIED) -> DataFrame:
    """(image_id): images that have no ``enough`` matches with any other, as ``isolated`` finds from all pairs.

    One pair with enough matches settles both of its images, and some of its matches are enough. So an image's first
    blocks are matched with the next image in order, then more blocks of those still open with the one after; all pairs
    are matched whole for images that this leaves open, however many. Of equal descriptors of an image two are kept, one
    of them the lowest: the others are nobody's mutual neighbours, and the second says that the first has an equal.
    """
    alike = descriptors.groupBy(F.col("image_id").cast("long").alias("image_id"), "descriptor").agg(F.min("kp_id").alias("low"), F.max("kp_id").alias("high"), F.count(F.lit(1)).alias("n"))
    two = F.when(F.col("n") > 1, F.array("low", "high")).otherwise(F.array("low"))
    own = storage.materialize(alike.select("image_id", F.explode(two).alias("kp_id"), "descriptor"), "distinct-descriptors")
    blocks = storage.materialize(packed(own, block), "descriptor-blocks")
    images = storage.materialize(sizes.numbered(own.select("image_id").distinct(), "image_id", name="place"), "images")
    left = images.select("image_id")
    having = lambda pairs, end: pairs.join(left.withColumnRenamed("image_id", end), end, "left_semi").select("image_i", "image_j")
    ends = lambda pairs: having(pairs, "image_i").union(having(pairs, "image_j")).distinct()
    for step, first in enumerate(tried, 1):
        if left.isEmpty():
            break
        later = images.select(F.col("image_id").alias("image_j"), (F.col("place") - step).alias("place"))
        pairs = ends(images.withColumnRenamed("image_id", "image_i").join(later, "place").select("image_i", "image_j")).toDF("image_q", "image_r")
        settled = _settled(own, blocks, blocks.filter(F.col("block") < first), pairs, enough, ratio)
        left = storage.materialize(left.join(settled, "image_id", "left_anti"), "open-images")
        storage.drop(settled)
    storage.drop(blocks)
    if left.isEmpty():
        return left
    return isolated(left, verified_pairs(match_pairs(own, ends(pairs_exhaustive(images)), ratio, block), enough))


def matches_for_image(matches: DataFrame, image: int) -> DataFrame:
    """Matches of one image, with itself first: (image_id, other, kp_this, kp_other)."""
    one = matches.filter(F.col("image_i") == image).select(F.col("image_i").alias("image_id"), F.col("image_j").alias("other"), F.col("kp_i").alias("kp_this"), F.col("kp_j").alias("kp_other"))
    two = matches.filter(F.col("image_j") == image).select(F.col("image_j").alias("image_id"), F.col("image_i").alias("other"), F.col("kp_j").alias("kp_this"), F.col("kp_i").alias("kp_other"))
    return one.unionByName(two)
