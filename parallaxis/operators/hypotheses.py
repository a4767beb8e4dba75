"""Two-view triangulation as Column expressions, and votes of hypotheses about an orbit that are all tried in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxis.functions import vectors as V

#: Signs of axis and direction in the order in which they are tried, matches tested of each pair, and after
#: how many tested ones no further pair is begun.
CONFIGS = ((1, 1), (-1, 1), (1, -1), (-1, -1))
EACH, ENOUGH = 10, 100


def begun(matches: DataFrame, pair: str, each: int = EACH, enough: int = ENOUGH) -> DataFrame:
    """The pairs of which ``tested`` takes any, at most ``enough``: it needs no more of a match than its pair."""
    given = matches.groupBy(pair).agg(F.least(F.count(F.lit(1)), F.lit(each)).alias("_n")).orderBy(pair).limit(enough)
    before = F.sum("_n").over(Window.orderBy(pair)) - F.col("_n")
    return given.select(pair, before.alias("_before")).filter(F.col("_before") < enough).select(pair)


def tested(matches: DataFrame, pair: str, order: str, each: int = EACH, enough: int = ENOUGH) -> DataFrame:
    """The first matches of each pair, pair by pair until enough have been taken.

    Every pair that has any gives one at least, so only the first ``enough`` pairs can be begun: those are found by a
    top-k, and only they are summed up in order.
    """
    place = F.row_number().over(Window.partitionBy(pair).orderBy(order))
    first = matches.withColumn("_place", place).filter(F.col("_place") <= each).drop("_place")
    return first.join(F.broadcast(begun(first, pair, each, enough)), pair, "left_semi")


def orbit_pose(angle: Column, distance: Column) -> dict[str, list[Column]]:
    """r (rows of the rotation), t and centre c of a camera on an orbit about z that looks at the origin."""
    c, s, zero = F.cos(angle), F.sin(angle), F.lit(0.0)
    return {"r": [-s, c, zero, zero, zero, F.lit(-1.0), -c, -s, zero], "t": [zero, zero, distance], "c": [distance * c, distance * s, zero]}


def midpoint(c1: V.Components, d1: V.Components, c2: V.Components, d2: V.Components) -> list[Column]:
    """The point halfway between two rays of unit directions where they are nearest; null if they are parallel."""
    b = V.dot3(d1, d2)
    gap = [x - y for x, y in zip(c1, c2)]
    d, e = V.dot3(d1, gap), V.dot3(d2, gap)
    rest = F.when(1 - b * b > 1e-12, 1 - b * b)
    s, t = (b * e - d) / rest, (e - b * d) / rest
    return [(p + s * x + q + t * y) / 2 for p, x, q, y in zip(c1, d1, c2, d2)]


def triangulated(pairs: DataFrame, focal: float, cx: float, cy: float, max_error: float = 4.0, min_angle: float = 2.0) -> DataFrame:
    """Adds ``valid`` to rows with two pixels (ui, vi, uj, vj) and two poses (i_r0.., i_t0.., i_c0.., and j_...).

    A point is valid if it lies before both cameras, is seen within ``max_error`` pixels of both pixels, and its rays meet
    at ``min_angle`` degrees or more.
    """
    keep = pairs.columns
    for n in "ij":
        ray = [(F.col(f"u{n}") - cx) / focal, (F.col(f"v{n}") - cy) / focal, F.lit(1.0)]
        away = V.matvec(V.transpose([F.col(f"{n}_r{k}") for k in range(9)]), ray)
        pairs = pairs.withColumns({f"{n}_w{k}": x for k, x in enumerate(away)})
        pairs = pairs.withColumns({f"{n}_d{k}": x for k, x in enumerate(V.unit3([F.col(f"{n}_w{k}") for k in range(3)]))})
    of = lambda n, what: [F.col(f"{n}_{what}{k}") for k in range(3)]
    pairs = pairs.withColumns({f"p{k}": x for k, x in enumerate(midpoint(of("i", "c"), of("i", "d"), of("j", "c"), of("j", "d")))})
    point, good = [F.col(f"p{k}") for k in range(3)], F.col("p0").isNotNull()
    for n in "ij":
        seen = [x + t for x, t in zip(V.matvec([F.col(f"{n}_r{k}") for k in range(9)], point), of(n, "t"))]
        off = F.sqrt((focal * seen[0] / seen[2] + cx - F.col(f"u{n}")) ** 2 + (focal * seen[1] / seen[2] + cy - F.col(f"v{n}")) ** 2)
        good = good & (seen[2] > 0) & (off <= max_error)
    to = [[c - p for c, p in zip(of(n, "c"), point)] for n in "ij"]
    good = good & (V.angle3(*to) >= min_angle)
    return pairs.withColumn("valid", F.coalesce(good, F.lit(False))).select(*keep, "valid")


def orbit_votes(matches: DataFrame, angles: DataFrame, focal: float, cx: float, cy: float) -> DataFrame:
    """(config, axis, direction, tested, good): valid triangulations of matches under each sign of axis and direction.

    ``matches(i, j, ui, vi, uj, vj)`` are those to be tested, ``angles(image_id, angle, distance)`` the orbit. All
    hypotheses are rows of one plan; with no matches each has none.
    """
    spark = matches.sparkSession
    configs = F.array(*(F.struct(F.lit(k).alias("config"), F.lit(a).alias("axis"), F.lit(d).alias("direction")) for k, (a, d) in enumerate(CONFIGS)))
    fanned = matches.withColumn("_c", F.explode(configs)).select(*matches.columns, "_c.*")
    turn = (F.col("axis") * F.col("direction")).cast("double")
    for n in "ij":
        own = angles.select(F.col("image_id").alias(n), F.col("angle").alias(f"{n}_angle"), F.col("distance").alias(f"{n}_distance"))
        fanned = fanned.join(own, n)
        pose = orbit_pose(turn * F.col(f"{n}_angle"), F.col(f"{n}_distance"))
        fanned = fanned.withColumns({f"{n}_{what}{k}": x for what, parts in pose.items() for k, x in enumerate(parts)})
    found = triangulated(fanned, focal, cx, cy).groupBy("config").agg(F.count(F.lit(1)).alias("tested"), F.count_if("valid").alias("good"))
    every = spark.range(1).select(F.explode(configs).alias("c")).select("c.*")
    return every.join(found, "config", "left").select("config", "axis", "direction", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tested", "good")))
