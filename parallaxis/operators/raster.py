"""Pixel-lattice operators over ``(image_id, y, x, v)``: separable blur, differences, extrema, resampling, histograms.

A line of pixels is one array while it is blurred, so a blur is one grouping by line and no join; its size is the
image's width or height.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallaxis.functions import vectors as V

#: The largest blur radius; histogram size; passes of smoothing; relative height of a peak.
MAX_RADIUS, BINS, PASSES, PEAK = 20, 36, 6, 0.8
#: Fixed values of descriptor normalisation.
CLIP, GAIN, CAP, EPS = 0.2, 512.0, 255.0, 1e-7


def kernel(sigma: float) -> list[float]:
    """Normalised Gaussian weights of radius min(ceil(3 sigma), 20)."""
    r = min(math.ceil(3 * sigma), MAX_RADIUS)
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def blur(pixels: DataFrame, sigma: float, along: str) -> DataFrame:
    """One direction of a Gaussian blur; pixels beyond the edge repeat the edge."""
    across = "y" if along == "x" else "x"
    weights = kernel(sigma)
    r = len(weights) // 2
    lines = pixels.groupBy("image_id", across).agg(F.sort_array(F.collect_list(F.struct(along, "v"))).alias("line"))
    values = F.transform("line", lambda p: p["v"])
    last = F.size(values) - 1

    def smooth(p: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for k, w in enumerate(weights):
            total = total + w * F.get(values, F.greatest(F.lit(0), F.least(last, i + (k - r))))
        return F.struct(p[along].alias(along), total.alias("v"))

    out = lines.select("image_id", across, F.explode(F.transform("line", smooth)).alias("p"))
    return out.select("image_id", across, F.col(f"p.{along}").alias(along), F.col("p.v").alias("v")).select("image_id", "y", "x", "v")


def gaussian(pixels: DataFrame, sigma: float) -> DataFrame:
    return blur(blur(pixels, sigma, "x"), sigma, "y")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b at each pixel."""
    return a.join(b.withColumnRenamed("v", "w"), ["image_id", "y", "x"]).select("image_id", "y", "x", (F.col("v") - F.col("w")).alias("v"))


def half(pixels: DataFrame) -> DataFrame:
    """Every other pixel."""
    kept = pixels.filter((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0))
    return kept.select("image_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), "v")


def block_mean(pixels: DataFrame, factor: int) -> DataFrame:
    """Area resampling by a whole factor."""
    at = lambda c: F.floor(F.col(c) / factor).alias(c)
    return pixels.groupBy("image_id", at("y"), at("x")).agg(F.avg("v").alias("v"))


def extrema(stack: DataFrame) -> DataFrame:
    """Pixels of ``(image_id, s, y, x, v)`` strictly above or below all 26 neighbours; those without all 26 drop out.

    Lines of pixels, which have no gaps, meet the eight lines beside them as arrays: nine copies of a line are shuffled.
    """
    lines = stack.groupBy("image_id", "s", "y").agg(F.min("x").alias("x0"), F.sort_array(F.collect_list(F.struct("x", "v"))).alias("line"))
    lines = lines.select("image_id", "s", "y", F.struct("x0", F.transform("line", lambda p: p["v"]).alias("v")).alias("line"))
    beside = F.array(*(F.struct((F.col("s") + a).alias("s"), (F.col("y") + b).alias("y"), F.lit(a == b == 0).alias("own")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    spread = lines.select("image_id", F.explode(beside).alias("to"), "line").select("image_id", "to.s", "to.y", "to.own", "line")
    met = spread.groupBy("image_id", "s", "y").agg(F.collect_list(F.when(~F.col("own"), F.col("line"))).alias("near"), F.first(F.when(F.col("own"), F.col("line")), ignorenulls=True).alias("own"))
    met = met.filter((F.size("near") == 8) & F.col("own").isNotNull())
    at = lambda line, x: F.get(line["v"], (x - line["x0"]).cast("int"))

    def judged(v: Column, i: Column) -> Column:
        x = F.col("own.x0") + i
        sides = F.transform("near", lambda n: F.array(*(at(n, x + k) for k in (-1, 0, 1))))
        around = F.concat(F.flatten(sides), F.array(at(F.col("own"), x - 1), at(F.col("own"), x + 1)))
        whole = F.forall(around, lambda w: w.isNotNull())
        return F.struct(x.alias("x"), v.alias("v"), (whole & ((v > F.array_max(around)) | (v < F.array_min(around)))).alias("extreme"))

    found = F.filter(F.transform(F.col("own.v"), judged), lambda p: p["extreme"])
    return met.select("image_id", "s", "y", F.explode(found).alias("p")).select("image_id", "s", "y", "p.x", "p.v")


def oriented(pixels: DataFrame, width: int, height: int, orientation: int) -> DataFrame:
    """Pixels as an EXIF orientation (1 to 8) says they are to be shown; others leave them as they are."""
    x, y, w, h = F.col("x"), F.col("y"), width - 1, height - 1
    to = {2: (w - x, y), 3: (w - x, h - y), 4: (x, h - y), 5: (y, x), 6: (h - y, x), 7: (h - y, w - x), 8: (y, w - x)}
    nx, ny = to.get(orientation, (x, y))
    return pixels.select("image_id", ny.alias("y"), nx.alias("x"), "v")


def gray(blue: Column, green: Column, red: Column) -> Column:
    """Luma of bytes, rounded to a byte, scaled to 0 to 1."""
    return F.round(0.299 * red + 0.587 * green + 0.114 * blue) / 255


def smooth_ring(bins: Column, passes: int = PASSES) -> Column:
    """Circular [1, 1, 1] / 3 on an array of ``BINS`` values, several times."""
    for _ in range(passes):
        now = bins
        bins = F.transform(F.array(now), lambda b: F.transform(b, lambda v, i: (F.get(b, (i + BINS - 1) % BINS) + v + F.get(b, (i + 1) % BINS)) / 3))[0]
    return bins


def ring_peaks(bins: Column) -> Column:
    """array<struct<bin, at>>: bins above PEAK of the highest, above the one before, not below the one after; refined."""
    top = F.array_max(bins)
    around = F.transform(bins, lambda v, i: F.struct(i.alias("bin"), F.get(bins, (i + BINS - 1) % BINS).alias("l"), v.alias("c"), F.get(bins, (i + 1) % BINS).alias("r")))
    peaks = F.filter(around, lambda p: (p["c"] > PEAK * top) & (p["c"] > p["l"]) & (p["c"] >= p["r"]))
    return F.transform(peaks, lambda p: F.struct(p["bin"].alias("bin"), (p["bin"] + 0.5 * (p["l"] - p["r"]) / (p["l"] - 2 * p["c"] + p["r"])).alias("at")))


#: Cells a side and directions of a descriptor.
CELLS, DIRECTIONS = 4, 8


def scattered(samples: DataFrame, *by: str) -> DataFrame:
    """(by..., bin, weight): trilinear histogram of ``samples(by..., x, y, o, m)`` over CELLS x CELLS cells of DIRECTIONS.

    x and y are in cells from 0 to CELLS, cell centres at halves; o is in directions and wraps around. Each sample's m is
    shared among the eight nearest bins; shares beyond the edge are lost. Rows with a null count for nothing. Spark adds
    up each task's shares before it shuffles them.
    """
    usable = samples.filter("x is not null and y is not null and o is not null and m is not null")
    at = {"x": F.col("x") - 0.5, "y": F.col("y") - 0.5, "o": F.col("o")}
    placed = usable.select(*by, "m", *(F.floor(v).alias(f"{n}0") for n, v in at.items()), *((v - F.floor(v)).alias(f"f{n}") for n, v in at.items()))

    def corner(dx: int, dy: int, do: int) -> Column:
        x, y, o = F.col("x0") + dx, F.col("y0") + dy, F.pmod(F.col("o0") + do, F.lit(DIRECTIONS))
        share = lambda n, d: F.col(f"f{n}") if d else 1 - F.col(f"f{n}")
        inside = x.between(0, CELLS - 1) & y.between(0, CELLS - 1)
        return F.struct(F.when(inside, (y * CELLS + x) * DIRECTIONS + o).cast("int").alias("bin"), (F.col("m") * share("x", dx) * share("y", dy) * share("o", do)).alias("weight"))

    corners = F.array(*(corner(dx, dy, do) for dx in (0, 1) for dy in (0, 1) for do in (0, 1)))
    spread = placed.select(*by, F.explode(corners).alias("c")).filter("c.bin is not null")
    return spread.groupBy(*by, F.col("c.bin").alias("bin")).agg(F.sum("c.weight").alias("weight"))


def normalised(descriptor: Column) -> Column:
    """Unit length, clipped, unit length again, scaled and capped."""
    unit = lambda v: F.transform(F.array(v), lambda u: F.transform(u, lambda x: x / (F.sqrt(V.dot(u, u)) + EPS)))[0]
    clipped = F.transform(unit(descriptor), lambda x: F.least(x, F.lit(CLIP)))
    return F.transform(unit(clipped), lambda x: F.least(x * GAIN, F.lit(CAP)))


def ncc_cost(n: Column, sr: Column, ss: Column, srr: Column, sss: Column, srs: Column, patch: int = 11) -> Column:
    """1 - correlation from moments, 2 for too few samples or too little variance."""
    vr, vs = srr / n - (sr / n) ** 2, sss / n - (ss / n) ** 2
    cost = 1 - (srs / n - sr / n * ss / n) / F.sqrt(vr * vs)
    return F.when((n < patch * patch // 2) | (vr < 1e-6) | (vs < 1e-6), 2.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(2.0), cost)))


#: Side of the tiles in which pixels meet samples.
SAMPLED_TILE = 32


def bilinear(pixels: DataFrame, samples: DataFrame, width: int, height: int) -> DataFrame:
    """Values of ``samples(image_id, u, v)`` between pixels; positions beyond the edge take the edge's.

    Pixels meet samples as tiles that also hold the first line and column of the next ones, so a sample is shuffled once
    and finds all its four pixels in one row. A pixel that is missing counts for nothing, a sample without any has no row.
    """
    u = F.greatest(F.lit(0.0), F.least(F.lit(width - 1.0), F.col("u")))
    v = F.greatest(F.lit(0.0), F.least(F.lit(height - 1.0), F.col("v")))
    side = SAMPLED_TILE + 1
    back = lambda c: F.when((F.col(c) % SAMPLED_TILE == 0) & (F.col(c) > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    tile = lambda c: F.floor(F.col(c) / SAMPLED_TILE)
    shared = pixels.select("image_id", "y", "x", "v", F.explode(back("y")).alias("by")).select("*", F.explode(back("x")).alias("bx"))
    dealt = shared.select("image_id", (tile("y") - F.col("by")).alias("ty"), (tile("x") - F.col("bx")).alias("tx"), "y", "x", "v")
    at = ((F.col("y") - F.col("ty") * SAMPLED_TILE) * side + F.col("x") - F.col("tx") * SAMPLED_TILE).cast("int")
    held = dealt.groupBy("image_id", "ty", "tx").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("v").alias("value")))).alias("_pixels"))
    # lines as long as the image allows: without gaps, a pixel's place follows from its position
    wide = F.least(F.lit(side), width - F.col("tx") * SAMPLED_TILE).cast("int")
    high = F.least(F.lit(side), height - F.col("ty") * SAMPLED_TILE).cast("int")
    whole = (F.size("_pixels") == wide * high) & F.forall(F.transform("_pixels", lambda p, i: (p["at"] == F.floor(i / wide) * side + i % wide) & p["value"].isNotNull()), lambda same: same)
    tiles = held.withColumn("_wide", wide).withColumn("_whole", whole)
    placed = samples.select("image_id", "u", "v", *(c.cast("int").alias(n) for n, c in (("_x", F.floor(u)), ("_y", F.floor(v)))), (u - F.floor(u)).alias("_fu"), (v - F.floor(v)).alias("_fv"))
    met = placed.withColumns({"ty": tile("_y"), "tx": tile("_x")}).join(tiles, ["image_id", "ty", "tx"])
    at_place, share_of = (lambda place: lambda p: p["at"] == place), (lambda weight: lambda p: p["value"] * weight)
    direct, found = F.lit(0.0), []
    for dx in (0, 1):
        for dy in (0, 1):
            x, y = F.least(F.col("_x") + dx, F.lit(width - 1)) - F.col("tx") * SAMPLED_TILE, F.least(F.col("_y") + dy, F.lit(height - 1)) - F.col("ty") * SAMPLED_TILE
            weight = (F.col("_fu") if dx else 1 - F.col("_fu")) * (F.col("_fv") if dy else 1 - F.col("_fv"))
            direct = direct + F.get("_pixels", (y * F.col("_wide") + x).cast("int"))["value"] * weight
            found.append(F.transform(F.filter("_pixels", at_place(y * side + x)), share_of(weight)))
    shares = F.concat(*found)
    summed = F.aggregate(shares, F.lit(None).cast("double"), lambda s, x: F.coalesce(s + x, s, x))
    return met.filter(F.col("_whole") | (F.size(shares) > 0)).select("image_id", "u", "v", F.when(F.col("_whole"), direct).otherwise(summed).alias("value"))
