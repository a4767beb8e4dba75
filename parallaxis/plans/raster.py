"""Raster operators on images made of line items, one for each supplier, and per-key array operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.operators import raster, tiles
from parallaxis.plans import scene
from parallaxis.plans.catalog import query, table

W, H = scene.WIDTH, scene.HEIGHT
_TEX = f"{scene.RASTER}, tex as (select * from rast)"
texture = scene.raster
_TILE = 16


def _tiles(spark, sf_dir) -> DataFrame:
    return tiles.cut(texture(spark, sf_dir), ["v"], _TILE)


def _kernel(sigma: float) -> str:
    return "(values " + ", ".join(f"({k - len(w) // 2}, {x!r}::double)" for w in [raster.kernel(sigma)] for k, x in enumerate(w)) + ")"


def _blur(name: str, source: str, sigma: float, along: str) -> str:
    other, last = ("y", W - 1) if along == "x" else ("x", H - 1)
    return f"{name} as (select p.image_id, p.{other}, p.{along}, sum(w * q.v) v from {source} p, {_kernel(sigma)} k(o, w), {source} q where q.image_id = p.image_id and q.{other} = p.{other} and q.{along} = greatest(0, least({last}, p.{along} + o)) group by all)"


def _gauss(name: str, sigma: float) -> str:
    return f"{_blur(name + 'x', 'tex', sigma, 'x')}, {_blur(name, name + 'x', sigma, 'y')}"


_OUT = "select image_id, y, x, round(v, 6) + 0.0::double v from "


def _rounded(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", F.round("v", 6) + 0.0)


@query("gauss_blur_h", f"with {_TEX}, {_blur('b', 'tex', 1.6, 'x')} {_OUT} b")
def gauss_blur_h(spark, sf_dir):
    return _rounded(tiles.pixels(tiles.blur(_tiles(spark, sf_dir), 1.6, "x"), ["v"], _TILE))


@query("gauss_blur_v", f"with {_TEX}, {_blur('b', 'tex', 1.6, 'y')} {_OUT} b")
def gauss_blur_v(spark, sf_dir):
    return _rounded(tiles.pixels(tiles.blur(_tiles(spark, sf_dir), 1.6, "y"), ["v"], _TILE))


_SIGMAS = (1.0, 1.2, 2.2, 2.5)
_STACK = ", ".join(_gauss(f"g{k}", s) for k, s in enumerate(_SIGMAS))
_DOGS = "dogs as (" + " union all ".join(f"select {k} s, image_id, y, x, a.v - b.v v from g{k + 1} a join g{k} b using (image_id, y, x)" for k in range(3)) + ")"


@query("dog", f"with {_TEX}, {_gauss('g0', 1.0)}, {_gauss('g1', 1.6)} select image_id, y, x, round(a.v - b.v, 6) + 0.0::double v from g1 a join g0 b using (image_id, y, x)")
def dog(spark, sf_dir):
    return _rounded(tiles.pixels(tiles.difference(_tiles(spark, sf_dir), 1.0, 1.6), ["v"], _TILE))


@query("extrema_3x3x3", f"""with {_TEX}, {_STACK}, {_DOGS}, r as (select s, image_id, y, x, round(v, 6) v from dogs),
  o as (select b.image_id, b.s + i s, b.y + j y, b.x + k x, max(b.v) filter (where (i, j, k) <> (0, 0, 0)) high, min(b.v) filter (where (i, j, k) <> (0, 0, 0)) low, count(*) n, max(b.v) filter (where (i, j, k) = (0, 0, 0)) v
    from r b, range(-1, 2) a(i), range(-1, 2) c(j), range(-1, 2) e(k) group by all having count(*) = 27)
  select s::int s, image_id, y, x, v from o where v > high or v < low""")
def extrema_3x3x3(spark, sf_dir):
    """Extrema of three differences of blurs, on tiles of sixteen pixels."""
    return tiles.extrema(_tiles(spark, sf_dir), _SIGMAS, (H, W), _TILE).select("s", "image_id", "y", "x", "v")


@query("downsample2", f"with {_TEX} select image_id, y // 2 y, x // 2 x, v from tex where x % 2 = 0 and y % 2 = 0")
def downsample2(spark, sf_dir):
    return raster.half(texture(spark, sf_dir))


@query("resize_max", f"with {_TEX} select image_id, y // 4 y, x // 4 x, round(avg(v), 6) v from tex group by all")
def resize_max(spark, sf_dir):
    """Down to 8 pixels at most: a factor of four."""
    return _rounded(raster.block_mean(texture(spark, sf_dir), 4))


@query("gray_float", f"with {_TEX} select image_id, y, x, round(round(0.299::double * ((v * 3) % 256) + 0.587::double * ((v * 5) % 256) + 0.114::double * v) / 255, 6) v from tex")
def gray_float(spark, sf_dir):
    v = F.col("v")
    return texture(spark, sf_dir).select("image_id", "y", "x", F.round(raster.gray(v, (v * 5) % 256, (v * 3) % 256), 6).alias("v"))


_TURNS = {1: "x, y", 2: "{w} - x, y", 3: "{w} - x, {h} - y", 4: "x, {h} - y", 5: "y, x", 6: "{h} - y, x", 7: "{h} - y, {w} - x", 8: "y, {w} - x"}
_TURNS = {k: t.format(w=W - 1, h=H - 1).split(", ") for k, t in _TURNS.items()}


@query("exif_orient", f"with {_TEX}, o as (" + " union all ".join(f"select {k} orientation, image_id, {t[0]} nx, {t[1]} ny, v from tex" for k, t in _TURNS.items()) + ") select orientation, image_id, ny y, nx x, v from o where image_id % 8 + 1 = orientation")
def exif_orient(spark, sf_dir):
    """Every image, shown as the orientation that its number stands for says."""
    own = texture(spark, sf_dir)
    out = None
    for k in range(1, 9):
        turned = raster.oriented(own.filter(F.col("image_id") % 8 + 1 == k), W, H, k).select(F.lit(k).alias("orientation"), "image_id", "y", "x", "v")
        out = turned if out is None else out.unionByName(turned)
    return out


@query("bilinear_sample", f"""with {_TEX}, s as (select image_id, x * 1.37 - 3 u, y * 1.21 - 2 v from tex), c as (select image_id, u::double u, v::double v, greatest(0.0::double, least({W - 1}.0::double, u::double)) cu, greatest(0.0::double, least({H - 1}.0::double, v::double)) cv from s),
  k as (select c.*, dx, dy, least(floor(cu)::bigint + dx, {W - 1}) x, least(floor(cv)::bigint + dy, {H - 1}) y, (case dx when 1 then cu - floor(cu) else 1 - (cu - floor(cu)) end) * (case dy when 1 then cv - floor(cv) else 1 - (cv - floor(cv)) end) w from c, range(2) a(dx), range(2) b(dy))
  select k.image_id, round(k.u, 4) u, round(k.v, 4) v, round(sum(w * t.v), 6) + 0.0::double value from k join tex t on t.image_id = k.image_id and t.x = k.x and t.y = k.y group by k.image_id, k.u, k.v""")
def bilinear_sample(spark, sf_dir):
    own = texture(spark, sf_dir)
    samples = own.select("image_id", (F.col("x") * 1.37 - 3).alias("u"), (F.col("y") * 1.21 - 2).alias("v"))
    found = raster.bilinear(own, samples, W, H)
    return found.select("image_id", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"), (F.round("value", 6) + 0.0).alias("value"))


_HIST = "h as (select user_id, list(coalesce(n, 0)::double order by b) bins from (select u.user_id, b, n from (select distinct user_id from events) u cross join range(36) t(b) left join (select user_id, event_id % 36 b, count(*) n from events group by all) c using (user_id, b)) group by user_id)"


def histograms(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    counted = events.groupBy("user_id", (F.col("event_id") % 36).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    listed = counted.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("b", F.col("n").cast("double")))).alias("m"))
    return listed.select("user_id", F.transform(F.sequence(F.lit(0), F.lit(35)), lambda b: F.coalesce(F.try_element_at("m", b.cast("long")), F.lit(0.0))).alias("bins"))


def _listed(name: str) -> F.Column:
    return F.array_join(F.transform(name, lambda x: F.format_string("%.4f", x)), ",").alias(name)


@query("ori_hist36", f"with {_HIST} select user_id, array_to_string(list_transform(bins, lambda x: printf('%.4f', x)), ',') bins from h")
def ori_hist36(spark, sf_dir):
    return histograms(spark, sf_dir).select("user_id", _listed("bins"))


_PASS = ", ".join(f"h{k + 1} as (select user_id, [(bins[(i + 34) % 36 + 1] + bins[i] + bins[i % 36 + 1]) / 3 for i in range(1, 37)] bins from h{k or ''})" for k in range(raster.PASSES))


@query("hist_smooth", f"with {_HIST}, {_PASS} select user_id, array_to_string(list_transform(bins, lambda x: printf('%.4f', x)), ',') bins from h{raster.PASSES}")
def hist_smooth(spark, sf_dir):
    return histograms(spark, sf_dir).withColumn("bins", raster.smooth_ring(F.col("bins"))).select("user_id", _listed("bins"))


@query("hist_peaks", f"""with {_HIST}, b as (select user_id, i - 1 bin, bins[(i + 34) % 36 + 1] l, bins[i] c, bins[i % 36 + 1] r, list_max(bins) top from h, range(1, 37) t(i))
  select user_id, bin, round(bin + 0.5::double * (l - r) / (l - 2 * c + r), 6) "at" from b where c > 0.8::double * top and c > l and c >= r""")
def hist_peaks(spark, sf_dir):
    peaks = histograms(spark, sf_dir).select("user_id", F.explode(raster.ring_peaks(F.col("bins"))).alias("p"))
    return peaks.select("user_id", F.col("p.bin").cast("long").alias("bin"), F.round("p.at", 6).alias("at"))


@query("l2_norm_clip", """with u as (select vec_id, list_transform(embedding, lambda x: abs(x::double)) v from embeddings),
  a as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-7::double n from u), b as (select vec_id, list_transform(v, lambda x: least(x / n, 0.2::double)) v from a),
  c as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-7::double n from b) select vec_id, round(list_sum(list_transform(v, lambda x: least(x / n * 512, 255.0::double))), 4) total, round(list_max(list_transform(v, lambda x: least(x / n * 512, 255.0::double))), 4) top from c""")
def l2_norm_clip(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    made = own.select("vec_id", raster.normalised(F.col("v")).alias("v"))
    return made.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.array_max("v"), 4).alias("top"))


@query("ncc_moments", """with s as (select l_suppkey k, count(*)::double n, sum(l_quantity) sr, sum(l_extendedprice / 1000) ss, sum(l_quantity * l_quantity) srr, sum(l_extendedprice / 1000 * (l_extendedprice / 1000)) sss, sum(l_quantity * (l_extendedprice / 1000)) srs from lineitem group by all),
  v as (select *, srr/n - (sr/n)**2 vr, sss/n - (ss/n)**2 vs from s) select k, round(case when n < 60 or vr < 1e-6 or vs < 1e-6 then 2.0::double else greatest(0.0::double, least(2.0::double, 1 - (srs/n - sr/n*ss/n) / sqrt(vr*vs))) end, 6) cost from v""")
def ncc_moments(spark, sf_dir):
    r, s = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(r).alias("sr"), F.sum(s).alias("ss"), F.sum(r * r).alias("srr"), F.sum(s * s).alias("sss"), F.sum(r * s).alias("srs"))
    return sums.select("k", F.round(raster.ncc_cost(*(F.col(c) for c in ("n", "sr", "ss", "srr", "sss", "srs"))), 6).alias("cost"))
