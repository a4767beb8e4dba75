"""Solvers. Those on the tables' scene are registered; reconstructions of the synthetic turntable scene, one task a scene or a
view, are for tests, which hold them against the scene's exact answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis import storage
from parallaxis.functions import vectors as V
from parallaxis.model import PRESETS, Config
from parallaxis.operators import epipolar, features, fusion, geometry, mvs, raster, sfm, sizes, views
from parallaxis.plans import cameras as C
from parallaxis.plans import scene
from parallaxis.plans.catalog import query, table
from parallaxis.sources import synthetic

K = np.array([[synthetic.FOCAL, 0, synthetic.CENTER_X], [0, synthetic.FOCAL, synthetic.CENTER_Y], [0, 0, 1]])


def sightings(spark) -> DataFrame:
    """(image_id, kp_id, u, v): every vertex where a camera sees it, to a tenth of a pixel."""
    points = synthetic.sphere_vertices(spark)
    seen = points.crossJoin(F.broadcast(synthetic.ring_cameras(spark)))
    facing = F.col("x") * (F.col("cx") - F.col("x")) + F.col("y") * (F.col("cy") - F.col("y")) + F.col("z") * (F.col("cz") - F.col("z"))
    u, v = geometry.pixel(geometry.camera_frame(geometry.columns("x", "y", "z")), synthetic.FOCAL, synthetic.CENTER_X, synthetic.CENTER_Y)
    return seen.filter(facing > 1e-4).select("image_id", F.col("v_id").alias("kp_id"), F.round(u, 1).alias("u"), F.round(v, 1).alias("v"))


@query("fundamental_ransac")
def fundamental_ransac(spark, sf_dir):
    """Verified matches of each supplier with the next: parts that line items of both see, at the first of their pixels."""
    first = scene.seen(spark, sf_dir).groupBy("image_id", F.col("point_id").alias("kp")).agg(F.min(F.struct("order_id", "number", "u", "v")).alias("s"))
    own = first.select("image_id", "kp", F.col("s.u").alias("u"), F.col("s.v").alias("v"))
    a = own.select(F.col("image_id").alias("image_i"), "kp", F.col("u").alias("xi"), F.col("v").alias("yi"))
    b = own.select((F.col("image_id") - 1).alias("image_i"), "kp", F.col("u").alias("xj"), F.col("v").alias("yj"))
    met = a.join(b, ["image_i", "kp"])
    return epipolar.verify_pairs(met.select("image_i", (F.col("image_i") + 1).alias("image_j"), F.col("kp").alias("kp_i"), F.col("kp").alias("kp_j"), "xi", "yi", "xj", "yj"))


@query("triangulate")
def triangulate(spark, sf_dir):
    """(point_id, x, y, z, ok): parts from all line items that see them, and whether they pass the acceptance tests."""
    rows = scene.seen(spark, sf_dir).join(sizes.small(scene.cameras(spark, sf_dir)), "image_id")
    return epipolar.triangulate_points(rows, scene.FOCAL, scene.CX, scene.CY)


def reconstructed(sightings: DataFrame) -> DataFrame:
    """(image_id, R, t, points) from matches of cameras at most thirty degrees of the ring apart: one scene is one task."""
    rows = sightings.withColumn("scene", F.lit(0))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        keypoints, number = {}, {}
        for image, own in g.sort_values(["image_id", "kp_id"]).groupby("image_id"):
            keypoints[int(image)] = own[["u", "v"]].to_numpy()
            number[int(image)] = {int(v): n for n, v in enumerate(own.kp_id)}
        matches = {(i, j): [(number[i][v], number[j][v]) for v in number[i] if v in number[j]] for i in keypoints for j in keypoints if i < j and min(j - i, synthetic.VIEWS - j + i) <= 3}
        scene = sfm.reconstruct(keypoints, matches, K)
        return pd.DataFrame({"image_id": list(scene.poses), "R": [r.ravel() for r, _ in scene.poses.values()], "t": [t for _, t in scene.poses.values()], "points": len(scene.points)})

    return rows.groupBy("scene").applyInPandas(one, "image_id long, R array<double>, t array<double>, points long")


def sfm_ring(spark, sf_dir):
    """All cameras of the ring and all vertices."""
    return reconstructed(sightings(spark))


def _rendered(spark, width: int, height: int, images: str) -> DataFrame:
    """(image_id, width, height, gray): shaded sphere with a smooth pattern, packed as float32."""
    focal, cx, cy = synthetic.FOCAL * width / synthetic.WIDTH, width / 2, height / 2
    cams = synthetic.ring_cameras(spark).filter(images)
    hit = synthetic.sphere_depth(cams, synthetic.lattice(spark, width, height), focal, cx, cy)
    met = hit.join(F.broadcast(cams), "image_id")
    d = F.col("depth")
    at = [(F.col("x") - cx) / focal * d - F.col("t0"), (F.col("y") - cy) / focal * d - F.col("t1"), d - F.col("t2")]
    x, y, z = (c / synthetic.RADIUS for c in V.matvec(V.transpose(geometry.columns(*geometry.R)), at))
    value = 0.5 + 0.2 * F.sin(9 * x + 4 * z) + 0.15 * F.cos(11 * y - 5 * z) + 0.1 * F.sin(17 * z + 6 * x * y)
    rows = met.select("image_id", "y", "x", value.alias("v"))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        plane = np.full((height, width), 0.12, "<f4")
        plane[g.y.to_numpy(), g.x.to_numpy()] = g.v.to_numpy()
        return pd.DataFrame({"image_id": [int(g.image_id.iloc[0])], "width": [width], "height": [height], "gray": [plane.tobytes()]})

    return rows.groupBy("image_id").applyInPandas(pack, "image_id long, width int, height int, gray binary")


@query("sift_cuda")
def sift_cuda(spark, sf_dir):
    """Features of all suppliers' images."""
    wide, high = scene.WIDTH, scene.HEIGHT

    def pack(batches):
        for batch in batches:
            lists = batch.column("line")
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            planes = [values[a:b].astype("<f4").tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array([wide] * len(planes), pa.int32()), pa.array([high] * len(planes), pa.int32()), pa.array(planes, pa.binary())], names=["image_id", "width", "height", "gray"])

    lines = scene.raster(spark, sf_dir).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", (F.col("v") / 32).alias("v")))).alias("line"))
    lines = lines.select("image_id", F.transform("line", lambda p: p["v"].cast("float")).alias("line"))
    return features.detect_all(lines.mapInArrow(pack, "image_id long, width int, height int, gray binary")).drop("descriptor")


def mvs_ring(spark, sf_dir, views_of: str = "true", width: int = 48, height: int = 36, iterations: int = 12):
    """Depth maps of the views that ``views_of`` names, small ones, from their best sources; pixels that enough other views confirm."""
    images = _rendered(spark, width, height, "true")
    ring = synthetic.ring_cameras(spark)
    focal = synthetic.FOCAL * width / synthetic.WIDTH
    k = [focal, 0.0, width / 2, 0.0, focal, height / 2, 0.0, 0.0, 1.0]
    view = F.struct("gray", F.array(*map(F.lit, k)).alias("k"), F.array(*geometry.R).alias("r"), F.array(*geometry.T).alias("t")).alias("view")
    seen = images.join(F.broadcast(ring), "image_id").select("image_id", view)
    origin = [F.lit(0.0)] * 3
    other = ring.select(F.col("image_id").alias("image_j"), *(F.col(c).alias(f"o{c}") for c in ("cx", "cy", "cz")))
    pairs = ring.join(F.broadcast(other), F.col("image_id") < F.col("image_j"))
    pairs = pairs.select(F.col("image_id").alias("image_i"), "image_j", F.lit(1).alias("shared"), F.round(views.baseline_angle(geometry.columns("cx", "cy", "cz"), geometry.columns("ocx", "ocy", "ocz"), origin), 4).alias("baseline_deg"))
    best = min(8, max(3, synthetic.VIEWS - 1))
    chosen = storage.materialize(views.top_sources(views.source_candidates(pairs).withColumn("score", F.round("score", 6)), best).select(F.col("ref_id").alias("image_id"), "src_id", "rank"), "sources")
    near = chosen.join(seen.withColumnRenamed("image_id", "src_id"), "src_id").select("image_id", F.col("rank").cast("long").alias("rank"), "view").unionByName(seen.select("image_id", F.lit(0).cast("long").alias("rank"), "view"))
    jobs = near.filter(views_of).groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "view"))), lambda s: s["view"]).alias("views"))
    # depth range and seeds come from all points that a view sees
    points = sightings(spark).join(synthetic.sphere_vertices(spark).withColumnRenamed("v_id", "kp_id"), "kp_id").join(F.broadcast(ring), "image_id")
    depth = geometry.camera_frame(geometry.columns("x", "y", "z"))[2]
    placed = points.select("image_id", "kp_id", (F.col("u") * width / synthetic.WIDTH).alias("x"), (F.col("v") * width / synthetic.WIDTH).alias("y"), depth.alias("depth"))
    ranges = views.depth_range(placed, "image_id", "depth")
    seeds = placed.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("kp_id", "x", "y", "depth"))).alias("seeds"))
    jobs = jobs.join(ranges, "image_id").join(seeds, "image_id", "left").select(
        "image_id", F.lit(width).alias("width"), F.lit(height).alias("height"), F.col("depth_min").alias("low"), F.col("depth_max").alias("high"), "views",
        F.transform("seeds", lambda s: F.array(s["x"], s["y"], s["depth"])).alias("seeds"),
    )
    maps = storage.materialize(mvs.depth_maps(jobs, iterations), "depth-maps")
    agreed = geometry.consistent_views(maps.select("image_id", "x", "y", "depth"), ring, chosen.select("image_id", "src_id"), focal, width / 2, height / 2)
    kept = geometry.filtered_depths(agreed).filter("depth is not null").select("image_id", "x", "y")
    return maps.join(kept, ["image_id", "x", "y"], "left_semi")


@query("fuse", f"""with {C._DEPTH}, q as (select d.image_id, (x - {C.CX}::double)/{C.FOCAL}*depth - t0 q0, (y - {C.CY}::double)/{C.FOCAL}*depth - t1 q1, depth - t2 q2, r0, r1, r2, r3, r4, r5, r6, r7, r8 from depth d join ring using (image_id)),
  w as (select image_id, round(r0*q0+r3*q1+r6*q2, 9) x, round(r1*q0+r4*q1+r7*q2, 9) y, round(r2*q0+r5*q1+r8*q2, 9) z from q)
  select floor((x + 0.0037::double)/0.01)::bigint gx, floor((y + 0.0037::double)/0.01)::bigint gy, floor((z + 0.0037::double)/0.01)::bigint gz, count(*) n, count(distinct image_id) views from w group by all having count(distinct image_id) >= 2""")
def fuse(spark, sf_dir):
    """A grid of a centimetre, moved so that the scene's symmetric pixels do not lie on its planes."""
    world = fusion.lifted(C.depths(spark, sf_dir), scene.cameras(spark, sf_dir), C.FOCAL, C.CX, C.CY)
    moved = world.select("image_id", *((F.round(c, 9) + 0.0037).alias(c) for c in "XYZ"))
    return fusion.fuse(moved, 0.01, 2).select("gx", "gy", "gz", "n", "views")


_QUALITIES = list(PRESETS)


@query("quality_preset", "with p(k, quality, size, iterations, depth) as (values (0, 'low', 1600, 4, 8), (1, 'medium', 2400, 6, 9), (2, 'high', 3200, 12, 10), (3, 'ultra', 4800, 12, 12)) select c_custkey, quality, size max_image_size, iterations mvs_iterations, depth poisson_depth from customer join p on k = c_custkey % 4")
def quality_preset(spark, sf_dir):
    """What the quality that each customer's key names sets."""
    made = [Config(quality=q).preset() for q in _QUALITIES]
    options = F.array(*(F.struct(F.lit(q).alias("quality"), F.lit(c.max_image_size).alias("max_image_size"), F.lit(c.mvs_iterations).alias("mvs_iterations"), F.lit(c.poisson_depth).alias("poisson_depth")) for q, c in zip(_QUALITIES, made)))
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(options, (F.col("c_custkey") % 4).cast("int")).alias("o")).select("c_custkey", "o.*")


@query("blur_kernel", """with k as (select o, exp(-(o*o)::double / (2 * 1.6::double * 1.6::double)) w from range(-5, 6) t(o)), n as (select o, w / (select sum(w) from k) w from k)
  select l_orderkey point_id, round(sum(l_quantity * coalesce(w, 0)), 6) weighted from lineitem left join n on o = l_linenumber - 4 group by 1""")
def blur_kernel(spark, sf_dir):
    """Each order's quantities, weighted by the kernel about its fourth line."""
    w = raster.kernel(1.6)
    weight = F.coalesce(F.get(F.array(*map(F.lit, w)), F.col("l_linenumber") - 4 + len(w) // 2), F.lit(0.0))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("point_id")).agg(F.round(F.sum(F.col("l_quantity") * weight), 6).alias("weighted"))


@query("octave_incremental", "select l_suppkey image_id, round(sum(l_quantity * sqrt(pow(1.6::double * pow(2, l_linenumber / 3.0::double), 2) - pow(1.6::double * pow(2, (l_linenumber - 1) / 3.0::double), 2))), 4) blur from lineitem group by 1")
def octave_incremental(spark, sf_dir):
    """What is missing from each blur to the next within an octave (the line is the level), weighted by quantity."""
    sigma = lambda s: features.SIGMA0 * F.pow(F.lit(2.0), s / features.SCALES)
    level = F.col("l_linenumber")
    step = F.sqrt(sigma(level) ** 2 - sigma(level - 1) ** 2)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_id")).agg(F.round(F.sum(F.col("l_quantity") * step), 4).alias("blur"))


@query("orbit_apply", f"with {scene.RING} select image_id, round(cx*cos(radians(10.0::double)) - cy*sin(radians(10.0::double)), 6) + 0.0::double x, round(cx*sin(radians(10.0::double)) + cy*cos(radians(10.0::double)), 6) + 0.0::double y, 0.0::double z from ring")
def orbit_apply(spark, sf_dir):
    """Camera centres turned by one step about the orbit's axis."""
    step = np.radians(synthetic.STEP)
    turn = V.rotation_from_axis_angle([F.lit(0.0), F.lit(0.0), F.lit(float(step))])
    moved = V.matvec(turn, geometry.columns("cx", "cy", "cz"))
    return scene.cameras(spark, sf_dir).select("image_id", *(C.r6(x).alias(n) for x, n in zip(moved, "xyz")))


_REL = [f"({C._hom(i, j)})" for i in range(3) for j in range(3)]
_SHIFT = [f"(b.t{i} - ({' + '.join(f'{_REL[3 * i + j]}*a.t{j}' for j in range(3))}))" for i in range(3)]


@query("epipolar_residual", f"""with {scene.SEEN},
  n as (select s.point_id, s.image_id, s.order_id, s.number, (s.u - 640)/2000 p, (s.v - 480)/2000 q, x, y, z from seen s join verts on v_id = s.point_id),
  m as (select n.*, b.r0*x+b.r1*y+b.r2*z+b.t0 d0, b.r3*x+b.r4*y+b.r5*z+b.t1 d1, b.r6*x+b.r7*y+b.r8*z+b.t2 d2, {', '.join(f'{r} e{k}' for k, r in enumerate(_REL))}, {', '.join(f'{t} f{k}' for k, t in enumerate(_SHIFT))} from n join ring a using (image_id) join ring b on b.image_id = n.image_id + 1),
  g as (select *, e0*p + e1*q + e2 g0, e3*p + e4*q + e5 g1, e6*p + e7*q + e8 g2 from m)
  select point_id, image_id, order_id, number, round(abs(d0*(f1*g2 - f2*g1) + d1*(f2*g0 - f0*g2) + d2*(f0*g1 - f1*g0)) / d2, 8) residual from g""")
def epipolar_residual(spark, sf_dir):
    """b' E a for every line item: its pixel, as observed, against where the next camera truly sees its point."""
    cameras = scene.cameras(spark, sf_dir)
    other = cameras.select((F.col("image_id") - 1).alias("image_id"), *(F.col(c).alias(f"n{c}") for c in [*geometry.R, *geometry.T]))
    rows = scene.seen(spark, sf_dir).join(scene.points(spark, sf_dir).withColumnRenamed("v_id", "point_id"), "point_id")
    met = rows.join(sizes.small(cameras), "image_id").join(sizes.small(other), "image_id")
    rel = V.matmul(geometry.columns(*(f"n{c}" for c in geometry.R)), V.transpose(geometry.columns(*geometry.R)))
    met = met.withColumns({f"e{k}": x for k, x in enumerate(rel)})
    rel = geometry.columns(*(f"e{k}" for k in range(9)))
    shift = [n - m for n, m in zip(geometry.columns(*(f"n{c}" for c in geometry.T)), V.matvec(rel, geometry.columns(*geometry.T)))]
    first = [(F.col("u") - scene.CX) / scene.FOCAL, (F.col("v") - scene.CY) / scene.FOCAL, F.lit(1.0)]
    second = [p + t for p, t in zip(V.matvec(geometry.columns(*(f"n{c}" for c in geometry.R)), geometry.columns("x", "y", "z")), geometry.columns(*(f"n{c}" for c in geometry.T)))]
    residual = F.abs(V.dot3(second, V.cross3(shift, V.matvec(rel, first)))) / second[2]
    return met.select("point_id", "image_id", "order_id", "number", F.round(residual, 8).alias("residual"))


@query("signed_angle", "select o_orderkey id, round(o_totalprice / 110000 - 2.5::double, 6) angle from orders")
def signed_angle(spark, sf_dir):
    """Between a fixed axis and the same, turned by what an order's price says."""
    angle = F.col("o_totalprice") / 110000 - 2.5
    turned = [F.cos(angle), F.sin(angle), F.lit(0.0)]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(V.signed_angle3([F.lit(1.0), F.lit(0.0), F.lit(0.0)], turned, [F.lit(0.0), F.lit(0.0), F.lit(1.0)]), 6).alias("angle"))
