"""Cameras, points and depth maps of the scene that the tables hold, made by the same formulas on both engines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parallaxis.functions import vectors as V
from parallaxis.operators import geometry, sizes, views
from parallaxis.plans import scene
from parallaxis.plans.catalog import query, table
from parallaxis.sources import synthetic
from parallaxis.sources.images import SENSORS, focal_pixels, sensor_width

W, H, FOCAL, CX, CY = 32, 24, 50.0, 16.0, 12.0


def r6(x) -> F.Column:
    """Rounded, without a negative zero."""
    return F.round(x, 6) + 0.0


_RING, _VERTS = scene.RING, scene.VERTS


def _r(name: str) -> str:
    return f"round({name}, 6) + 0.0::double {name.split('.')[-1]}"


@query("gen_lookat_pose", f"with {_RING} select image_id, {', '.join(_r(c) for c in [*geometry.R, *geometry.T, 'cx', 'cy', 'cz'])} from ring")
def gen_lookat_pose(spark, sf_dir):
    return scene.cameras(spark, sf_dir).select("image_id", *(r6(c).alias(c) for c in [*geometry.R, *geometry.T, "cx", "cy", "cz"]))


@query("cam_center", f"with {_RING} select image_id, {_r('cx')}, {_r('cy')}, {_r('cz')} from ring")
def cam_center(spark, sf_dir):
    """From rotation and translation alone."""
    return scene.cameras(spark, sf_dir).select("image_id", *(r6(x).alias(n) for x, n in zip(geometry.centre(), ("cx", "cy", "cz"))))


@query("project_matrix", f"with {_RING} select image_id, " + ", ".join(f"round({k}, 6) + 0.0::double p{n}" for n, k in enumerate(
    [f"2000*r{c} + 640*r{6 + c}" for c in range(3)] + ["2000*t0 + 640*t2"] + [f"2000*r{3 + c} + 480*r{6 + c}" for c in range(3)] + ["2000*t1 + 480*t2"] + [f"r{6 + c}" for c in range(3)] + ["t2"])) + " from ring")
def project_matrix(spark, sf_dir):
    """K [R t], row-major."""
    k = [F.lit(x) for x in (synthetic.FOCAL, 0.0, synthetic.CENTER_X, 0.0, synthetic.FOCAL, synthetic.CENTER_Y, 0.0, 0.0, 1.0)]
    kr, kt = V.matmul(k, geometry.columns(*geometry.R)), V.matvec(k, geometry.columns(*geometry.T))
    p = [x for row in range(3) for x in (*kr[3 * row : 3 * row + 3], kt[row])]
    return scene.cameras(spark, sf_dir).select("image_id", *(r6(x).alias(f"p{n}") for n, x in enumerate(p)))


_TRACE = " + ".join(f"a.r{k}*b.r{k}" for k in range(9))


@query("rot_angle", f"with {_RING} select a.image_id image_i, b.image_id image_j, round(degrees(acos(greatest(-1.0::double, least(1.0::double, ({_TRACE} - 1)/2)))), 4) + 0.0::double angle from ring a join ring b on b.image_id = a.image_id + 3")
def rot_angle(spark, sf_dir):
    a = scene.cameras(spark, sf_dir).select(F.col("image_id").alias("image_i"), *(F.col(c).alias(f"a{c}") for c in geometry.R))
    b = scene.cameras(spark, sf_dir).select(F.col("image_id").alias("image_j"), *geometry.R)
    met = a.join(sizes.small(b), F.col("image_j") == F.col("image_i") + 3)
    angle = V.rotation_angle(geometry.columns(*(f"a{c}" for c in geometry.R)), geometry.columns(*geometry.R))
    return met.select("image_i", "image_j", (F.round(angle, 4) + 0.0).alias("angle"))


_BASE = "degrees(acos(greatest(-1.0::double, least(1.0::double, (a.cx*b.cx + a.cy*b.cy + a.cz*b.cz) / (sqrt(a.cx*a.cx + a.cy*a.cy + a.cz*a.cz) * sqrt(b.cx*b.cx + b.cy*b.cy + b.cz*b.cz))))))"


def _pairs(spark, sf_dir) -> DataFrame:
    """Each camera with the next ten."""
    a = scene.cameras(spark, sf_dir).select(F.col("image_id").alias("image_i"), *(F.col(c).alias(f"a{c}") for c in ("cx", "cy", "cz")))
    a = a.withColumn("image_j", F.explode(F.sequence(F.col("image_i") + 1, F.col("image_i") + 10)))
    b = scene.cameras(spark, sf_dir).select(F.col("image_id").alias("image_j"), "cx", "cy", "cz")
    angle = views.baseline_angle(geometry.columns("acx", "acy", "acz"), geometry.columns("cx", "cy", "cz"), [F.lit(0.0)] * 3)
    return a.join(sizes.small(b), "image_j").select("image_i", "image_j", angle.alias("baseline_deg"))


@query("baseline_angle", f"with {_RING} select a.image_id image_i, b.image_id image_j, round({_BASE}, 4) + 0.0::double baseline_deg from ring a join ring b on b.image_id - a.image_id between 1 and 10")
def baseline_angle(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("baseline_deg", F.round("baseline_deg", 4) + 0.0)


@query("select_sources", f"""with {_RING}, p as (select a.image_id ref_id, b.image_id src_id, round({_BASE}, 4) deg from ring a join ring b on abs(a.image_id - b.image_id) between 1 and 10),
  s as (select *, case when deg < 5 or deg > 90 then 0.0::double else sin(radians(greatest(5.0::double, least(30.0::double, deg)))) end score from p),
  r as (select *, row_number() over (partition by ref_id order by round(score, 6) desc, src_id) rank from s where score > 0) select ref_id, src_id, rank, round(score, 6) score from r where rank <= 5""")
def select_sources(spark, sf_dir):
    """The five best source views of each camera among its neighbours, with equal covisibility."""
    pairs = _pairs(spark, sf_dir).select("image_i", "image_j", F.lit(1).alias("shared"), F.round("baseline_deg", 4).alias("baseline_deg"))
    scored = views.source_candidates(pairs).withColumn("score", F.round("score", 6))
    return views.top_sources(scored, 5).select("ref_id", "src_id", F.col("rank").cast("long").alias("rank"), "score")


def _hom(i: int, j: int) -> str:
    return f"(b.r{3*i}*a.r{3*j} + b.r{3*i+1}*a.r{3*j+1} + b.r{3*i+2}*a.r{3*j+2})"


@query("homography_params", f"with {_RING} select a.image_id ref_id, b.image_id src_id, " + ", ".join(f"round({_hom(i, j)}, 6) + 0.0::double rel{3*i+j}" for i in range(3) for j in range(3)) + ", " + ", ".join(
    f"round(b.t{i} - ({_hom(i,0)}*a.t0 + {_hom(i,1)}*a.t1 + {_hom(i,2)}*a.t2), 6) + 0.0::double b{i}" for i in range(3)) + " from ring a join ring b on b.image_id = a.image_id + 2")
def homography_params(spark, sf_dir):
    """Relative pose of a source to its reference; calibrations left out."""
    a = scene.cameras(spark, sf_dir).select(F.col("image_id").alias("ref_id"), *(F.col(c).alias(f"a{c}") for c in [*geometry.R, *geometry.T]))
    b = scene.cameras(spark, sf_dir).select(F.col("image_id").alias("src_id"), *geometry.R, *geometry.T)
    met = a.join(sizes.small(b), F.col("src_id") == F.col("ref_id") + 2)
    rel = V.matmul(geometry.columns(*geometry.R), V.transpose(geometry.columns(*(f"a{c}" for c in geometry.R))))
    moved = [t - x for t, x in zip(geometry.columns(*geometry.T), V.matvec(rel, geometry.columns("at0", "at1", "at2")))]
    return met.select("ref_id", "src_id", *(r6(x).alias(f"rel{k}") for k, x in enumerate(rel)), *(r6(x).alias(f"b{k}") for k, x in enumerate(moved)))


@query("gen_sphere_mesh", f"with {_VERTS} select v_id, round(x, 8) + 0.0::double x, round(y, 8) + 0.0::double y, round(z, 8) + 0.0::double z from verts")
def gen_sphere_mesh(spark, sf_dir):
    return scene.points(spark, sf_dir).select("v_id", *((F.round(c, 8) + 0.0).alias(c) for c in "xyz"))


_FACES = """size as (select count(*) // 40 n from part), g as (select p_partkey p, (p_partkey // 40) * 40 + (p_partkey + 1) % 40 r, ((p_partkey // 40 + 1) % n) * 40 + p_partkey % 40 d, ((p_partkey // 40 + 1) % n) * 40 + (p_partkey + 1) % 40 dr from part, size where p_size < 50),
  faces as (select p v0, d v1, r v2 from g union all select r, d, dr from g)"""


def faces(spark, sf_dir) -> DataFrame:
    """(v0, v1, v2): parts on a torus of forty columns, two triangles for each; the largest ones leave holes."""
    parts = table(spark, sf_dir, "part")
    rows = parts.count() // 40
    key = F.col("p_partkey")
    row, right, down = F.floor(key / 40), (key + 1) % 40, (F.floor(key / 40) + 1) % rows * 40
    p, r, d, dr = key, row * 40 + right, down + key % 40, down + right
    two = F.array(*(F.struct(a.alias("v0"), b.alias("v1"), c.alias("v2")) for a, b, c in ((p, d, r), (r, d, dr))))
    return parts.filter("p_size < 50").select(F.explode(two).alias("f")).select("f.*")


@query("watertight", f"""with {_FACES}, e as (select v0 a, v1 b from faces union all select v1, v2 from faces union all select v2, v0 from faces),
  n as (select least(a, b), greatest(a, b), count(*) n from e group by 1, 2) select (select count(*) from faces) faces, count(*) edges, count_if(n <> 2)::bigint odd, bool_and(n = 2) watertight from n""")
def watertight(spark, sf_dir):
    """Whether exactly two faces share every edge, and how many edges they do not."""
    edge = F.explode(F.array(*(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0")))))
    counted = faces(spark, sf_dir).select(edge.alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg((F.sum("n") / 3).cast("long").alias("faces"), F.count(F.lit(1)).alias("edges"), F.count_if(F.col("n") != 2).alias("odd"), F.bool_and(F.col("n") == 2).alias("watertight"))


_OBS = f"""{scene.SEEN}, err as (select point_id, image_id, zc depth, sqrt((2000*xc/zc + 640 - u)**2 + (2000*yc/zc + 480 - v)**2) error from seen)"""


def _errors(spark, sf_dir) -> DataFrame:
    points = scene.points(spark, sf_dir).withColumnRenamed("v_id", "point_id")
    return geometry.reprojected(scene.seen(spark, sf_dir).select("point_id", "image_id", "u", "v"), points, sizes.small(scene.cameras(spark, sf_dir)), scene.FOCAL, scene.CX, scene.CY)


@query("mean_reproj_global", f"with {_OBS} select round(avg(error), 4) mean_error from err")
def mean_reproj_global(spark, sf_dir):
    return geometry.mean_error(_errors(spark, sf_dir)).select(F.round("mean_error", 4).alias("mean_error"))


@query("reproject", f"with {_OBS} select image_id, count(*) n, round(max(error), 4) worst from err group by all")
def reproject(spark, sf_dir):
    return _errors(spark, sf_dir).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("error"), 4).alias("worst"))


@query("mean_reproj_point", f"with {_OBS} select point_id, round(avg(error), 4) mean_error, count(*) track from err group by all")
def mean_reproj_point(spark, sf_dir):
    return geometry.point_errors(_errors(spark, sf_dir)).withColumn("mean_error", F.round("mean_error", 4))


@query("mean_reproj_penalised", f"with {_OBS} select point_id, round(avg(case when depth > 0.22 then error else 999.0 end), 3) mean_error, count(*) track from err group by all")
def mean_reproj_penalised(spark, sf_dir):
    """Observations nearer than 0.22 stand for ones behind their camera."""
    errors = _errors(spark, sf_dir).withColumn("error", F.when(F.col("depth") > 0.22, F.col("error")))
    return geometry.penalised_errors(errors).withColumn("mean_error", F.round("mean_error", 3))


@query("pred_cheirality", f"""with {_RING}, {_VERTS}, o as (select l_suppkey image_id, l_suppkey + 9 other, x, y, z from lineitem join verts on v_id = l_partkey)
  select image_id, count(*) n from o join ring a using (image_id) join ring b on b.image_id = other where 6*(a.r6*x+a.r7*y+a.r8*z)+a.t2 > 1e-9 and 6*(b.r6*x+b.r7*y+b.r8*z)+b.t2 > 1e-9 group by all""")
def pred_cheirality(spark, sf_dir):
    """Line items whose point, on a sphere that reaches behind the cameras, is before its camera and the ninth after it."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("v_id"), F.col("l_suppkey").alias("image_id"))
    points = scene.points(spark, sf_dir).select("v_id", *((6 * F.col(c)).alias(c) for c in "xyz"))
    cameras = scene.cameras(spark, sf_dir).select("image_id", *geometry.R, *geometry.T)
    depth = geometry.camera_frame(geometry.columns("x", "y", "z"))[2]
    first = lines.join(points, "v_id").join(sizes.small(cameras), "image_id").select(F.col("image_id").alias("own"), (F.col("image_id") + 9).alias("image_id"), "x", "y", "z", depth.alias("a"))
    both = first.join(sizes.small(cameras), "image_id").select("own", "a", depth.alias("b"))
    return both.filter(geometry.in_front("a", "b", least=1e-9)).groupBy(F.col("own").alias("image_id")).agg(F.count(F.lit(1)).alias("n"))


@query("pred_reproj", f"with {_OBS} select count(*) n from err where error <= 0.5")
def pred_reproj(spark, sf_dir):
    return _errors(spark, sf_dir).filter("error <= 0.5").agg(F.count(F.lit(1)).alias("n"))


@query("point_filter_sfm", f"with {_OBS}, p as (select point_id, avg(error) e, count(*) track from err group by all) select point_id, track from p where e <= 0.45 and track >= 2")
def point_filter_sfm(spark, sf_dir):
    return geometry.filter_points(geometry.point_errors(_errors(spark, sf_dir)), 0.45).select("point_id", "track")


@query("point_filter_ba", f"with {_OBS}, p as (select point_id, avg(error) e, count(*) track from err group by all) select count(*) kept from p where e <= 0.5 and track >= 10")
def point_filter_ba(spark, sf_dir):
    return geometry.filter_points(geometry.penalised_errors(_errors(spark, sf_dir)), 0.5, 10).agg(F.count(F.lit(1)).alias("kept"))


_DEPTH = f"""{_RING}, px as (select x, y, (x - {CX}::double)/{FOCAL} rx, (y - {CY}::double)/{FOCAL} ry from range({W}) a(x), range({H}) b(y)),
  disc as (select image_id, x, y, rx*rx + ry*ry + 1 a, t2 b, t2*t2 - 0.05::double*0.05::double c from ring, px),
  depth as (select image_id, x, y, (b - sqrt(b*b - a*c)) / a depth from disc where b*b - a*c >= 0)"""


def depths(spark, sf_dir) -> DataFrame:
    return synthetic.on_sphere(scene.lattice(scene.cameras(spark, sf_dir), W, H), FOCAL, CX, CY)


@query("gen_render", f"with {_DEPTH} select image_id, x, y, round(depth, 6) depth from depth")
def gen_render(spark, sf_dir):
    return depths(spark, sf_dir).withColumn("depth", F.round("depth", 6))


@query("depth_map_lookup", f"with {_DEPTH} select a.image_id ref_id, b.image_id src_id, count(*) n from depth a join depth b on b.image_id = a.image_id + 1 and a.x = b.x and a.y = b.y group by all")
def depth_map_lookup(spark, sf_dir):
    own = depths(spark, sf_dir).select(F.col("image_id").alias("ref_id"), (F.col("image_id") + 1).alias("src_id"), "x", "y")
    other = depths(spark, sf_dir).select(F.col("image_id").alias("src_id"), "x", "y")
    return own.join(other, ["src_id", "x", "y"]).groupBy("ref_id", "src_id").agg(F.count(F.lit(1)).alias("n"))


_GEOM = f"""{_DEPTH}, src as (select image_id, image_id + k src_id from ring, (values (-4), (-2), (2), (4)) t(k)),
  lifted as (select d.image_id, d.x, d.y, d.depth, s.src_id, (d.x - {CX}::double)/{FOCAL}*d.depth - a.t0 q0, (d.y - {CY}::double)/{FOCAL}*d.depth - a.t1 q1, d.depth - a.t2 q2,
    a.r0, a.r1, a.r2, a.r3, a.r4, a.r5, a.r6, a.r7, a.r8 from depth d join src s using (image_id) join ring a using (image_id)),
  world as (select *, r0*q0+r3*q1+r6*q2 wx, r1*q0+r4*q1+r7*q2 wy, r2*q0+r5*q1+r8*q2 wz from lifted),
  moved as (select w.image_id, w.x, w.y, w.depth, w.src_id, b.r6*wx+b.r7*wy+b.r8*wz+b.t2 z, {FOCAL}*(b.r0*wx+b.r1*wy+b.r2*wz+b.t0)/(b.r6*wx+b.r7*wy+b.r8*wz+b.t2)+{CX} u, {FOCAL}*(b.r3*wx+b.r4*wy+b.r5*wz+b.t1)/(b.r6*wx+b.r7*wy+b.r8*wz+b.t2)+{CY} v from world w join ring b on b.image_id = w.src_id),
  agree as (select m.image_id, m.x, m.y, count(distinct m.src_id) views from moved m join depth o on o.image_id = m.src_id and o.x = round_even(round(m.u, 6), 0)::bigint and o.y = round_even(round(m.v, 6), 0)::bigint
    where m.z > 0 and abs(o.depth - m.z) <= 0.12 * m.z group by all),
  consistent as (select d.image_id, d.x, d.y, d.depth, coalesce(a.views, 0) views from depth d left join agree a using (image_id, x, y))"""


def _consistent(spark, sf_dir) -> DataFrame:
    cameras = scene.cameras(spark, sf_dir)
    sources = cameras.select("image_id", F.explode(F.array(*(F.col("image_id") + k for k in (-4, -2, 2, 4)))).alias("src_id"))
    return geometry.consistent_views(depths(spark, sf_dir), cameras, sources, FOCAL, CX, CY)


@query("geom_consistency_join", f"with {_GEOM} select image_id, sum(views)::bigint agreements from consistent group by all")
def geom_consistency_join(spark, sf_dir):
    return _consistent(spark, sf_dir).groupBy("image_id").agg(F.sum("views").alias("agreements"))


@query("geom_filter", f"with {_GEOM} select image_id, count(*) kept from consistent where views >= 2 group by all")
def geom_filter(spark, sf_dir):
    return geometry.filtered_depths(_consistent(spark, sf_dir)).filter("depth is not null").groupBy("image_id").agg(F.count(F.lit(1)).alias("kept"))


@query("retention_stats", f"with {_GEOM} select image_id, count_if(views >= 2)::bigint kept, count(*) total from consistent group by rollup (image_id)")
def retention_stats(spark, sf_dir):
    return geometry.retention(geometry.filtered_depths(_consistent(spark, sf_dir)))


@query("depth_accuracy", f"with {_DEPTH} select count(*) n, round(avg(abs(round(depth, 2) - depth) / depth), 6) mean_relative, count_if(abs(round(depth, 2) - depth) <= 0.01 * depth)::bigint close from depth")
def depth_accuracy(spark, sf_dir):
    """Depths to two decimals against exact ones."""
    error = F.abs(F.round("depth", 2) - F.col("depth")) / F.col("depth")
    close = F.abs(F.round("depth", 2) - F.col("depth")) <= 0.01 * F.col("depth")
    return depths(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(error), 6).alias("mean_relative"), F.count_if(close).alias("close"))


@query("scene_centroid", f"with {_VERTS} select count(*) n, round(avg(x), 8) + 0.0::double x, round(avg(y), 8) + 0.0::double y, round(avg(z), 8) + 0.0::double z from verts")
def scene_centroid(spark, sf_dir):
    return scene.points(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *((F.round(F.avg(c), 8) + 0.0).alias(c) for c in "xyz"))


@query("sphere_fit", f"with {_VERTS}, c as (select avg(x) mx, avg(y) my, avg(z) mz from verts) select round(avg(sqrt((x-mx)**2 + (y-my)**2 + (z-mz)**2)), 8) radius from verts, c")
def sphere_fit(spark, sf_dir):
    own = scene.points(spark, sf_dir)
    mean = own.agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    gone = [F.col(c) - F.col(f"m{c}") for c in "xyz"]
    return own.crossJoin(F.broadcast(mean)).agg(F.round(F.avg(V.norm3(gone)), 8).alias("radius"))


@query("scene_diameter", f"with {_RING}, e as (select k, max(cx*cos(k*pi()/64) + cy*sin(k*pi()/64)) - min(cx*cos(k*pi()/64) + cy*sin(k*pi()/64)) extent from ring, range(64) t(k) group by k) select round(max(extent), 8) diameter from e")
def scene_diameter(spark, sf_dir):
    """The widest extent of the camera centres over 64 directions of their plane, within 0.04 % of the largest distance."""
    along = [F.col("cx") * math.cos(k * math.pi / 64) + F.col("cy") * math.sin(k * math.pi / 64) for k in range(64)]
    wide = scene.cameras(spark, sf_dir).agg(*((F.max(x) - F.min(x)).alias(f"e{k}") for k, x in enumerate(along)))
    return wide.select(F.round(F.greatest(*wide.columns), 8).alias("diameter"))


@query("orbit_radius", f"with {_RING} select round(avg(sqrt(cx*cx + cy*cy)), 8) radius from ring")
def orbit_radius(spark, sf_dir):
    return scene.cameras(spark, sf_dir).agg(F.round(F.avg(F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2)), 8).alias("radius"))


def _solved(m: list[str], b: list[str]) -> list[str]:
    """SQL of the solution of a 3 x 3 system, by cofactors."""
    minor = lambda r, c: "({0}*{3} - {1}*{2})".format(*(m[3 * i + j] for i in range(3) if i != r for j in range(3) if j != c))
    det = " + ".join(f"({'-' if c % 2 else ''}{m[c]}*{minor(0, c)})" for c in range(3))
    return ["(" + " + ".join(f"({'-' if (r + c) % 2 else ''}{minor(r, c)}*{b[r]})" for r in range(3)) + f") / ({det})" for c in range(3)]


_TILT = "sqrt(r6*r6 + r7*r7 + (s_nationkey / 500.0::double)**2)"
_RAY = f"with {_RING}, ray as (select cx c0, cy c1, cz c2, r6/{_TILT} d0, r7/{_TILT} d1, (s_nationkey / 500.0::double)/{_TILT} d2 from ring join supplier on s_suppkey = image_id), n as (select " + ", ".join(
    f"sum({int(i == j)} - d{i}*d{j}) m{3 * i + j}" for i in range(3) for j in range(3)) + ", " + ", ".join("sum(" + " + ".join(f"({int(i == j)} - d{i}*d{j})*c{j}" for j in range(3)) + f") b{i}" for i in range(3)) + " from ray) select "


@query("ray_intersection_lsq", _RAY + ", ".join(f"round({x}, 6) + 0.0::double {n}" for x, n in zip(_solved([f"m{k}" for k in range(9)], ["b0", "b1", "b2"]), "xyz")) + " from n")
def ray_intersection_lsq(spark, sf_dir):
    """The point nearest to all viewing axes, each tilted by its supplier's nation."""
    tilt = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), (F.col("s_nationkey") / 500.0).alias("d2"))
    met = scene.cameras(spark, sf_dir).join(tilt, "image_id")
    away = V.unit3(geometry.columns("r6", "r7", "d2"))
    rays = met.select(F.col("cx").alias("c0"), F.col("cy").alias("c1"), F.col("cz").alias("c2"), *(x.alias(f"d{k}") for k, x in enumerate(away)))
    return geometry.rays_meet(rays).select(*(r6(c).alias(c) for c in "xyz"))


_CIRC = _solved([f"m{k}" for k in range(9)], ["b0", "b1", "b2"])


@query("circle_fit", f"with {_RING}, p as (select cx + 0.1::double u, cy - 0.2::double v, (cx + 0.1::double)**2 + (cy - 0.2::double)**2 w from ring), n as (select sum(4*u*u) m0, sum(4*u*v) m1, sum(2*u) m2, sum(4*u*v) m3, sum(4*v*v) m4, sum(2*v) m5, sum(2*u) m6, sum(2*v) m7, count(*)::double m8, sum(2*u*w) b0, sum(2*v*w) b1, sum(w) b2 from p), "
    f"s as (select {_CIRC[0]} a, {_CIRC[1]} b, {_CIRC[2]} c from n) select round(a, 6) a, round(b, 6) b, round(sqrt(c + a*a + b*b), 6) radius from s")  # fmt: skip
def circle_fit(spark, sf_dir):
    """The circle nearest to all camera centres, moved by (0.1, -0.2)."""
    return geometry.circle_fit(scene.cameras(spark, sf_dir).select((F.col("cx") + 0.1).alias("u"), (F.col("cy") - 0.2).alias("v"))).select(*(r6(c).alias(c) for c in ("a", "b", "radius")))


@query("axis_weighted_mean", f"""with {_RING}, s as (select a.image_id, (a.r7*b.r6 - a.r6*b.r7) k from ring a join ring b on b.image_id = a.image_id + 1)
  select 0.0::double x, 0.0::double y, 1.0::double z, count(*) used from s where abs(k) > 1e-9""")
def axis_weighted_mean(spark, sf_dir):
    """Rotation axes between neighbours, weighted by angle and turned to one side, average to the orbit's axis."""
    a = scene.cameras(spark, sf_dir).select("image_id", *(F.col(c).alias(f"a{c}") for c in geometry.R))
    b = scene.cameras(spark, sf_dir).select((F.col("image_id") - 1).alias("image_id"), *geometry.R)
    met = a.join(sizes.small(b), "image_id")
    rel = V.matmul(V.transpose(geometry.columns(*(f"a{c}" for c in geometry.R))), geometry.columns(*geometry.R))
    turn = V.axis_angle_from_rotation(rel)
    side = F.when(turn[2] < 0, -1.0).otherwise(1.0)
    turned = met.select(*((x * side).alias(n) for x, n in zip(turn, "xyz")))
    angle = F.degrees(V.norm3(geometry.columns("x", "y", "z")))
    sums = turned.filter(angle.between(0.3, 100)).agg(*(F.sum(c).alias(c) for c in "xyz"), F.count(F.lit(1)).alias("used"))
    return sums.select(*(r6(x).alias(n) for x, n in zip(V.unit3(geometry.columns("x", "y", "z")), "xyz")), "used")


@query("axis_angle_round_trip", "select c_custkey id, round(c_acctbal / 21000, 6) + 0.0::double x, round((c_nationkey - 12) * 0.027::double, 6) + 0.0::double y, round((c_custkey % 7 - 3) * 0.19::double, 6) + 0.0::double z from customer")
def axis_angle_round_trip(spark, sf_dir):
    w = [F.col("c_acctbal") / 21000, (F.col("c_nationkey") - 12) * 0.027, (F.col("c_custkey") % 7 - 3) * 0.19]
    rotated = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *(x.alias(f"r{k}") for k, x in enumerate(V.rotation_from_axis_angle(w))))
    return rotated.select("id", *(r6(x).alias(n) for x, n in zip(V.axis_angle_from_rotation(geometry.columns(*geometry.R)), "xyz")))


_M = ["l_quantity", "l_discount", "1.0::double", "l_tax", "(l_linenumber + 3.0::double)", "0.5::double", "-0.25::double", "l_discount", "(l_extendedprice / 1000 + 4)"]
_INV = [_solved(_M, [f"{int(r == c)}.0::double" for r in range(3)]) for c in range(3)]


@query("mat_inverse", "select l_orderkey id, l_linenumber number, l_partkey part, l_suppkey supp, " + ", ".join(f"round({_INV[c][r]}, 6) + 0.0::double i{3 * r + c}" for r in range(3) for c in range(3)) + " from lineitem")
def mat_inverse(spark, sf_dir):
    m = [F.col("l_quantity"), F.col("l_discount"), F.lit(1.0), F.col("l_tax"), F.col("l_linenumber") + 3.0, F.lit(0.5), F.lit(-0.25), F.col("l_discount"), F.col("l_extendedprice") / 1000 + 4]
    keys = [F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")]
    own = table(spark, sf_dir, "lineitem").select(*keys, *(x.cast("double").alias(f"m{k}") for k, x in enumerate(m)))
    return own.select("id", "number", "part", "supp", *(r6(x).alias(f"i{k}") for k, x in enumerate(V.inverse(geometry.columns(*(f"m{k}" for k in range(9)))))))


@query("triangulate_rays", f"with {_VERTS}, d as (select l_partkey v_id from lineitem group by 1 having count(distinct l_suppkey) > 1) select v_id point_id, round(x, 6) + 0.0::double x, round(y, 6) + 0.0::double y, round(z, 6) + 0.0::double z from verts join d using (v_id)")
def triangulate_rays(spark, sf_dir):
    """Every part that two suppliers' line items see at least, found again from the rays along which they see it."""
    seen = scene.seen(spark, sf_dir).join(sizes.small(scene.cameras(spark, sf_dir)), "image_id")
    turned = [x - t for x, t in zip(geometry.columns("xc", "yc", "zc"), geometry.columns(*geometry.T))]
    away = V.unit3([w - c for w, c in zip(V.matvec(V.transpose(geometry.columns(*geometry.R)), turned), geometry.columns("cx", "cy", "cz"))])
    several = seen.groupBy("point_id").agg(F.countDistinct("image_id").alias("views")).filter("views > 1").select("point_id")
    rays = seen.select("point_id", F.col("cx").alias("c0"), F.col("cy").alias("c1"), F.col("cz").alias("c2"), *(x.alias(f"d{k}") for k, x in enumerate(away)))
    return geometry.rays_meet(rays.join(several, "point_id", "left_semi"), "point_id").select("point_id", *(r6(c).alias(c) for c in "xyz"))


_DEVICES = [("Apple", "iPhone 13"), ("Apple", "iPhone 14 Pro"), ("APPLE inc", "iphone 15 pro max"), ("Google", "Pixel 8"), ("Google", "Pixel 8 Pro"), ("google", "Pixel 7"), ("Samsung", "Galaxy S24 Ultra"), ("samsung", "Galaxy S24"), ("Samsung", "A52"), ("Nokia", "9")]
_DEVICE_SQL = "k(k, make, model) as (values " + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(_DEVICES)) + "), d as (select c_custkey, c_acctbal, make, model from customer join k on k = c_custkey % 10)"


def _devices(spark, sf_dir) -> DataFrame:
    """Customers, each with the device that its key names."""
    named = F.array(*(F.struct(F.lit(a).alias("make"), F.lit(b).alias("model")) for a, b in _DEVICES))
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.get(named, (F.col("c_custkey") % 10).cast("int")).alias("d"))
    return own.select("c_custkey", "c_acctbal", "d.*")


_SENSOR_SQL = "case " + " ".join(f"when contains(lower(make), '{brand}') then case " + " ".join(f"when contains(lower(model), '{part}') then {width}::double" for part, width in models) + " end" for brand, models in SENSORS) + " else 0.0::double end"


@query("sensor_width_lookup", f"with {_DEVICE_SQL} select c_custkey, make, model, {_SENSOR_SQL} width from d")
def sensor_width_lookup(spark, sf_dir):
    return _devices(spark, sf_dir).select("c_custkey", "make", "model", sensor_width(F.col("make"), F.col("model")).alias("width"))


@query("intrinsics", f"""with {_DEVICE_SQL}, c as (select c_custkey, make, model, case when c_custkey % 3 = 0 then 0.0::double else 2 + abs(c_acctbal) / 1000 end f, case when c_custkey % 5 = 0 then 6.5::double else 0.0::double end o from d)
  select c_custkey, f, o, round(case when o > 0 then o else coalesce(nullif(f, 0), 28.0::double * w / 36) end * 1280 / w, 6) fx, 640.0::double cx, 480.0::double cy
  from (select *, coalesce(nullif({_SENSOR_SQL}, 0.0::double), 6.0::double) w from c)""")
def intrinsics(spark, sf_dir):
    """Focal length by override, then EXIF, then 28 mm equivalent; sensor by table, then 6 mm."""
    f = F.when(F.col("c_custkey") % 3 == 0, 0.0).otherwise(2 + F.abs("c_acctbal") / 1000)
    own = _devices(spark, sf_dir).withColumns({"f": f, "o": F.when(F.col("c_custkey") % 5 == 0, 6.5).otherwise(0.0)})
    fx = focal_pixels(F.col("make"), F.col("model"), F.col("f"), F.lit(1280), F.col("o"))
    return own.select("c_custkey", "f", "o", F.round(fx, 6).alias("fx"), F.lit(640.0).alias("cx"), F.lit(480.0).alias("cy"))


@query("pixel_ranges", f"with {_DEPTH} select image_id, round(min(depth), 6) depth_min, round(max(depth), 6) depth_max from depth group by all")
def pixel_ranges(spark, sf_dir):
    return depths(spark, sf_dir).groupBy("image_id").agg(F.round(F.min("depth"), 6).alias("depth_min"), F.round(F.max("depth"), 6).alias("depth_max"))


@query("pose_error", f"with {_RING} select round(max(abs(sqrt(cx*cx+cy*cy) - 0.24::double)), 8) worst, round(avg(abs(sqrt(cx*cx+cy*cy) - 0.24::double)), 8) mean from ring")
def pose_error(spark, sf_dir):
    """Distance of centres from an orbit of radius 0.24."""
    gone = F.abs(F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2) - 0.24)
    return scene.cameras(spark, sf_dir).agg(F.round(F.max(gone), 8).alias("worst"), F.round(F.avg(gone), 8).alias("mean"))


@query("nearest_valid_both_sides", """with n as (select o_orderkey i, o_custkey c, o_orderstatus = 'F' ok from orders)
  select i, (select max(m.i) from n m where m.ok and m.c = n.c and m.i < n.i) before, (select min(m.i) from n m where m.ok and m.c = n.c and m.i > n.i) after from n where not ok""")
def nearest_valid_both_sides(spark, sf_dir):
    """For every order that is not final, its customer's nearest final ones before and after."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), "o_custkey", (F.col("o_orderstatus") == "F").alias("ok"))
    valid, by = F.when(F.col("ok"), F.col("i")), Window.partitionBy("o_custkey").orderBy("i")
    before = F.last(valid, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(valid, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    return own.select("i", "ok", before.alias("before"), after.alias("after")).filter("not ok").drop("ok")


def _noise(x: str, y: str) -> str:
    v = f"sin(({x}) * 127.1::double + ({y}) * 311.7::double) * 43758.5453::double"
    return f"({v} - floor({v}))"


@query("hash_noise", f"select p_partkey id, round({_noise('p_partkey * 0.37::double', 'p_size * 0.11::double')}, 5) noise from part")
def hash_noise(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(synthetic.hash_noise(F.col("p_partkey") * 0.37, F.col("p_size") * 0.11), 5).alias("noise"))


_UP = "(phi + pi() / 2)"
_WAVE = [f"sin(theta * {f}::double + {a}::double) * sin({_UP} * {f}::double + {b}::double)" for f, a, b in synthetic.WAVES]
_NOISE = [f"({_noise(f'theta / (2 * pi()) * {s}::double + {a}::double', f'{_UP} / pi() * {s}::double + {b}::double')} - 0.5::double)" for s, a, b in synthetic.NOISES]


def _channel(name: str) -> str:
    level, waves, noises = synthetic.CHANNELS[name]
    terms = " + ".join(f"({w})::double * {x}" for w, x in [*zip(waves, _WAVE), *zip(noises, _NOISE)])
    return f"round(greatest(0.0::double, least(1.0::double, {level}::double + {terms})), 5) {name}"


@query("gen_texture", f"with p as (select p_partkey id, (p_partkey % 25) * 0.25::double theta, p_retailprice / 1000 - 1.5::double phi from part) select id, {', '.join(map(_channel, 'rgb'))} from p")
def gen_texture(spark, sf_dir):
    made = synthetic.sphere_texture((F.col("p_partkey") % 25) * 0.25, F.col("p_retailprice") / 1000 - 1.5)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(F.round(made[c], 5).alias(c) for c in "rgb"))


@query("slerp", f"with {_RING} select image_id, " + ", ".join(f"round({x}, 6) + 0.0::double r{k}" for k, x in enumerate(
    ["-sin(radians(10.0::double * image_id + 2.5::double))", "cos(radians(10.0::double * image_id + 2.5::double))", "0.0::double", "0.0::double", "0.0::double", "-1.0::double",
     "-cos(radians(10.0::double * image_id + 2.5::double))", "-sin(radians(10.0::double * image_id + 2.5::double))", "0.0::double"])) + " from ring where image_id + 1 in (select image_id from ring)")
def slerp(spark, sf_dir):
    """A quarter of the way from each camera to the next."""
    a = scene.cameras(spark, sf_dir).select("image_id", *(F.col(c).alias(f"a{c}") for c in geometry.R))
    b = scene.cameras(spark, sf_dir).select((F.col("image_id") - 1).alias("image_id"), *geometry.R)
    names = [f"p{k}" for k in range(9)]
    part = V.between_rotations(a.join(sizes.small(b), "image_id"), [f"a{c}" for c in geometry.R], geometry.R, 0.25, names)
    return part.select("image_id", *(r6(F.col(n)).alias(f"r{k}") for k, n in enumerate(names)))
