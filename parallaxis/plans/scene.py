"""A scene read from the given tables: suppliers are cameras, parts are points, line items are observations.

Every camera looks at the origin from an orbit; its distance follows the supplier's balance. Points lie about a sphere
whose radius follows the part's price. An observation is the projection of its point, moved by the line's discount and
tax; one in fifty (the largest quantity) is an outlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.operators import geometry, sizes
from parallaxis.plans.catalog import table

FOCAL, CX, CY = 2000.0, 640.0, 480.0

_A, _D = "radians(s_suppkey * 10.0::double)", "(0.25::double + s_acctbal / 210000)"
#: The cameras as ``ring``: image_id, r0 to r8, t0 to t2, cx, cy, cz.
RING = f"""ring as (select s_suppkey image_id, -sin({_A}) r0, cos({_A}) r1, 0.0::double r2, 0.0::double r3, 0.0::double r4, -1.0::double r5, -cos({_A}) r6, -sin({_A}) r7, 0.0::double r8,
  0.0::double t0, 0.0::double t1, {_D} t2, {_D} * cos({_A}) cx, {_D} * sin({_A}) cy, 0.0::double cz from supplier)"""
_PHI, _THETA, _RHO = "(0.3::double + (p_partkey * 13 % 250) / 100.0::double)", "((p_partkey * 29 % 628) / 100.0::double)", "(0.05::double * p_retailprice / 1000)"
#: The points as ``verts``: v_id, x, y, z.
VERTS = f"verts as (select p_partkey v_id, {_RHO} * sin({_PHI}) * cos({_THETA}) x, {_RHO} * sin({_PHI}) * sin({_THETA}) y, {_RHO} * cos({_PHI}) z from part)"
#: What each line item sees, as ``seen``: point_id, image_id, number, order_id, the point in the camera's frame, and the pixel observed.
SEEN = f"""{RING}, {VERTS},
  cam as (select l_partkey point_id, l_suppkey image_id, l_linenumber number, l_orderkey order_id, l_discount, l_tax, l_quantity, r0*x+r1*y+r2*z+t0 xc, r3*x+r4*y+r5*z+t1 yc, r6*x+r7*y+r8*z+t2 zc
    from lineitem join verts on v_id = l_partkey join ring on image_id = l_suppkey),
  seen as (select *, 2000*xc/zc + 640 + (l_discount - 0.05::double)*8 + case when l_quantity >= 50 then 15 else 0 end u, 2000*yc/zc + 480 + (l_tax - 0.04::double)*8 v from cam)"""


def cameras(spark, sf_dir: str) -> DataFrame:
    """(image_id, r0..r8, t0..t2, cx, cy, cz): one camera for each supplier."""
    a, d, zero = F.radians(F.col("s_suppkey") * 10.0), 0.25 + F.col("s_acctbal") / 210000, F.lit(0.0)
    c, s = F.cos(a), F.sin(a)
    rows = [-s, c, zero, zero, zero, F.lit(-1.0), -c, -s, zero]
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("image_id"), *(x.alias(f"r{k}") for k, x in enumerate(rows)),
        zero.alias("t0"), zero.alias("t1"), d.alias("t2"), (d * c).alias("cx"), (d * s).alias("cy"), zero.alias("cz"),
    )


def points(spark, sf_dir: str) -> DataFrame:
    """(v_id, x, y, z): one point for each part."""
    key = F.col("p_partkey")
    phi, theta, rho = 0.3 + (key * 13 % 250) / 100.0, (key * 29 % 628) / 100.0, 0.05 * F.col("p_retailprice") / 1000
    return table(spark, sf_dir, "part").select(key.alias("v_id"), (rho * F.sin(phi) * F.cos(theta)).alias("x"), (rho * F.sin(phi) * F.sin(theta)).alias("y"), (rho * F.cos(phi)).alias("z"))


def seen(spark, sf_dir: str) -> DataFrame:
    """(point_id, image_id, number, order_id, xc, yc, zc, u, v): one row for each line item."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("v_id"), F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").alias("number"), F.col("l_orderkey").alias("order_id"), "l_discount", "l_tax", "l_quantity"
    )
    met = lines.join(points(spark, sf_dir), "v_id").join(sizes.small(cameras(spark, sf_dir)), "image_id")
    frame = met.withColumns(dict(zip(("xc", "yc", "zc"), geometry.camera_frame(geometry.columns("x", "y", "z")))))
    u = FOCAL * F.col("xc") / F.col("zc") + CX + (F.col("l_discount") - 0.05) * 8 + F.when(F.col("l_quantity") >= 50, 15).otherwise(0)
    v = FOCAL * F.col("yc") / F.col("zc") + CY + (F.col("l_tax") - 0.04) * 8
    return frame.select(F.col("v_id").alias("point_id"), "image_id", "number", "order_id", "xc", "yc", "zc", u.alias("u"), v.alias("v"))


#: Size of the rasters.
WIDTH, HEIGHT = 32, 24
#: Pixels of a task.
TASK_PIXELS = 2_000_000
#: One image for each supplier as ``rast``: image_id, y, x, v.
RASTER = f"""cell as (select l_suppkey image_id, l_partkey % {HEIGHT} y, l_orderkey % {WIDTH} x, sum(l_quantity) v from lineitem group by all),
  rast as (select s_suppkey image_id, a.y, b.x, coalesce(v, 0.0::double) % 256 v from supplier cross join range({HEIGHT}) a(y) cross join range({WIDTH}) b(x) left join cell on cell.image_id = s_suppkey and cell.y = a.y and cell.x = b.x)"""


def lattice(images: DataFrame, width: int, height: int) -> DataFrame:
    """``images``, a row for every pixel (y, x) of each.

    A join with the grid, as Spark takes an exploded frame for no larger than what it was exploded from and would then
    broadcast all pixels. Few rows of a small file become very many, so they are dealt out first, and into more tasks
    where there are more of them: what a task holds of its pixels stays the same.
    """
    spark = images.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-images.count() * width * height // TASK_PIXELS))
    grid = spark.range(width * height).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    return images.repartition(tasks, "image_id").crossJoin(F.broadcast(grid))


def raster(spark, sf_dir: str) -> DataFrame:
    """(image_id, y, x, v): quantities of each supplier's line items, by part and order modulo the image's sides."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % HEIGHT).alias("y"), (F.col("l_orderkey") % WIDTH).alias("x")).agg(F.sum("l_quantity").alias("v"))
    whole = lattice(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id")), WIDTH, HEIGHT)
    return whole.join(lines, ["image_id", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)) % 256)
