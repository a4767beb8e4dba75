"""The turntable scene as frames: cameras on a ring, a sphere mesh, visible points and per-pixel depths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the scene.
RADIUS, DISTANCE, VIEWS, STEP = 0.05, 0.25, 36, 10.0
FOCAL, CENTER_X, CENTER_Y, WIDTH, HEIGHT = 2000.0, 640.0, 480.0, 1280, 960
RINGS, SLICES = 32, 64


def ring_cameras(spark: SparkSession, views: int = VIEWS, step: float = STEP, distance: float = DISTANCE) -> DataFrame:
    """(image_id, r0..r8, t0..t2, cx, cy, cz): cameras on a circle that look at its centre, z up."""
    a = F.radians(F.col("id") * step)
    c, s = F.cos(a), F.sin(a)
    zero = F.lit(0.0)
    rows = [-s, c, zero, zero, zero, F.lit(-1.0), -c, -s, zero]
    return spark.range(views).select(
        F.col("id").alias("image_id"), *(x.alias(f"r{k}") for k, x in enumerate(rows)),
        zero.alias("t0"), zero.alias("t1"), F.lit(distance).alias("t2"),
        (distance * c).alias("cx"), (distance * s).alias("cy"), zero.alias("cz"),
    )


def sphere_vertices(spark: SparkSession, rings: int = RINGS, slices: int = SLICES, radius: float = RADIUS) -> DataFrame:
    """(v_id, x, y, z): poles and latitude rings, ids from 0 at the top."""
    inner = (rings - 1) * slices
    i, j = F.floor(F.col("id") / slices) + 1, F.col("id") % slices
    phi, theta = i * (math.pi / rings), j * (2 * math.pi / slices)
    body = spark.range(inner).select((F.col("id") + 1).alias("v_id"), (radius * F.sin(phi) * F.cos(theta)).alias("x"), (radius * F.sin(phi) * F.sin(theta)).alias("y"), (radius * F.cos(phi)).alias("z"))
    poles = spark.range(2).select((F.col("id") * (inner + 1)).alias("v_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (radius * (1 - 2 * F.col("id"))).alias("z"))
    return body.unionByName(poles)


def sphere_faces(spark: SparkSession, rings: int = RINGS, slices: int = SLICES) -> DataFrame:
    """(f_id, v0, v1, v2): triangles over ``sphere_vertices``, seen from outside in counter-clockwise order."""
    last = (rings - 1) * slices + 1
    j = F.col("id") % slices
    after = (j + 1) % slices
    cap = spark.range(slices).select(F.col("id").alias("f_id"), F.lit(0).cast("long").alias("v0"), (j + 1).alias("v1"), (after + 1).alias("v2"))
    strips = (rings - 2) * slices
    top = F.floor(F.col("id") / slices) * slices + 1
    quads = spark.range(strips).select("id", (top + j).alias("a"), (top + after).alias("b"), (top + slices + j).alias("c"), (top + slices + after).alias("d"))
    halves = [
        quads.select((slices + 2 * F.col("id")).alias("f_id"), F.col("a").alias("v0"), F.col("c").alias("v1"), F.col("d").alias("v2")),
        quads.select((slices + 2 * F.col("id") + 1).alias("f_id"), F.col("a").alias("v0"), F.col("d").alias("v1"), F.col("b").alias("v2")),
    ]
    low = last - slices
    base = spark.range(slices).select((slices + 2 * strips + F.col("id")).alias("f_id"), F.lit(last).cast("long").alias("v0"), (low + after).alias("v1"), (low + j).alias("v2"))
    return cap.unionByName(halves[0]).unionByName(halves[1]).unionByName(base)


def lattice(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(x, y) of a pixel grid."""
    return spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))


def on_sphere(rows: DataFrame, focal: float, cx: float, cy: float, radius: float = RADIUS) -> DataFrame:
    """(image_id, x, y, depth): camera-frame z of the nearest hit of each pixel's ray with the sphere at the origin.

    ``rows`` has a camera's shift t0 to t2 and a pixel x, y.
    """
    rx, ry = (F.col("x") - cx) / focal, (F.col("y") - cy) / focal
    centre = [F.col("t0"), F.col("t1"), F.col("t2")]  # the origin in the camera frame
    a = rx * rx + ry * ry + 1
    b = rx * centre[0] + ry * centre[1] + centre[2]
    c = centre[0] * centre[0] + centre[1] * centre[1] + centre[2] * centre[2] - radius * radius
    disc = b * b - a * c
    near, far = (b - F.sqrt(disc)) / a, (b + F.sqrt(disc)) / a
    hit = rows.filter(disc >= 0).withColumn("depth", F.when(near >= 0, near).otherwise(far))
    return hit.filter("depth >= 0").select("image_id", "x", "y", "depth")


def sphere_depth(cameras: DataFrame, pixels: DataFrame, focal: float, cx: float, cy: float, radius: float = RADIUS) -> DataFrame:
    """``on_sphere`` for every camera and pixel."""
    return on_sphere(cameras.crossJoin(F.broadcast(pixels)), focal, cx, cy, radius)


#: Fixed values of the texture: waves (frequency, phase of the azimuth, phase of the elevation) and noises (scale, shifts).
WAVES = [(8.0, 0.0, 0.0), (16.0, 1.0, 0.5), (32.0, 2.0, 1.5)]
NOISES = [(30.0, 0.0, 0.0), (60.0, 7.3, 13.7), (120.0, 23.1, 41.9), (200.0, 53.7, 97.3)]
#: For red, green and blue, the level and the weights of the waves and noises.
CHANNELS = {
    "r": (0.5, (0.25, 0.15, 0.10), (0.15, 0.10, 0.05, 0.0)),
    "g": (0.4, (0.20, -0.15, 0.12), (0.0, 0.12, 0.08, 0.05)),
    "b": (0.6, (-0.15, 0.20, -0.10), (0.10, 0.05, 0.13, 0.0)),
}


def hash_noise(x: Column, y: Column) -> Column:
    """A fraction that looks random, from the sine of a mix of both coordinates."""
    v = F.sin(x * 127.1 + y * 311.7) * 43758.5453
    return v - F.floor(v)


def sphere_texture(theta: Column, phi: Column) -> dict[str, Column]:
    """Red, green and blue, 0 to 1, at an azimuth and an elevation."""
    up = phi + math.pi / 2
    waves = [F.sin(theta * f + a) * F.sin(up * f + b) for f, a, b in WAVES]
    noises = [hash_noise(theta / (2 * math.pi) * s + a, up / math.pi * s + b) - 0.5 for s, a, b in NOISES]
    out = {}
    for name, (level, by_wave, by_noise) in CHANNELS.items():
        value = F.lit(level)
        for w, x in [*zip(by_wave, waves), *zip(by_noise, noises)]:
            value = value + w * x
        out[name] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return out
