"""PFM depth maps as a Spark data source, and text or binary writers for point clouds, meshes and checkpoints."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parallaxis import storage


def pfm_bytes(depth: np.ndarray) -> bytes:
    """``Pf``, size, -1.0 for little-endian, then rows from the bottom up."""
    h, w = depth.shape
    return f"Pf\n{w} {h}\n-1.0\n".encode() + np.ascontiguousarray(depth[::-1], "<f4").tobytes()


def pfm_array(content: bytes) -> np.ndarray | None:
    """The depth plane, or None if this is not a one-channel PFM; the sign of the scale gives the byte order."""
    try:
        kind, size, scale, rest = content.split(b"\n", 3)
        w, h = map(int, size.split())
        if kind.strip() != b"Pf" or len(rest) < 4 * w * h:
            return None
        return np.frombuffer(rest, "<f4" if float(scale) < 0 else ">f4", w * h).reshape(h, w)[::-1].astype(np.float32)
    except ValueError:
        return None


def read_pfm(spark: SparkSession, path: str) -> DataFrame:
    """(file, y, x, depth) of PFM files; 0 means no depth and becomes null. Files of other kinds give no rows."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                plane = pfm_array(content.as_py())
                if plane is None:
                    continue
                for y, row in enumerate(plane):
                    yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * len(row)), pa.array([y] * len(row), pa.int32()), pa.array(range(len(row)), pa.int32()), pa.array(row, pa.float32(), mask=row == 0)], names=["file", "y", "x", "depth"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfm").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, y int, x int, depth float")


def write_pfm(depths: DataFrame, path: str) -> DataFrame:
    """Depth maps of ``(image_id, width, height, y, x, depth)`` as rows (image_id, pfm), stored as Parquet at ``path``.

    One image is one group: its pixels are what a PFM holds.
    """
    import pandas as pd

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((int(group.height.iloc[0]), int(group.width.iloc[0])), np.float32)
        plane[group.y.to_numpy(), group.x.to_numpy()] = group.depth.fillna(0).to_numpy()
        return pd.DataFrame({"image_id": [int(group.image_id.iloc[0])], "pfm": [pfm_bytes(plane)]})

    packed = depths.select("image_id", "width", "height", "y", "x", "depth").groupBy("image_id").applyInPandas(pack, "image_id long, pfm binary")
    packed.write.mode("overwrite").parquet(path)
    return depths.sparkSession.read.parquet(path)


def ply_lines(points: DataFrame) -> tuple[str, DataFrame]:
    """Header and lines of an ASCII point cloud from (X, Y, Z, r, g, b), colours 0 to 1."""
    n = points.count()
    header = "\n".join(["ply", "format ascii 1.0", f"element vertex {n}", *(f"property float {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")), "end_header"])
    byte = lambda c: (F.col(c) * 255).cast("int")
    return header, points.select(F.format_string("%.6g %.6g %.6g %d %d %d", "X", "Y", "Z", byte("r"), byte("g"), byte("b")).alias("value"))


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``v`` and 1-based ``f`` lines in order."""
    v = vertices.select(F.lit(0).alias("part"), F.col("v_id").alias("k"), F.format_string("v %.9g %.9g %.9g", "x", "y", "z").alias("value"))
    f = faces.select(F.lit(1).alias("part"), F.col("f_id").alias("k"), F.format_string("f %d %d %d", F.col("v0") + 1, F.col("v1") + 1, F.col("v2") + 1).alias("value"))
    return v.unionByName(f).orderBy("part", "k").select("value")


def parse_obj(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (x, y, z) and 0-based faces (v0, v1, v2) of OBJ lines, unordered."""
    word = F.split("value", " +")
    v = lines.filter(F.col("value").startswith("v ")).select(*(F.get(word, F.lit(k + 1)).cast("double").alias(c) for k, c in enumerate("xyz")))
    f = lines.filter(F.col("value").startswith("f ")).select(*((F.get(word, F.lit(k + 1)).cast("long") - 1).alias(c) for k, c in enumerate(("v0", "v1", "v2"))))
    return v, f


def stl_triangle(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> bytes:
    """One 50-byte record of a binary STL."""
    n = np.cross(b - a, c - a)
    length = np.linalg.norm(n)
    return struct.pack("<12fH", *(n / length if length else n), *a, *b, *c, 0)


def ply_mesh_lines(vertices: DataFrame, faces: DataFrame) -> tuple[str, DataFrame]:
    """Header and lines, in order, of an ASCII mesh from (v_id, x, y, z) and 0-based (f_id, v0, v1, v2)."""
    head = ["ply", "format ascii 1.0", f"element vertex {vertices.count()}", *(f"property float {c}" for c in "xyz"), f"element face {faces.count()}", "property list uchar int vertex_indices", "end_header"]
    v = vertices.select(F.lit(0).alias("part"), F.col("v_id").alias("k"), F.format_string("%.9g %.9g %.9g", "x", "y", "z").alias("value"))
    f = faces.select(F.lit(1).alias("part"), F.col("f_id").alias("k"), F.format_string("3 %d %d %d", "v0", "v1", "v2").alias("value"))
    return "\n".join(head), v.unionByName(f).orderBy("part", "k").select("value")


def write_stl(vertices: DataFrame, faces: DataFrame, path: str) -> int:
    """A binary STL file at ``path``, in any store that Spark reaches; how many triangles it holds.

    The format is one file, so one process writes it; triangles are made on the executors and stream through.
    """
    corner = lambda k: vertices.select(F.col("v_id").alias(f"v{k}"), F.array("x", "y", "z").alias(f"p{k}"))
    met = faces
    for k in range(3):
        met = met.join(corner(k), f"v{k}")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = zip(*(b.column(f"p{k}").to_pylist() for k in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(stl_triangle(*map(np.array, r)) for r in rows)], pa.binary()), pa.array([b.num_rows], pa.int64())], names=["records", "n"])

    spark = vertices.sparkSession
    total = faces.count()
    fs, target = storage.file_system(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(struct.pack("<80sI", b"", total)))
        for r in met.orderBy("f_id").select("p0", "p1", "p2").mapInArrow(run, "records binary, n long").toLocalIterator():
            out.write(bytearray(r.records))
    finally:
        out.close()
    return total


def write_checkpoints(save: bool, output_path: str, frames: dict[str, DataFrame]) -> list[str]:
    """Writes frames as Parquet beside the output file, if that is asked for and there is one; the paths written."""
    if not save or not output_path:
        return []
    folder = output_path.rpartition("/")[0] or "."
    paths = []
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
        paths.append(f"{folder}/{name}")
    return paths


def read_true_cameras(spark: SparkSession, path: str, step: float = 10.0) -> DataFrame:
    """(image_id, image, angle_deg, R, t, center) of a ground-truth JSON: ids are angles in steps."""
    camera = "image:string,angle_deg:double,R:array<array<double>>,t:array<double>,center:array<double>"
    own = spark.read.schema(f"cameras array<struct<{camera}>>").json(path, multiLine=True).select(F.inline("cameras"))
    return own.select(F.round(F.col("angle_deg") / step).cast("int").alias("image_id"), "image", "angle_deg", F.flatten("R").alias("R"), "t", "center")


def checkpoint_json(cameras: DataFrame, stats: dict) -> str:
    """Registered cameras and run statistics as JSON; poses of unregistered cameras are null.

    There are as many cameras as images of one scene, so they are collected.
    """
    rows = [r.asDict() for r in cameras.orderBy("image_id").collect()]
    for r in rows:
        if not r["is_registered"]:
            r |= {"R": None, "t": None}
    return json.dumps(stats | {"cameras": rows})


def read_checkpoint(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Cameras of a JSON checkpoint."""
    return spark.read.schema(f"cameras array<struct<{schema}>>").json(path, multiLine=True).select(F.inline("cameras"))
