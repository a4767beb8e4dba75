"""``ply``, a data source of ASCII point clouds: each partition is a file of its own, with its own header.

``df.write.format("ply").save(folder)`` takes (X, Y, Z, r, g, b), colours from 0 to 1, and writes one valid PLY for each
partition that has rows: nothing passes through the driver. Files are moved into place when all tasks are done, as those of
``pfm`` are. ``spark.read.format("ply").load(folder)`` gives them back with ``file`` and ``place``, the row's place in its
file, colours as bytes / 255. Rows with a null coordinate are an error; null colours are 0. Files of other kinds, or cut
short, give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader
from pyspark.sql.types import StructType

from parallaxis.sources import pfm

SCHEMA = "file string, place long, X double, Y double, Z double, r double, g double, b double"
_HEADER = ["ply", "format ascii 1.0", "element vertex {n}", *(f"property float {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")), "end_header"]
_ROWS = 100_000


class _Reader(pfm.FolderReader):
    suffix = ".ply"

    def rows(self, name: str, source) -> Iterator[pa.RecordBatch]:
        text = _lines(source)
        head = []
        for line in text:
            head.append(line.strip())
            if head[-1] == "end_header" or len(head) > 100:
                break
        want = [h.format(n="") for h in _HEADER]
        if len(head) != len(want) or any(h != w for k, (h, w) in enumerate(zip(head, want)) if k != 2) or not head[2].startswith(want[2]) or not head[2][len(want[2]) :].isdigit():
            return
        n, done, held = int(head[2][len(want[2]) :]), 0, []
        for line in text:
            held.append(line.split())
            if len(held) == _ROWS or done + len(held) == n:
                yield self._batch(name, done, held)
                done, held = done + len(held), []
                if done == n:
                    return

    @staticmethod
    def _batch(name: str, first: int, rows: list[list[str]]) -> pa.RecordBatch:
        values = np.array(rows, dtype=np.float64)
        columns = [pa.array(values[:, k]) for k in range(3)] + [pa.array(values[:, k] / 255) for k in (3, 4, 5)]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(np.arange(first, first + len(rows))), *columns], names=["file", "place", "X", "Y", "Z", "r", "g", "b"])


def _lines(source) -> Iterator[str]:
    rest = b""
    while piece := source.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        yield from (w.decode("ascii", "replace") for w in whole)
    if rest:
        yield rest.decode("ascii", "replace")


class _Writer(pfm.StagedWriter, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> pfm.Written:
        store, folder = self.stage()
        name, n, parts = f"part-{uuid.uuid4().hex}.ply", 0, []
        body = f"{folder}/_body"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(body) as out:
            for batch in iterator:
                xyz = [batch.column(c) for c in "XYZ"]
                if any(c.null_count for c in xyz):
                    raise ValueError("a point without a coordinate")
                x, y, z = (c.cast(pa.float64()).to_pylist() for c in xyz)
                colours = [np.clip(batch.column(c).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) * 255, 0, 255).astype(int).tolist() for c in "rgb"]
                out.write("".join("%.9g %.9g %.9g %d %d %d\n" % row for row in zip(x, y, z, *colours)).encode())
                n += batch.num_rows
        if n:
            # the header says how many rows there are, which is known only now
            with store.open_output_stream(f"{folder}/{name}") as out, store.open_input_stream(body) as source:
                out.write("\n".join(_HEADER).format(n=n).encode() + b"\n")
                while piece := source.read(1 << 22):
                    out.write(piece)
            parts.append(f"{folder}/{name}")
        store.delete_file(body)
        return pfm.Written(parts)


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def write(points: DataFrame, path: str, mode: str = "append") -> None:
    """Writes ``points(X, Y, Z, r, g, b)`` as PLY files in the folder ``path``."""
    points.sparkSession.dataSource.register(PlySource)
    points.select("X", "Y", "Z", "r", "g", "b").write.format("ply").mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PlySource)
    return spark.read.format("ply").load(path)
