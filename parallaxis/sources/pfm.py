"""``pfm``, a data source of one-channel PFM files: read and written by the executors, a file at a time.

Reading: ``spark.read.format("pfm").load(folder)`` gives (file, width, height, y, x, depth), one row for each pixel with a
depth; 0 means none and becomes null. Small files share a partition, a large one has its own; each is read in blocks of
lines; files of other kinds, or cut short, give no rows.

Writing: rows (file, width, height, y, x, depth) become a file each, named ``file``; missing or null pixels are 0. Rows of
one file have to be in one partition and follow each other, as ``arranged`` lays them out; more than one partition with
the same file is an error. A task writes beside the target; the files are moved into place when all tasks are done, and
removed if any of them fails, so a failed write leaves nothing. ``mode("overwrite")`` replaces files of the same name,
``mode("append")`` fails on them.

Paths are those of the store that Arrow's file systems reach (local, hdfs, s3, gs).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file string, width int, height int, y int, x int, depth float"
#: Pixels of a block that is read at once.
BLOCK_PIXELS = 1 << 20
#: Bytes of files that one task reads, and what opening one more counts as; files moved into place at once.
PARTITION_BYTES, OPEN_BYTES, MOVES = 16 << 20, 32 << 10, 16
_NAMES = ["file", "width", "height", "y", "x", "depth"]
_HEAD = re.compile(rb"Pf[ \t\r]*\n\s*(\d+)\s+(\d+)\s*\n\s*([-+0-9.eE]+)[ \t\r]*\n")


def located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:", path) else (arrow_fs.LocalFileSystem(), path)


@dataclass
class _Files(InputPartition):
    paths: list[str]


def shared_out(files: list[arrow_fs.FileInfo]) -> list[InputPartition]:
    """Files in partitions of ``PARTITION_BYTES``, to which opening a file counts as ``OPEN_BYTES``; one without files if there are none."""
    parts, held = [_Files([])], 0
    for f in files:
        cost = max(f.size or 0, 0) + OPEN_BYTES
        if parts[-1].paths and held + cost > PARTITION_BYTES:
            parts.append(_Files([]))
            held = 0
        parts[-1].paths.append(f.path)
        held += cost
    return parts


class FolderReader(DataSourceReader):
    """Reads the files of a folder whose names end in ``suffix``, small ones together as one partition."""

    suffix = ""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, path = located(self.path)
        info = store.get_file_info(path)
        if info.type == arrow_fs.FileType.File:
            return shared_out([info])
        found = store.get_file_info(arrow_fs.FileSelector(path)) if info.type == arrow_fs.FileType.Directory else []
        return shared_out([f for f in sorted(found, key=lambda f: f.path) if f.type == arrow_fs.FileType.File and f.base_name.lower().endswith(self.suffix)])

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as source:
                yield from self.rows(path.rsplit("/", 1)[-1], source)

    def rows(self, name: str, source: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class _Reader(FolderReader):
    suffix = ".pfm"

    def rows(self, name: str, source: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        head = _HEAD.match(source.read(256))
        if head is None:
            return
        w, h = int(head[1]), int(head[2])
        try:
            order = "<f4" if float(head[3]) < 0 else ">f4"
        except ValueError:
            return
        if source.size() < head.end() + 4 * w * h or not w * h:
            return
        step = max(1, BLOCK_PIXELS // w)
        for row in range(0, h, step):
            n = min(step, h - row)
            source.seek(head.end() + 4 * w * row)
            depth = np.frombuffer(source.read(4 * w * n), order).astype(np.float32)
            # lines come from the bottom up
            y = np.repeat(h - 1 - np.arange(row, row + n, dtype=np.int32), w)
            size = len(depth)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * size), pa.array(np.full(size, w, np.int32)), pa.array(np.full(size, h, np.int32)), pa.array(y), pa.array(np.tile(np.arange(w, dtype=np.int32), n)), pa.array(depth, mask=depth == 0)], names=_NAMES
            )


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class StagedWriter:
    """Tasks write into folders beside the target; files are moved into place together, or removed."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_writing-{uuid.uuid4().hex}"

    def stage(self) -> tuple[arrow_fs.FileSystem, str]:
        """A folder for one attempt of a task: a repeated or second attempt has its own."""
        store, path = located(self.path)
        return store, f"{path}/{self.job}/{uuid.uuid4().hex}"

    def commit(self, messages: list[Written]) -> None:
        store, path = located(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [f.rsplit("/", 1)[-1] for f in files]
        try:
            if len(set(names)) < len(names):
                raise ValueError("rows of one file lie in several partitions")
            if not self.overwrite:
                there = [i.base_name for i in store.get_file_info([f"{path}/{n}" for n in names]) if i.type != arrow_fs.FileType.NotFound]
                if there:
                    raise FileExistsError(f"{there[0]} is there already")
            store.create_dir(path, recursive=True)
            with ThreadPoolExecutor(MOVES) as movers:
                list(movers.map(store.move, files, (f"{path}/{n}" for n in names)))
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        store, path = located(self.path)
        if store.get_file_info(f"{path}/{self.job}").type == arrow_fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.job}")


class _Writer(StagedWriter, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = self.stage()
        done: list[str] = []
        name, plane = None, np.zeros((0, 0), "<f4")

        def close() -> None:
            if name is None:
                return
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(f"Pf\n{plane.shape[1]} {plane.shape[0]}\n-1.0\n".encode() + plane[::-1].tobytes())
            done.append(f"{folder}/{name}")

        seen = set()
        for batch in iterator:
            files = batch.column("file").to_pylist()
            w, h, y, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("width", "height", "y", "x"))
            depth = batch.column("depth").fill_null(0).to_numpy(zero_copy_only=False)
            begins = [k for k in range(len(files)) if k == 0 or files[k] != files[k - 1]]
            for a, b in zip(begins, [*begins[1:], len(files)]):
                if files[a] != name:
                    close()
                    name = files[a]
                    if not name or "/" in name or name.startswith("."):
                        raise ValueError(f"not the name of a file: {name!r}")
                    if name in seen:
                        raise ValueError(f"rows of {name} do not follow each other")
                    seen.add(name)
                    plane = np.zeros((int(h[a]), int(w[a])), "<f4")
                plane[y[a:b].astype(int), x[a:b].astype(int)] = depth[a:b]
        close()
        return Written(done)


class PfmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pfm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(PfmSource)


def arranged(depths: DataFrame) -> DataFrame:
    """Rows (file, width, height, y, x, depth), each file's in one partition and one after another."""
    typed = depths.select("file", *(F.col(c).cast("int").alias(c) for c in ("width", "height", "y", "x")), F.col("depth").cast("float").alias("depth"))
    return typed.repartition("file").sortWithinPartitions("file", "y", "x")


def write(depths: DataFrame, path: str, mode: str = "append") -> None:
    """Writes ``depths(file, width, height, y, x, depth)`` as PFM files in the folder ``path``."""
    register(depths.sparkSession)
    arranged(depths).write.format("pfm").mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("pfm").load(path)
