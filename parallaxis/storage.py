"""Shared storage for intermediate tables.

Executors and the driver share only the folder named by ``spark.checkpoint.dir``. Every intermediate table is
written there with Spark's own writers, so any Hadoop-compatible file system works and a lost executor costs a
re-read rather than a recomputation of the whole lineage.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one is chosen only in local mode when it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "parallaxis")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone at interpreter exit
            return


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def make_dir(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.mkdirs(p)


def rename(spark: SparkSession, src: str, dst: str) -> bool:
    fs, p = file_system(spark, src)
    return fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(dst))


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a new small file; False, and nothing is written, if the path exists."""
    fs, p = file_system(spark, path)
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def contents(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, p = file_system(spark, path)
    reader = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8")
    finally:
        reader.close()


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder, none if it does not exist."""
    fs, p = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses neither recompute it nor hold its lineage."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def by_key(df: DataFrame, key: str, label: str, buckets: int) -> DataFrame:
    """As ``materialize``, in buckets of ``key``: what groups by it, or meets another such table on it, is not shuffled."""
    spark = df.sparkSession
    path = scratch(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    stored = spark.table(name)
    stored._stored_at, stored._stored_as = path, name
    return stored


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written meanwhile sends Python workers at most ``rows`` rows at once: a batch is held on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows if int(before) <= 0 else min(int(before), rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop(*frames: DataFrame | None) -> None:
    """Removes the tables of frames that ``materialize`` returned and that nothing will read again."""
    for frame in frames:
        path = getattr(frame, "_stored_at", None)
        if path is not None:
            if (name := getattr(frame, "_stored_as", None)) is not None:
                frame.sparkSession.sql(f"drop table if exists {name}")
            remove(frame.sparkSession, path)
            _made[:] = [m for m in _made if m[1] != path]


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with as many leading underscores as make it differ from the names taken, whatever their case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
