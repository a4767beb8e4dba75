"""Incremental capture: images that arrive in a directory are registered once each.

The reference listing is a batch; this is an extension that uses the same operators on a stream of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.sources.images import is_image, with_exif


def arriving_images(spark: SparkSession, directory: str) -> DataFrame:
    """A stream of (path, content, exif) for image files as they appear."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(directory)
    return with_exif(files.filter(is_image(F.col("path"))).select("path", "content"))


def captures_by_camera(stream: DataFrame) -> DataFrame:
    """Running counts by make and model."""
    return stream.groupBy("exif.make", "exif.model").agg(F.count(F.lit(1)).alias("captures"))
