"""Image directories: names, EXIF, intrinsics and pixels."""

from __future__ import annotations

import logging
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.model import EXIF
from parallaxis.operators import sizes

#: Extensions of images, and of files that carry EXIF.
EXTENSIONS, WITH_EXIF = ("jpg", "jpeg", "png", "tiff", "tif"), ("jpg", "jpeg")
#: Tags of the main directory and of the EXIF one, and the bytes of a file that are looked at.
MAKE, MODEL, ORIENTATION, SUB_IFD, FOCAL = 0x010F, 0x0110, 0x0112, 0x8769, 0x920A
HEAD = 64 * 1024


#: Sensor widths in mm by make, then by the first part of the model name that fits; that of other cameras.
SENSORS = [
    ("apple", [("15 pro", 9.8), ("14 pro", 7.6), ("", 6.17)]),
    ("google", [("pixel 8 pro", 8.2), ("pixel 8", 6.17), ("pixel 7 pro", 8.2), ("", 6.17)]),
    ("samsung", [("s24 ultra", 8.6), ("s24", 6.4), ("s23 ultra", 8.6), ("s23", 6.4), ("", 6.4)]),
]
DEFAULT_SENSOR = 6.0
#: Focal length that a full frame of this width would have, where none is known.
EQUIVALENT, FULL_FRAME = 28.0, 36.0
#: Fewer images than these deserve a warning and a note; the longest side that is kept.
WARN_BELOW, NOTE_BELOW, MAX_SIZE = 10, 30, 3200

log = logging.getLogger(__name__)


def sensor_width(make: Column, model: Column) -> Column:
    """mm, 0.0 for an unknown camera."""
    rule = F.lit(0.0)
    for brand, models in reversed(SENSORS):
        own = F.lit(0.0)
        for part, width in reversed(models):
            own = F.when(F.contains(F.lower(model), F.lit(part)), width).otherwise(own)
        rule = F.when(F.contains(F.lower(make), F.lit(brand)), own).otherwise(rule)
    return rule


def focal_pixels(make: Column, model: Column, focal_mm: Column, width: Column, given_mm: Column, given_sensor: Column | None = None) -> Column:
    """Focal length in pixels: the one given, that of EXIF, or the equivalent; the sensor given, of the table, or the default."""
    sensor = F.coalesce(F.nullif(sensor_width(make, model), F.lit(0.0)), F.lit(DEFAULT_SENSOR))
    if given_sensor is not None:
        sensor = F.when(given_sensor > 0, given_sensor).otherwise(sensor)
    focal = F.coalesce(F.when(given_mm > 0, given_mm), F.nullif(focal_mm, F.lit(0.0)), EQUIVALENT * sensor / FULL_FRAME)
    return focal * width / sensor


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_image(path: Column) -> Column:
    """By extension, whatever its case."""
    return extension(path).isin(*EXTENSIONS)


def scan_directory(spark: SparkSession, directory: str) -> DataFrame:
    """(image_id, filename, path, content) of a directory's images in order of name, ids from 0.

    A missing directory is an empty frame. Subdirectories are not searched.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory)
    except AnalysisException:
        files = spark.createDataFrame([], schema)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    # ids come from names alone; contents meet them afterwards, without a shuffle if names are few
    named = files.filter(is_image(F.col("path"))).select(name.alias("filename"), "path")
    ids = sizes.numbered(named, "filename", "path", name="image_id").select(F.col("image_id").cast("int").alias("image_id"), "filename", "path")
    return files.select("path", "content").join(sizes.small(ids), "path").select("image_id", "filename", "path", "content")


class _Reader:
    """Bounded little- or big-endian access to a TIFF block."""

    def __init__(self, data: bytes):
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None:
            raise ValueError("no byte order")
        self.data, self.order = data, order

    def number(self, kind: str, at: int) -> int:
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def entries(self, at: int) -> Iterator[tuple[int, int, int, int]]:
        """(tag, type, count, place of the value field) of a directory."""
        for k in range(self.number("H", at)):
            e = at + 2 + 12 * k
            yield self.number("H", e), self.number("H", e + 2), self.number("I", e + 4), e + 8

    def text(self, count: int, field: int) -> str:
        at = field if count <= 4 else self.number("I", field)
        if at + count > len(self.data):
            raise ValueError("text beyond the block")
        return self.data[at : at + count].decode("latin-1").rstrip("\0 ")

    def rational(self, field: int) -> float:
        at = self.number("I", field)
        top, bottom = self.number("I", at), self.number("I", at + 4)
        return top / bottom if bottom else 0.0


def parse_exif(content: bytes | None) -> dict:
    """Make, model, orientation and focal length from the first APP1 block; anything malformed is ``valid=False``."""
    out = {"focal_mm": 0.0, "make": "", "model": "", "orientation": 1, "valid": False}
    data = (content or b"")[:HEAD]
    if len(data) < 12 or data[:2] != b"\xff\xd8":
        return out
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            try:
                own = _Reader(data[at + 10 : at + 2 + size])
                found = dict(out)
                for tag, _, count, field in own.entries(own.number("I", 4)):
                    if tag == MAKE:
                        found["make"] = own.text(count, field)
                    elif tag == MODEL:
                        found["model"] = own.text(count, field)
                    elif tag == ORIENTATION:
                        found["orientation"] = own.number("H", field)
                    elif tag == SUB_IFD:
                        for sub, _, _, place in own.entries(own.number("I", field)):
                            if sub == FOCAL:
                                found["focal_mm"] = own.rational(place)
                return found | {"valid": True}
            except (struct.error, ValueError):
                return out
        if data[at + 1] in (0xDA, 0xD9) or size < 2:
            break
        at += 2 + size
    return out


def with_exif(files: DataFrame) -> DataFrame:
    """Adds the struct ``exif`` to ``(path, content, ...)``; only JPEG names are parsed."""
    kind = pa.struct([("focal_mm", pa.float64()), ("make", pa.string()), ("model", pa.string()), ("orientation", pa.int32()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, names = b.schema.get_field_index("content"), b.column(b.schema.get_field_index("path")).to_pylist()
            jpeg = [n.rsplit(".", 1)[-1].lower() in WITH_EXIF for n in names]
            parsed = [parse_exif(b.column(at)[k].as_py() if ok else None) for k, ok in enumerate(jpeg)]
            yield b.append_column("exif", pa.array(parsed, kind))

    declared = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{declared}, exif struct<{', '.join(x.replace(' ', ':', 1) for x in EXIF.split(', ')) }>")


def pixels(spark: SparkSession, directory: str) -> DataFrame:
    """(filename, width, height, channels, data): decoded images, undecodable ones dropped."""
    own = spark.read.format("image").option("dropInvalid", True).load(directory)
    return own.select(F.regexp_extract("image.origin", r"([^/]+)$", 1).alias("filename"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def shown(bgr: np.ndarray, orientation: int) -> np.ndarray:
    """Rows x columns x channels as an EXIF orientation says they are to be shown."""
    if orientation in (5, 6, 7, 8):
        bgr = bgr.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        bgr = bgr[:, ::-1]
    if orientation in (3, 4, 7, 8):
        bgr = bgr[::-1]
    return bgr


def _shares(old: int, new: int) -> np.ndarray:
    """new x old: what share of each old pixel's line makes up each new one."""
    edges = np.arange(new + 1) * old / new
    low, high = np.maximum(edges[:-1, None], np.arange(old)), np.minimum(edges[1:, None], np.arange(old) + 1)
    return np.maximum(high - low, 0) * new / old


def shrunk(bgr: np.ndarray, max_size: int) -> np.ndarray:
    """With no side longer than ``max_size``: each pixel the mean of the area that it covers."""
    h, w = bgr.shape[:2]
    if max(h, w) <= max_size:
        return bgr
    scale = max_size / max(h, w)
    rows, cols = _shares(h, max(1, int(h * scale))), _shares(w, max(1, int(w * scale)))
    return np.clip(np.rint(np.stack([rows @ bgr[..., c] @ cols.T for c in range(bgr.shape[2])], -1)), 0, 255).astype(np.uint8)


def _prepared(max_size: int):
    names = ["image_id", "filename", "exif", "width", "height", "bgr", "gray"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # one image at a time
                row = {n: b.column(n)[k].as_py() for n in ("width", "height", "channels", "data")}
                plane = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])[..., :3]
                plane = np.repeat(plane, 3, 2) if row["channels"] == 1 else plane
                exif = b.column("exif")[k].as_py()
                plane = shrunk(shown(plane, exif["orientation"] if exif["valid"] else 1), max_size)
                gray = np.rint(plane @ np.array([0.114, 0.587, 0.299])).astype("<f4") / np.float32(255)
                cells = [plane.shape[1], plane.shape[0], np.ascontiguousarray(plane).tobytes(), gray.tobytes()]
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(k, 1) for n in names[:3]), *(pa.array([c], t) for c, t in zip(cells, kinds))], names=names)

    return run


def load_images(spark: SparkSession, directory: str, max_size: int = MAX_SIZE, focal_mm: float = 0.0, sensor_mm: float = 0.0) -> DataFrame:
    """(image_id, filename, exif, width, height, bgr, gray, K): a directory's images as they are to be shown, downscaled.

    Ids are positions among the names of image files; a file that cannot be decoded leaves a gap. ``gray`` is packed
    float32, 0 to 1. K holds the focal length in pixels and the image's middle, row by row.
    """
    files = with_exif(scan_directory(spark, directory)).drop("content")
    n = files.count()
    if 0 < n < WARN_BELOW:
        log.warning("%d images are too few for a good reconstruction", n)
    elif 0 < n < NOTE_BELOW:
        log.info("%d images; %d or more give better results", n, NOTE_BELOW)
    decoded = pixels(spark, directory) if n else spark.createDataFrame([], "filename string, width int, height int, channels int, data binary")
    exif = f"struct<{', '.join(x.replace(' ', ':', 1) for x in EXIF.split(', '))}>"
    kind = f"image_id int, filename string, exif {exif}, width int, height int, bgr binary, gray binary"
    made = decoded.join(sizes.small(files.select("image_id", "filename", "exif")), "filename").mapInArrow(_prepared(max_size), kind)
    fx = focal_pixels(F.col("exif.make"), F.col("exif.model"), F.col("exif.focal_mm"), F.col("width"), F.lit(focal_mm), F.lit(sensor_mm))
    zero, one = F.lit(0.0), F.lit(1.0)
    return made.withColumn("K", F.array(fx, zero, F.col("width") / 2, zero, fx, F.col("height") / 2, zero, zero, one))
