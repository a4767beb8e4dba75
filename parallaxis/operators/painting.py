"""Overlapping rectangles painted in order, the last one winning, without unfolding them into pixels.

A rectangle is dealt to the tiles it touches, nearly always one. Rows of a tile come to its task sorted by their order and
are painted one over the other on a plane of the tile's size; only what can be seen in the end becomes rows. A task holds
one plane and one batch of rectangles, however many a tile has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

TILE = 128
#: Pixels of a batch of results.
_BATCH_PIXELS = 1 << 17


def squares(points: DataFrame, radius: int) -> DataFrame:
    """Adds x0, y0, x1, y1: the square about the pixel nearest to columns x, y (halves to even)."""
    x, y = F.rint("x").cast("long"), F.rint("y").cast("long")
    return points.withColumns({"x0": x - radius, "y0": y - radius, "x1": x + radius, "y1": y + radius})


def _brush(width: int, height: int, tile: int, values: list[str]):
    across = -(-width // tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, plane, kept = None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            image, cells = batch.column("image_id"), batch.column("cell").to_numpy()
            codes = image.dictionary_encode(null_encoding="encode").indices.to_numpy()
            paint = pa.StructArray.from_arrays([batch.column(v) for v in values], names=values) if kept is None else pa.concat_arrays([kept, pa.StructArray.from_arrays([batch.column(v) for v in values], names=values)])
            first = len(paint) - n
            box = batch.column("box").to_numpy()
            x1, y1, x0, y0 = (((box // tile**k) % tile) for k in range(4))
            edges = list(zip(y0.tolist(), (y1 + 1).tolist(), x0.tolist(), (x1 + 1).tolist()))
            begins = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (cells[1:] != cells[:-1])]).tolist()
            done, pixels = [], 0
            for a, b in zip(begins, [*begins[1:], n]):
                now = (image[a].as_py(), int(cells[a]))
                if now != key:
                    if key is not None:
                        done.append((key, plane))
                        pixels += plane.size
                        if pixels >= _BATCH_PIXELS:
                            yield seen(done, paint, image.type)
                            done, pixels = [], 0
                    key, (ty, tx) = now, divmod(now[1], across)
                    plane = np.full((min(tile, height - ty * tile), min(tile, width - tx * tile)), -1, np.int64)
                for k in range(a, b):
                    top, bottom, left, right = edges[k]
                    plane[top:bottom, left:right] = first + k
            if done:
                yield seen(done, paint, image.type)
            # of what is painted so far only what can be seen is held
            rows, place = np.unique(plane[plane >= 0], return_inverse=True)
            plane[plane >= 0] = place
            kept = paint.take(pa.array(rows))
        if key is not None:
            yield seen([(key, plane)], kept, image.type)

    def seen(done: list, paint: pa.StructArray, kind: pa.DataType) -> pa.RecordBatch:
        ys, xs, rows = [], [], []
        for (_, cell), plane in done:
            y, x = np.nonzero(plane >= 0)
            rows.append(plane[y, x])
            ty, tx = divmod(cell, across)
            ys.append(y + ty * tile)
            xs.append(x + tx * tile)
        images = pa.array([key[0] for key, _ in done], kind).take(pa.array(np.repeat(np.arange(len(done)), [len(r) for r in rows])))
        won = paint.take(pa.array(np.concatenate(rows)))
        return pa.RecordBatch.from_arrays([images, pa.array(np.concatenate(ys)), pa.array(np.concatenate(xs)), *(won.field(k) for k in range(len(values)))], names=["image_id", "y", "x", *values])

    return run


def painted(rectangles: DataFrame, width: int, height: int, order: list[str], values: list[str], tile: int = TILE) -> DataFrame:
    """(image_id, y, x, values...) of ``rectangles(image_id, x0, y0, x1, y1, order..., values...)``, bounds included.

    The rectangle largest in ``order`` wins a pixel; equal ones the one largest in ``values``. What lies outside the image
    is cut off; a rectangle with a null bound, or whose bounds are crossed, paints nothing; pixels that nothing covers have
    no row.
    """
    carried = [*order, *(v for v in values if v not in order)]
    inside = rectangles.select(
        "image_id", F.greatest(F.lit(0), F.col("x0").cast("long")).alias("x0"), F.greatest(F.lit(0), F.col("y0").cast("long")).alias("y0"),
        F.least(F.lit(width - 1), F.col("x1").cast("long")).alias("x1"), F.least(F.lit(height - 1), F.col("y1").cast("long")).alias("y1"),
        F.struct(*carried).alias("paint"), *(F.col(c).isNull().alias(f"_null_{c}") for c in ("x0", "y0", "x1", "y1")),
    ).filter("x0 <= x1 and y0 <= y1 and not (_null_x0 or _null_y0 or _null_x1 or _null_y1)")
    touched = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile)))
    dealt = inside.withColumn("ty", touched("y0", "y1")).withColumn("tx", touched("x0", "x1"))
    left, top = F.col("tx") * tile, F.col("ty") * tile
    low = lambda c, edge: F.greatest(F.col(c), edge) - edge
    high = lambda c, edge: F.least(F.col(c), edge + tile - 1) - edge
    box = ((low("y0", top) * tile + low("x0", left)) * tile + high("y1", top)) * tile + high("x1", left)
    dealt = dealt.select("image_id", (F.col("ty") * -(-width // tile) + F.col("tx")).alias("cell"), box.alias("box"), *(F.col("paint")[c].alias(f"c{k}") for k, c in enumerate(carried)))
    laid = dealt.repartition("image_id", "cell").sortWithinPartitions("image_id", "cell", *(f"c{k}" for k in range(len(carried))))
    won = [f"c{carried.index(v)}" for v in values]
    types = [StructField("image_id", rectangles.schema["image_id"].dataType), StructField("y", LongType()), StructField("x", LongType())]
    made = laid.mapInArrow(_brush(width, height, tile, won), StructType([*types, *(StructField(w, rectangles.schema[v].dataType) for w, v in zip(won, values))]))
    return made.select("image_id", "y", "x", *(F.col(w).alias(v) for w, v in zip(won, values)))
