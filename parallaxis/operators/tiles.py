"""Images as tiles: stencils and relaxations that exchange only the borders of tiles.

A tile is one row with its planes packed as doubles, whatever the size of its image. Before a stencil every tile sends its
borders to its up to eight neighbours and puts a frame of ``reach`` pixels about itself from what it gets; beyond the
image's edge the frame repeats the edge. All results are independent of the size of the tiles.

Images are rectangles without gaps; a pixel that is missing is NaN and spreads as such. ``reach`` is at most the side of a
tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis import storage
from parallaxis.operators.raster import kernel

TILE = 64
_TILE = "image_id long, ty long, tx long, h int, w int, planes array<binary>"
_PIECE = "image_id long, ty long, tx long, dy int, dx int, h int, w int, planes array<binary>"


def cut(pixels: DataFrame, names: list[str], tile: int = TILE) -> DataFrame:
    """Tiles of ``pixels(image_id, y, x, names...)``: one plane for each name."""
    rows = pixels.groupBy("image_id", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")).agg(
        F.collect_list(F.struct((F.col("y") % tile).cast("int").alias("y"), (F.col("x") % tile).cast("int").alias("x"), *(F.col(n).cast("double").alias(f"p{k}") for k, n in enumerate(names)))).alias("pixels")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pixels")
            ends, flat = lists.offsets.to_numpy(), lists.values
            y, x = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            values = [flat.field(2 + k).to_numpy(zero_copy_only=False) for k in range(len(names))]
            out, hs, ws = [], [], []
            for a, b in zip(ends, ends[1:]):
                h, w = int(y[a:b].max()) + 1, int(x[a:b].max()) + 1
                planes = []
                for v in values:
                    plane = np.full((h, w), np.nan)
                    plane[y[a:b], x[a:b]] = v[a:b]
                    planes.append(plane.tobytes())
                out.append(planes)
                hs.append(h)
                ws.append(w)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("image_id", "ty", "tx")), pa.array(hs, pa.int32()), pa.array(ws, pa.int32()), pa.array(out, pa.list_(pa.binary()))], names=["image_id", "ty", "tx", "h", "w", "planes"])

    return rows.mapInArrow(run, _TILE)


def _planes(row: list[bytes], h: int, w: int) -> np.ndarray:
    return np.stack([np.frombuffer(p).reshape(h, w) for p in row])


def _borders(reach: int):
    """Each tile itself, and for each neighbour what lies within ``reach`` of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n.split()[0]: [] for n in _PIECE.split(", ")}
            for row in batch.to_pylist():
                planes = _planes(row["planes"], row["h"], row["w"])
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        # to the tile above goes the upper border, which is its lower frame
                        ys = slice(None) if dy == 0 else slice(0, reach) if dy < 0 else slice(max(0, row["h"] - reach), None)
                        xs = slice(None) if dx == 0 else slice(0, reach) if dx < 0 else slice(max(0, row["w"] - reach), None)
                        part = np.ascontiguousarray(planes[:, ys, xs])
                        for n, v in zip(out, (row["image_id"], row["ty"] + dy, row["tx"] + dx, -dy, -dx, part.shape[1], part.shape[2], [p.tobytes() for p in part])):
                            out[n].append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return run


def _framed(pieces: list[dict], reach: int) -> tuple[np.ndarray, dict] | None:
    """A tile with its frame, from itself and its neighbours' borders; edges are repeated. None if there is no such tile."""
    own = next((p for p in pieces if p["dy"] == 0 and p["dx"] == 0), None)
    if own is None:
        return None
    h, w = own["h"], own["w"]
    out = np.full((len(own["planes"]), h + 2 * reach, w + 2 * reach), np.nan)
    top = bottom = left = right = 0  # how much of the frame lies within the image
    for p in pieces:
        planes = _planes(p["planes"], p["h"], p["w"])
        y = reach if p["dy"] == 0 else reach - p["h"] if p["dy"] < 0 else reach + h
        x = reach if p["dx"] == 0 else reach - p["w"] if p["dx"] < 0 else reach + w
        out[:, y : y + p["h"], x : x + p["w"]] = planes
        if p["dx"] == 0:
            top, bottom = (p["h"] if p["dy"] < 0 else top), (p["h"] if p["dy"] > 0 else bottom)
        if p["dy"] == 0:
            left, right = (p["w"] if p["dx"] < 0 else left), (p["w"] if p["dx"] > 0 else right)
    ys = np.clip(np.arange(h + 2 * reach), reach - top, reach + h - 1 + bottom)
    xs = np.clip(np.arange(w + 2 * reach), reach - left, reach + w - 1 + right)
    return out[:, ys][:, :, xs], {"top": top, "bottom": bottom, "left": left, "right": right}


def _exchanged(tiles: DataFrame, reach: int) -> DataFrame:
    pieces = tiles.mapInArrow(_borders(reach), _PIECE)
    return pieces.groupBy("image_id", "ty", "tx").agg(F.collect_list(F.struct("dy", "dx", "h", "w", "planes")).alias("pieces"))


def stencil(tiles: DataFrame, reach: int, made: Callable[..., np.ndarray]) -> DataFrame:
    """Tiles with the planes that ``made(planes, ty, tx)`` gives for planes with a frame of ``reach`` pixels about them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n.split()[0]: [] for n in _TILE.split(", ")}
            for row in batch.to_pylist():
                framed = _framed(row["pieces"], reach)
                if framed is None:
                    continue
                planes = np.asarray(made(framed[0], row["ty"], row["tx"]), float)
                for n, v in zip(out, (row["image_id"], row["ty"], row["tx"], planes.shape[1], planes.shape[2], [np.ascontiguousarray(p).tobytes() for p in planes])):
                    out[n].append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return _exchanged(tiles, reach).mapInArrow(run, _TILE)


def pixels(tiles: DataFrame, names: list[str], tile: int = TILE) -> DataFrame:
    """(image_id, y, x, names...) of tiles; pixels whose planes are all NaN have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                planes = _planes(row["planes"], row["h"], row["w"])
                y, x = np.nonzero(~np.isnan(planes).all(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(y), row["image_id"], np.int64)), pa.array(y + row["ty"] * tile), pa.array(x + row["tx"] * tile), *(pa.array(p[y, x]) for p in planes)], names=["image_id", "y", "x", *names]
                )

    return tiles.mapInArrow(run, "image_id long, y long, x long, " + ", ".join(f"{n} double" for n in names))


def _along(plane: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    """Weighted sums over neighbours along an axis, only where all lie in the plane; in one order for all pixels."""
    n = plane.shape[axis] - len(weights) + 1
    total = np.zeros([n if a == axis else s for a, s in enumerate(plane.shape)])
    for k, w in enumerate(weights):
        total += w * np.take(plane, range(k, k + n), axis)
    return total


def _blurred(plane: np.ndarray, sigma: float) -> np.ndarray:
    """A plane, blurred where the kernel fits."""
    weights = kernel(sigma)
    return _along(_along(plane, weights, 1), weights, 0)


def blur(tiles: DataFrame, sigma: float, along: str) -> DataFrame:
    """One direction of a Gaussian blur, ``along`` x or y."""
    weights = kernel(sigma)
    reach = len(weights) // 2

    def made(planes: np.ndarray, ty: int, tx: int) -> np.ndarray:
        inner = planes[:, reach:-reach, :] if along == "x" else planes[:, :, reach:-reach]
        return np.stack([_along(p, weights, 1 if along == "x" else 0) for p in inner])

    return stencil(tiles, reach, made)


def difference(tiles: DataFrame, low: float, high: float) -> DataFrame:
    """The wider blur less the narrower one, by one exchange."""
    reach = max(len(kernel(s)) // 2 for s in (low, high))

    def made(planes: np.ndarray, ty: int, tx: int) -> np.ndarray:
        def level(plane: np.ndarray, sigma: float) -> np.ndarray:
            cut_off = reach - len(kernel(sigma)) // 2
            return _blurred(plane[cut_off : plane.shape[0] - cut_off, cut_off : plane.shape[1] - cut_off], sigma)

        return np.stack([level(p, high) - level(p, low) for p in planes])

    return stencil(tiles, reach, made)


def gaussian(tiles: DataFrame, sigma: float) -> DataFrame:
    reach = len(kernel(sigma)) // 2
    return stencil(tiles, reach, lambda planes, ty, tx: np.stack([_blurred(p, sigma) for p in planes]))


def extrema(tiles: DataFrame, sigmas: tuple[float, ...], size: tuple[int, int], tile: int = TILE, digits: int = 6) -> DataFrame:
    """(image_id, s, y, x, v): pixels of differences of neighbouring blurs that exceed, or fall below, all 26 neighbours.

    One exchange: the frame holds what the widest blur and the neighbours need. Pixels on the edge of an image of ``size``
    (height, width), and the first and last difference, have not all 26 and drop out. Values are rounded before they are
    compared.
    """
    widest = max(len(kernel(s)) // 2 for s in sigmas)
    reach = widest + 1

    def made(planes: np.ndarray, ty: int, tx: int) -> np.ndarray:
        plane, levels = planes[0], []
        for s in sigmas:
            r = len(kernel(s)) // 2
            cut_off = widest - r
            inner = plane[cut_off : plane.shape[0] - cut_off, cut_off : plane.shape[1] - cut_off]
            levels.append(_blurred(inner, s))
        stack = np.round(np.diff(np.stack(levels), axis=0), digits)
        h, w = stack.shape[1] - 2, stack.shape[2] - 2
        found = np.full((len(stack), h, w), np.nan)
        y, x = np.mgrid[:h, :w]
        y, x = y + ty * tile, x + tx * tile
        within = (y > 0) & (x > 0) & (y < size[0] - 1) & (x < size[1] - 1)
        for s in range(1, len(stack) - 1):
            own = stack[s, 1:-1, 1:-1]
            near = [stack[s + a, 1 + b : 1 + b + h, 1 + c : 1 + c + w] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
            high, low = np.max(near, 0), np.min(near, 0)
            found[s] = np.where(within & ((own > high) | (own < low)), own, np.nan)
        return found

    count = len(sigmas) - 1
    names = [f"s{k}" for k in range(count)]
    wide = pixels(stencil(tiles, reach, made), names, tile)
    long = wide.select("image_id", "y", "x", F.explode(F.array(*(F.struct(F.lit(k).alias("s"), F.col(n).alias("v")) for k, n in enumerate(names)))).alias("p"))
    return long.select("image_id", "p.s", "y", "x", "p.v").filter(~F.isnan("v"))


#: Offers of a round, in this order: from above, below, left and right.
NEIGHBOURS = ((-1, 0), (1, 0), (0, -1), (0, 1))


def propagate(tiles: DataFrame, rounds: int, cost: Callable[[np.ndarray, np.ndarray], np.ndarray], tile: int = TILE) -> DataFrame:
    """Red-black relaxation of the first plane: in each half-round the pixels of one colour take a neighbour's value if it costs less.

    ``cost(value, data)`` judges values at pixels by the other planes there. Pixels with y + x even come first; offers
    come in the order of NEIGHBOURS and have to cost strictly less than what is held. Each half-round exchanges a
    frame of one pixel and is written to the shared folder. Beyond the edge there is no offer.
    """

    def half(parity: int):
        def made(planes: np.ndarray, ty: int, tx: int) -> np.ndarray:
            value, data = planes[0], planes[1:, 1:-1, 1:-1]
            own = value[1:-1, 1:-1].copy()
            h, w = own.shape
            y, x = np.mgrid[:h, :w]
            turn = (y + ty * tile + x + tx * tile) % 2 == parity
            held = cost(own, data)
            for dy, dx in NEIGHBOURS:
                # beyond the edge the frame repeats the pixel itself, which never costs less
                offer = value[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
                price = cost(offer, data)
                won = turn & (price < held)
                own[won], held[won] = offer[won], price[won]
            return np.concatenate([own[None], data])

        return made

    for k in range(2 * rounds):
        moved = storage.materialize(stencil(tiles, 1, half(k % 2)), "tiles")
        storage.drop(tiles)
        tiles = moved
    return tiles
