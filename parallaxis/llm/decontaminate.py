"""Benchmark decontamination by greedy string tiling.

Items and documents become lower-cased words. Windows of ``SEED`` words that a document shares with an item are the
seeds of a hash join on the map side. The places of an item that seeds cover are counted for all items at once, and
pairs whose seeds cannot cover enough of the item end there. For the others, tiles are found as running Karp-Rabin
greedy string tiling does: the length of the longest unmarked common string is searched with Karp-Rabin hashes of all
windows, the strings of that length are marked where they do not overlap, in order of place in the item and then in
the text, and so on down to ``SEED`` words. The share of an item's words under tiles does not depend on their order,
so reordered passages count as whole ones do. Items shorter than a seed have to occur whole.

Tiles of equal length do not overlap, so an item of n words has at most about ``sqrt(2 n)`` lengths of tiles; each
costs a few sorts of the windows, however often words repeat.

The benchmark is taken in blocks of at most ``BLOCK_CHARS`` characters of text, each of which is sent to the
executors and meets every document; a larger benchmark means more passes, not larger broadcasts. Documents are not
shuffled and a passage that a third of them share costs each of them the same.

Edge cases: null and empty texts and items without words match nothing; equal benchmark rows are one item; equal
documents give equal rows; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.llm import worker

WORD = re.compile(r"\w+")
#: Words of a seed, which is also the shortest tile.
SEED = 4
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
BLOCK_CHARS = 8_000_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Ids spread over 64 bits, so that the hashes of windows are of all bits."""
    h = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


class _Windows:
    """Karp-Rabin hashes of a sequence's windows of any length, from those of its beginnings."""

    def __init__(self, ids: np.ndarray):
        self.ids, mixed = ids, _mixed(ids)
        with np.errstate(over="ignore"):
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(ids), _PRIME, np.uint64))])
            # the hash of a window is sum(x[k] * P ** k) over it, times the power that puts it at a common place
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * self.powers[:-1])])
        self.used = ids < 0

    def at(self, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of unmarked windows of n ids, as if each stood at place ``most``."""
        if n > len(self.ids):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        marks = np.concatenate([[0], np.cumsum(self.used)])
        free = np.flatnonzero(marks[n:] == marks[:-n])
        with np.errstate(over="ignore"):
            return free, (self.sums[free + n] - self.sums[free]) * _power(most - free)


def _power(k: np.ndarray) -> np.ndarray:
    """_PRIME to the power of k modulo 2 ** 64, by the bits of k."""
    out, base = np.ones(len(k), np.uint64), int(_PRIME)
    with np.errstate(over="ignore"):
        for bit in range(int(k.max()).bit_length() if len(k) else 0):
            odd = (k >> bit) & 1 == 1
            out[odd] *= np.uint64(base)
            base = base * base % (1 << 64)
    return out


def tile(item: list[int] | np.ndarray, text: list[int] | np.ndarray, shortest: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length) of non-overlapping common strings.

    Negative ids match nothing. Longest strings are marked first, of equal ones the first in the item, then in the text.
    """
    a, b = _Windows(np.asarray(item, np.int64)), _Windows(np.asarray(text, np.int64))
    most = max(len(a.ids), len(b.ids))
    tiles: list[tuple[int, int, int]] = []

    def common(n: int) -> bool:
        return bool(np.isin(a.at(n, most)[1], b.at(n, most)[1]).any())

    limit = min(len(a.ids), len(b.ids))
    while limit >= shortest and common(shortest):
        # the longest length that has a common unmarked string: all shorter ones have one too
        low, high = shortest, limit + 1
        step = 1
        while low + step < high and common(low + step):
            low, step = low + step, 2 * step
        high = min(high, low + step)
        while high - low > 1:
            low, high = (mid, high) if common(mid := (low + high) // 2) else (low, mid)
        places, hashes = b.at(low, most)
        order = np.argsort(hashes, kind="stable")
        places, hashes = places[order], hashes[order]
        starts, own = a.at(low, most)
        first, last = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        upto: dict[int, int] = {}
        for x, f, z in zip(starts.tolist(), first.tolist(), last.tolist()):
            if f == z or a.used[x] or a.used[x + low - 1]:
                continue
            k = upto.get(f, f)
            # windows that a mark has reached stay marked, so a hash's places are passed once
            while k < z and (b.used[y := int(places[k])] or b.used[y + low - 1]):
                k += 1
            upto[f] = k
            if k < z and (a.ids[x : x + low] == b.ids[y : y + low]).all():
                a.used[x : x + low] = b.used[y : y + low] = True
                tiles.append((x, y, low))
        limit = low - 1
    return tiles


class _Block:
    """One block of items: their words' ids, and which windows of ``SEED`` words they hold where."""

    def __init__(self, rows: list[tuple[int, str]], seed: int):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        #: whole items shorter than a seed, by their length and words
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        hashes, owner, place = [], [], []
        for item_id, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORD.findall((text or "").lower())]
            if 0 < len(ids) < seed:
                self.short.setdefault(len(ids), {}).setdefault(tuple(ids), []).append(item_id)
            if len(ids) < seed:
                continue
            h = _window_hashes(np.array(ids), seed)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.items)))
            place.append(np.arange(len(h)))
            self.items.append((item_id, np.array(ids)))
        h = np.concatenate([np.empty(0, np.uint64), *hashes])
        order = np.lexsort((np.concatenate([np.empty(0, np.int64), *owner]), h))
        self.hashes = h[order]
        self.owner, self.place = (np.concatenate([np.empty(0, np.int64), *x])[order] for x in (owner, place))
        self.sizes = np.array([len(ids) for _, ids in self.items], np.int64)


def _window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all windows of n ids."""
    h, mixed = np.zeros(len(ids) - n + 1, np.uint64), _mixed(ids)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * _PRIME + mixed[k : len(ids) - n + 1 + k]
    return h


def _covered(block: _Block, text: str | None, seed: int, coverage: float) -> list[tuple[int, float, int, int]]:
    """(item_id, coverage, tiles, longest tile) of the block's items that a text covers enough of."""
    get = block.vocabulary.get
    ids = np.array([get(w, 0) for w in WORD.findall((text or "").lower())], np.int64)
    found = [(item_id, 1.0, 1, n) for n, items in block.short.items() for key in _whole(ids, n, items) for item_id in items[key]]
    if len(ids) < seed or not block.items:
        return found
    full = ids != 0
    at = np.flatnonzero(np.logical_and.reduce([full[k : len(ids) - seed + 1 + k] for k in range(seed)]))
    if not len(at):
        return found
    h = _window_hashes(ids, seed)[at]
    once = np.unique(h)
    low, high = np.searchsorted(block.hashes, once, "left"), np.searchsorted(block.hashes, once, "right")
    n = high - low
    if not n.any():
        return found
    entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    # words that seeds cover, of all items together: up to the next seed of the item, a whole seed for its last one
    spot = np.sort(block.owner[entry] << 32 | block.place[entry])
    owner = spot >> 32
    words = np.minimum(np.append(np.diff(spot), seed), seed)
    bound = np.bincount(owner, words, len(block.items))
    for o in np.flatnonzero((bound > 0) & (bound >= coverage * block.sizes)):
        item_id, item = block.items[o]
        own = np.unique(block.hashes[entry[block.owner[entry] == o]])
        # only words under a seed can be in a tile; a gap is one mark that matches nothing
        starts = at[np.isin(h, own)]
        spots = np.unique((starts[:, None] + np.arange(seed)).ravel())
        part = np.insert(ids[spots], np.flatnonzero(np.diff(spots) > 1) + 1, -1)
        tiles = tile(item, part, seed)
        words = sum(k for _, _, k in tiles)
        if words >= coverage * len(item):
            found.append((item_id, words / len(item), len(tiles), max(k for _, _, k in tiles)))
    return found


def _whole(ids: np.ndarray, n: int, items: dict[tuple[int, ...], list[int]]) -> list[tuple[int, ...]]:
    """The sequences of n words among ``items`` that a text holds."""
    if len(ids) < n:
        return []
    windows = np.lib.stride_tricks.sliding_window_view(ids, n)
    windows = windows[(windows != 0).all(1)]
    return [key for key in map(tuple, np.unique(windows, axis=0).tolist()) if key in items] if len(windows) else []


def _match(block: _Block, seed: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.claim("decontamination")
        for batch in batches:
            docs, out = batch.column(0).to_pylist(), []
            for at in range(0, batch.num_rows, 512):
                for doc_id, text in zip(docs[at : at + 512], batch.column(1).slice(at, 512).to_pylist()):
                    out += [(doc_id, *f) for f in _covered(block, text, seed, coverage)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "coverage", "n_tiles", "longest"])

    return run


def _blocks(benchmark: DataFrame, seed: int, block_chars: int) -> Iterator[_Block]:
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        block = _Block([(r.item_id, r.text) for r in rows], seed)
        if block.items or block.short:
            yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) for pairs of which tiles cover ``coverage`` of the item's words."""
    schema = "doc_id long, item_id long, coverage double, n_tiles long, longest long"
    found: DataFrame | None = None
    for block in _blocks(benchmark, seed, block_chars):
        own = docs.select("doc_id", "text").mapInArrow(_match(block, seed, coverage), schema)
        found = own if found is None else found.unionByName(own)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs``, all columns, without the rows that ``contaminated`` would name; a map, whatever their number."""
    for block in _blocks(benchmark, seed, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block: _Block = block) -> Iterator[pa.RecordBatch]:
            worker.claim("decontamination")
            for batch in batches:
                text = batch.column(batch.schema.get_field_index("text"))
                keep = []
                for at in range(0, batch.num_rows, 512):
                    keep += [not _covered(block, t, seed, coverage) for t in text.slice(at, 512).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
