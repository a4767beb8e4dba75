"""Exact n-gram Jaccard join with token-combination prefixes.

Texts become sets of hashed word shingles, and equal sets one class. Two sets link if their Jaccard similarity is at
least ``num / den``; the result is every document's component under links.

Signatures. Shingles are ordered by class, rare ones first, then by hash. A set of n shingles shares at least
``need = ceil(num * n / den)`` with any set that it links to, so linked sets share one of their first ``n - need + 1``
shingles, and ``K`` of their first ``n - need + K``. A set whose prefix is all rare indexes its single shingles. One
whose prefix reaches into the frequent class extends it and indexes the ``K``-combinations of its frequent shingles
too; if those would exceed ``COMBINED`` shingles it is dense, indexes its frequent shingles singly, and meets in them
whoever else has them there. The classes only steer how selective signatures are: frequent shingles are the (at most)
``FREQUENT_KEPT`` most common of those that more than ``FREQUENT`` sets hold near the front. Any choice loses nothing.

Candidates, in three rounds. First, every set is compared with the leader of each of the groups that share one of its
first ``STARS`` shingles; then, across components only, with a few chance neighbours in the groups of its first
``CHAINED``. That settles groups of near copies without their pairs. Last, all sets that share a signature are compared
unless they are in one component already, or their sizes, their places in the order or their digests rule a link out.
A digest is a parity bitmap: two of them differ in no more bits than their sets in shingles. Digests of one length tell
little of large sets, so the last round names no pairs by them: it names the sets that have any partner left, with the
runs in which, and these meet there once more with bitmaps as long as their sets. In the other rounds such bitmaps thin
the pairs. What is left is verified on whole sets, in groups dealt out by the leading set in blocks of ``BLOCK``.

Texts are shingled into the base of each set, which is the least shingles by hash and a little more than what rare ones
sign with; texts whose base holds many frequent shingles are shingled again to be signed, and those of candidates to be
verified, so that no whole set is stored. Signatures travel as packed arrays by signature range, about
``RANGE_ENTRIES`` entries in each; a range that a hot signature makes wider than ``WIDE`` is cut into blocks of owners,
and every two blocks meet in a task of their own. Copies of a set collapse wherever they meet. Before a join, rows are
thinned by a semi-join on the id's hash modulo ``thinning.BUCKETS``, whose broadcast side has at most that many numbers; nothing
that grows with the corpus is broadcast, and the driver collects one number for each wide range.

Sets are told apart by 128 bits: 64 are the key, and where two sets have one key the other 64 make new ones.

Edge cases: null and empty texts have no shingles and are alone; texts shorter than a shingle are one shingle; a null
doc_id is never a component_id unless all of its component are null; repeated rows are rows of their own in one
component; an empty table gives an empty result; extra columns are ignored. ``one_of_each`` keeps one row of each
component, that of the smallest doc_id, and of its repeated rows the one of least JSON text; of texts without
shingles, one row for each doc_id, and all whose doc_id is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallaxis.llm import storage, worker
from parallaxis.llm.components import components
from parallaxis.llm.thinning import thinned

K = 2
#: A shingle is frequent if more sets than this hold it near the front; at most FREQUENT_KEPT are (4 bytes each, broadcast).
FREQUENT, FREQUENT_KEPT = 32, 1_000_000
#: Frequent shingles of a set whose combinations are indexed at most.
COMBINED = 24
#: Entries of a range on average: a set's record goes once to each range that it has an entry in, so few ranges are lean.
RANGE_ENTRIES, BLOCK, STARS, CHAINED = 1_500_000, 256, 3, 10
#: Shingles of a base besides the front and an eighth of it.
SPARE = 8
#: Entries of a range above which it is cut, and front shingles that are counted in one group on average.
WIDE, FRONT_ENTRIES = 2 * RANGE_ENTRIES, 2_000_000
CACHED_WORDS = 200_000
#: 64-bit words of the parity bitmap that travels with every signature's owner.
DIGEST_WORDS = 4
#: Bytes of bitmaps that are compared at once.
COMPARED_BYTES = 1 << 22

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
#: An odd factor that scatters 32-bit numbers, and its inverse.
SCATTER, GATHER = np.uint32(0x9E3779B1), np.uint32(pow(0x9E3779B1, -1, 1 << 32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_digest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _WordHashes:
    return _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, _U)
    h = np.frombuffer(b"".join(map(_words().__getitem__, found)), _U)
    size = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, _U)
        for k in range(size):
            out = out * _P + h[k : len(h) - size + 1 + k]
        return np.unique(_mix(out))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others, as two longs."""
    found = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def need(n, num: int, den: int):
    return -(-num * n // den)


def _scan(words: int, num: int, den: int):
    """Each row's size of set and key; and base and bitmaps with the first row of a batch that has the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.claim("shingles")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, seen = [], set()
                for text in part.column("_text").to_pylist():
                    s = shingles(text, words)
                    own = set_key(s)
                    fresh = len(s) >= least_size(num, den) and own not in seen
                    seen.add(own)
                    rows.append((len(s), *own, *((s[: base_size(len(s), num, den)].tobytes(), parity_bitmap(s), digest(s)) if fresh else (None, None, None))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("_hash"), *(pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.binary()) for k in range(6))], names=_SCAN)

    return run


_SCAN = ["doc_id", "hash", "n", "key", "other", "base", "bitmap", "digest"]


def base_size(n: int, num: int, den: int) -> int:
    """Shingles in the base of a set of n: the front, an eighth more, and SPARE."""
    front = n - need(n, num, den) + 1
    return min(n, front + front // 8 + SPARE)


def _fronts(spans: int):
    """The upper halves of the shingles in the base of each set, scattered, by span: the least hashes are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                fronts = []
                for packed in b.column(0).slice(at, 4096).to_pylist():
                    fronts.append((np.frombuffer(packed, _U) >> _U(32)).astype(np.uint32))
                front = np.sort(np.concatenate(fronts) * SCATTER)
                cut = np.searchsorted(front, (np.arange(spans + 1) << 32) // spans)
                parts = [(r, front[a:z].tobytes()) for r, (a, z) in enumerate(zip(cut, cut[1:])) if z > a]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary())], names=["span", "front"])

    return run


def _frequent(table: pa.Table, more_than: int) -> pa.Table:
    values, counts = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in table["front"].to_pylist()]), return_counts=True)
    keep = counts > more_than
    return pa.table({"half": pa.array(values[keep].astype(np.int64)), "sets": pa.array(counts[keep].astype(np.int64))})


class FrequentClass:
    """Which shingles are frequent, by the upper halves of their hashes; a bit for each upper quarter spares look-ups."""

    def __init__(self, halves: np.ndarray):
        self.halves = np.sort(halves.astype(np.uint32))
        self.quarters = np.zeros(1 << 24, bool)
        self.quarters[self.halves >> np.uint32(8)] = True

    def __call__(self, s: np.ndarray) -> np.ndarray:
        half = (s >> _U(32)).astype(np.uint32)
        out = self.quarters[half >> np.uint32(8)]
        if out.any():
            near = np.searchsorted(self.halves, half[out])
            out[out] = self.halves[np.minimum(near, len(self.halves) - 1)] == half[out]
        return out


@lru_cache(maxsize=1)
def _class_of(halves: bytes) -> FrequentClass:
    """One for each worker: what is sent to it are the sorted halves alone."""
    return FrequentClass(np.frombuffer(halves, np.uint32))


worker.register("shingles", lambda: (_words.cache_clear(), _class_of.cache_clear()))


def parity_bitmap(s: np.ndarray) -> bytes:
    """Bit b is the parity of the shingles whose hash is b modulo the bitmap's length, at least twice the set's size."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def digest(s: np.ndarray) -> bytes:
    """A parity bitmap of DIGEST_WORDS words, whatever the set's size."""
    bits = 64 * DIGEST_WORDS
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def bitmap_difference(a: bytes, b: bytes) -> int:
    """At most the number of shingles that are in one set only: the longer bitmap is folded to the shorter's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


class Bitmaps:
    """Parity bitmaps of sets by number, folded beforehand to every length that any of them has."""

    def __init__(self, maps: list[bytes]):
        self.size = np.array([len(x) for x in maps], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        longer = np.empty((0, 0), np.uint8)
        for size in map(int, np.unique(self.size)[::-1]):
            has = np.flatnonzero(self.size >= size)
            own = self.size[has] == size
            rows = np.empty((len(has), size), np.uint8)
            rows[own] = np.frombuffer(b"".join(maps[k] for k in has[own]), np.uint8).reshape(-1, size)
            if len(longer):
                rows[~own] = np.bitwise_xor.reduce(longer.reshape(len(longer), -1, size), axis=1)
            place = np.zeros(len(maps), np.int32)
            place[has] = np.arange(len(has))
            self.folded[size], longer = (place, rows.view(_U)), rows

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``bitmap_difference`` of the sets of each pair."""
        least, out = np.minimum(self.size[x], self.size[y]), np.zeros(len(x), np.int64)
        for size in map(int, np.unique(least)):
            place, rows = self.folded[size]
            pairs, step = np.flatnonzero(least == size), max(1, COMPARED_BYTES // size)
            for k in range(0, len(pairs), step):
                at = pairs[k : k + step]
                out[at] = np.bitwise_count(rows[place[x[at]]] ^ rows[place[y[at]]]).sum(-1, dtype=np.int64)
        return out


def least_size(num: int, den: int) -> int:
    """Shingles of the smallest set that another one may link to: a single one is in half of another set at most."""
    return 2 if 2 * num > den else 1


SINGLE, MEETS_DENSE, DENSE = 0, 1, 2


def signatures(s: np.ndarray, n: int, frequent: FrequentClass, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The signatures of a set of n shingles, the places of their first shingles in the set's order, and their kinds.

    ``s`` is the set or its base; None if the base does not tell. Single shingles are scattered, as those at the front
    are the least hashes and would all fall into the first ranges.
    """
    if n < least_size(num, den):
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    common = frequent(s)
    rare, least = len(s) - int(common.sum()), need(n, num, den)
    front = n - least + 1
    if rare < front and len(s) < n:
        return None
    ordered = np.concatenate([s[~common], s[common]])
    out, at, kind = [_mix(ordered[: min(rare, front)])], [np.arange(min(rare, front))], [np.full(min(rare, front), SINGLE)]
    if rare < front:
        extended = ordered[rare : front + K - 1]
        dense = len(extended) > COMBINED or least < K
        singly = ordered[rare:front]
        out.append(_mix(singly))
        at.append(rare + np.arange(len(singly)))
        kind.append(np.full(len(singly), DENSE if dense else MEETS_DENSE))
        if not dense:
            a, b = np.triu_indices(len(extended), 1)
            with np.errstate(over="ignore"):
                out.append(_mix(extended[a] * _P + extended[b]))
            at.append(rare + a)
            kind.append(np.full(len(a), SINGLE))
    return np.concatenate(out), np.concatenate(at), np.concatenate(kind)


#: A signature in flight: its owner's number in the batch, and its place (at most 16383) times 4 plus its kind.
_ENTRY = np.dtype([("sig", "<u8"), ("doc", "<u2"), ("at_kind", "<u2")])
_OWNER = np.dtype([("key", "<i8"), ("label", "<i8"), ("n", "<u4"), ("bits", "<u8", DIGEST_WORDS)])
_STORED = np.dtype([("sig", "<u8"), ("at_kind", "<u2")])
LAST_PLACE = (1 << 14) - 1


def _stored(found: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> bytes | None:
    if found is None:
        return None
    entry = np.zeros(len(found[0]), _STORED)
    entry["sig"], entry["at_kind"] = found[0], np.minimum(found[1], LAST_PLACE) * 4 + found[2]
    return entry.tobytes()


def _sign(num: int, den: int, halves: bytes):
    """Packed signatures from the bases of sets, null where those do not tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.claim("shingles")
        frequent = _class_of(halves)
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                signed = [_stored(signatures(np.frombuffer(base, _U), n, frequent, num, den)) for base, n in zip(part.column("base").to_pylist(), part.column("n").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n"), pa.array(signed, pa.binary()), part.column("bitmap"), part.column("digest")], names=_SIGNED)

    return run


_SIGNED = ["key", "n", "sigs", "bitmap", "digest"]


def _sets(batches: Iterator[pa.RecordBatch], words: int, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, np.ndarray]]]]:
    """Batches with a text and the second half of a set's key, and the (row, set) of those that are the set's, each once."""
    worker.claim("shingles")
    seen = set()
    for b in batches:
        for start in range(0, b.num_rows, rows):
            part = b.slice(start, rows)
            found = []
            for i, (text, key, other) in enumerate(zip(part.column("_text").to_pylist(), part.column("key").to_pylist(), part.column("other").to_pylist())):
                if key not in seen and set_key(s := shingles(text, words))[1] == other:
                    seen.add(key)
                    found.append((i, s))
            yield part, found


def _sign_texts(words: int, num: int, den: int, halves: bytes):
    """As ``_sign``, from texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _class_of(halves)
        for part, found in _sets(batches, words):
            sets, keys = [s for _, s in found], part.column("key").take(pa.array([i for i, _ in found], pa.int64()))
            signed = [_stored(signatures(s, len(s), frequent, num, den)) for s in sets]
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(s) for s in sets], pa.int64()), pa.array(signed, pa.binary()), pa.array([parity_bitmap(s) for s in sets], pa.binary()), pa.array([digest(s) for s in sets], pa.binary())], names=_SIGNED)

    return run


def _route(words: int):
    """Sends a text's set to every block that compares it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _sets(batches, words):
            keys, routes = part.column("key").to_pylist(), part.column("routes").to_pylist()
            rows = [(r["a"], r["block"], keys[i], len(s), packed) for i, s in found for packed in [s.tobytes()] for r in routes[i]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["a", "block", "key", "n", "sent"])

    return run


def _edges(ranges: int) -> np.ndarray:
    return np.array([(r << 64) // ranges for r in range(1, ranges)], dtype=_U)


def _tally(ranges: int, first: int | None):
    """How many signatures fall into each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, total = _edges(ranges), np.zeros(ranges, np.int64)
        for b in batches:
            for packed in b.column(0):
                total += np.bincount(np.searchsorted(edges, np.frombuffer(packed.as_py(), _STORED)[:first]["sig"], "right"), minlength=ranges)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["span", "entries"])

    return run


def _block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(keys.view(_U)) % _U(blocks)).astype(np.int64)


def _everyone(block: int, blocks: int) -> list[tuple[int, int]]:
    """The pairs of blocks that a block is in, if all blocks meet."""
    return [(min(block, k), max(block, k)) for k in range(blocks)]


def _leaders(block: int, blocks: int) -> list[tuple[int, int]]:
    """The pairs of blocks that a block is in, if all meet the first alone."""
    return [(0, k) for k in range(blocks)] if block == 0 else [(0, block)]


def _alone(block: int, blocks: int) -> list[tuple[int, int]]:
    return [(block, block)]


def _deal(ranges: int, first: int | None, wide: dict[int, int], meets: Callable[[int, int], list[tuple[int, int]]]):
    """Packs the signatures of (key, n, sigs, label) rows by range; with ``first``, only that many of each set.

    ``wide`` gives the number of blocks of the ranges that are cut, ``meets`` the pairs of blocks that need a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.claim("signature ranges")
        edges = _edges(ranges)
        for b in batches:
            for start in range(0, b.num_rows, 8192):
                part = b.slice(start, 8192)
                owners = np.zeros(part.num_rows, _OWNER)
                owners["key"], owners["n"], owners["label"] = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "label"))
                owners["bits"] = np.frombuffer(b"".join(part.column("digest").to_pylist()), "<u8").reshape(-1, DIGEST_WORDS)
                stored = [np.frombuffer(x, _STORED)[:first] for x in part.column("sigs").to_pylist()]
                entries = np.zeros(sum(map(len, stored)), _ENTRY)
                if not len(entries):
                    continue
                whole = np.concatenate(stored)
                entries["sig"], entries["at_kind"] = whole["sig"], whole["at_kind"]
                entries["doc"] = np.repeat(np.arange(len(stored), dtype=np.uint16), [len(x) for x in stored])
                entries = entries[np.argsort(entries["sig"], kind="stable")]
                cut = [0, *np.searchsorted(entries["sig"], edges), len(entries)]
                rows = []

                def put(r: int, i: int, j: int, own: np.ndarray, owners: np.ndarray = owners, rows: list = rows) -> None:
                    own = own.copy()
                    used, own["doc"] = np.unique(own["doc"], return_inverse=True)
                    # field by field, which compresses better than entry by entry
                    rows.append((r, i, j, owners[used].tobytes(), b"".join(own[c].tobytes() for c in ("sig", "doc", "at_kind"))))

                for r, (a, z) in enumerate(zip(cut, cut[1:])):
                    if z > a and r not in wide:
                        put(r, 0, 0, entries[a:z])
                    elif z > a:
                        block = _block_of(owners["key"][entries["doc"][a:z]], wide[r])
                        for k in np.unique(block):
                            for i, j in meets(int(k), wide[r]):
                                put(r, i, j, entries[a:z][block == k])
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["span", "i", "j", "owners", "entries"])

    return run


@dataclass
class _Range:
    """A range's entries in order of signature with copies collapsed: for each the number of its set, place and kind."""

    own: np.ndarray
    at: np.ndarray
    kind: np.ndarray
    bounds: np.ndarray
    keys: np.ndarray
    labels: np.ndarray
    sizes: np.ndarray
    #: Digests, or whole bitmaps.
    bits: np.ndarray | Bitmaps
    #: The block that each set is of, if two blocks of a range that was cut meet here.
    side: np.ndarray | None

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray | bool:
        """Whether two sets are of different blocks, where blocks meet that have met themselves elsewhere."""
        return True if self.side is None else self.side[x] != self.side[y]

    def near(self, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether bitmaps differ in no more bits than linked sets of these sizes differ in shingles."""
        apart = self.bits.apart(x, y) if isinstance(self.bits, Bitmaps) else np.bitwise_count(self.bits[x] ^ self.bits[y]).sum(-1, dtype=np.int64)
        return (den + num) * apart <= (den - num) * (self.sizes[x] + self.sizes[y])


def _gather(table: pa.Table, wide: dict[int, int]) -> _Range:
    worker.claim("signature ranges")
    span, i, j = (table[c][0].as_py() for c in ("span", "i", "j"))
    owners = np.concatenate([np.frombuffer(x.as_py(), _OWNER) for x in table["owners"]])
    keys, first, number = np.unique(owners["key"], return_index=True, return_inverse=True)
    labels, sizes, number = owners["label"][first], owners["n"][first].astype(np.int64), number.astype(np.uint32)
    sig, own, at_kind, offset = [], [], [], 0
    for own_blob, blob in zip(table["owners"], table["entries"]):
        blob = blob.as_py()
        size = len(blob) // _ENTRY.itemsize
        sig.append(np.frombuffer(blob, "<u8", size))
        own.append(number[offset + np.frombuffer(blob, "<u2", size, 8 * size).astype(np.int64)])
        at_kind.append(np.frombuffer(blob, "<u2", size, 10 * size))
        offset += len(own_blob.as_py()) // _OWNER.itemsize
    sig, own, at_kind = np.concatenate(sig), np.concatenate(own), np.concatenate(at_kind)
    order = np.lexsort((own, sig))
    sig, own, at_kind = sig[order], own[order], at_kind[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
    sig, own, at_kind = sig[fresh], own[fresh], at_kind[fresh]
    bounds = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]]))
    side = _block_of(keys, wide[span]) if i != j else None
    return _Range(own, at_kind >> 2, at_kind & 3, bounds, keys, labels, sizes, owners["bits"][first], side)


def _possible(n1, at1, n2, at2, num: int, den: int):
    """Whether sizes, and what follows the first shared shingle in either order, leave room for a link."""
    # 100 i >= 85 (a + b - i), that is (den + num) i >= num (a + b)
    return (den + num) * np.minimum(n1 - at1, n2 - at2) >= num * (n1 + n2)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(found: _Range, a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
    """Distinct pairs of sets, the smaller key first: keys are in order, so numbers compare as keys do."""
    x, y = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
    both = np.unique(np.minimum(x, y) << 32 | np.maximum(x, y))
    return pa.table([pa.array(found.keys[both >> 32]), pa.array(found.keys[both & 0xFFFFFFFF])], schema=_PAIRS)


def _stars(f: _Range, num: int, den: int) -> pa.Table:
    """Every set of a run with the run's leader, which is of the first block if that has any of the run."""
    leads = f.bounds[:-1]
    if f.side is not None:
        place = np.where(f.side[f.own] == 0, np.arange(len(f.own)), len(f.own))
        first = np.minimum.reduceat(place, leads)
        leads = np.where(first < f.bounds[1:], first, leads)
    head = np.repeat(leads, np.diff(f.bounds))
    n, at = f.sizes[f.own], f.at.astype(np.int64)
    ok = (np.arange(len(f.own)) != head) & _possible(n, at, n[head], at[head], num, den)
    x, y = f.own[head[ok]], f.own[ok]
    ok = f.near(x, y, num, den)
    return _pairs(f, [x[ok]], [y[ok]])


def _chains(f: _Range, num: int, den: int) -> pa.Table:
    """Every set of a run with the next two of other components, in an order of chance that differs between runs."""
    run = np.repeat(np.arange(len(f.bounds) - 1), np.diff(f.bounds))
    with np.errstate(over="ignore"):
        chance = _mix(f.keys.view(_U)[f.own] ^ (run.astype(_U) + _U(1)) * _P)
    order = np.lexsort((chance, run))
    run, own, at = run[order], f.own[order], f.at[order].astype(np.int64)
    a, b = [], []
    for gap in (1, 2):
        x, y = own[:-gap], own[gap:]
        ok = (run[:-gap] == run[gap:]) & (f.labels[x] != f.labels[y]) & _possible(f.sizes[x], at[:-gap], f.sizes[y], at[gap:], num, den)
        x, y = x[ok], y[ok]
        ok = f.near(x, y, num, den)
        a.append(x[ok])
        b.append(y[ok])
    return _pairs(f, a, b)


def _cross(f: _Range, num: int, den: int, found: Callable[[np.ndarray, np.ndarray], None], rows: int = 256) -> None:
    """Gives ``found`` the entries, pair by pair, of sets that share a run and may link, of different components."""
    runs = np.diff(f.bounds)

    def fitting(i, j):
        x, y = f.own[i], f.own[j]
        ok = (f.labels[x] != f.labels[y]) & f.apart(x, y) & _possible(f.sizes[x], f.at[i].astype(np.int64), f.sizes[y], f.at[j].astype(np.int64), num, den)
        p, q = f.kind[i], f.kind[j]
        return ok & ((p == SINGLE) & (q == SINGLE) | (p == DENSE) | (q == DENSE))

    def add(i, j):
        ok = f.near(f.own[i], f.own[j], num, den)
        found(i[ok], j[ok])

    twos = f.bounds[:-1][runs == 2]
    twos = twos[fitting(twos, twos + 1)]
    add(twos, twos + 1)
    for start, size in zip(f.bounds[:-1][runs > 2], runs[runs > 2]):
        own = f.own[start : start + size]
        if (f.labels[own] == f.labels[own[0]]).all() or (f.kind[start : start + size] == MEETS_DENSE).all():
            continue
        by_size = start + np.argsort(f.sizes[own], kind="stable")
        m = f.sizes[f.own[by_size]]
        for x in range(0, size, rows):
            end = min(x + rows, size)
            # no set more than den / num times as large can link
            for y in range(x, np.searchsorted(m, m[end - 1] * den // num, "right"), 4 * rows):
                i, j = np.arange(x, end)[:, None], np.arange(y, min(y + 4 * rows, size))[None]
                i, j = np.nonzero((i < j) & fitting(by_size[i], by_size[j]))
                add(by_size[i + x], by_size[j + y])


#: An entry whose set has a partner: its run's number in the range, and its place times 4 plus its kind.
_MEETING = np.dtype([("run", "<u4"), ("at_kind", "<u2")])
_MET = pa.schema([(c, pa.int64()) for c in ("span", "i", "j", "key", "n", "label")] + [("entries", pa.binary())])


def _meetings(table: pa.Table, wide: dict[int, int], num: int, den: int) -> pa.Table:
    """The sets of a range that their digests let cross with any other, each with the entries at which."""
    f = _gather(table, wide)
    met = np.zeros(len(f.own), bool)

    def mark(i: np.ndarray, j: np.ndarray) -> None:
        met[i] = met[j] = True

    _cross(f, num, den, mark)
    at = np.flatnonzero(met)
    at = at[np.argsort(f.own[at], kind="stable")]
    entries = np.zeros(len(at), _MEETING)
    entries["run"], entries["at_kind"] = np.searchsorted(f.bounds, at, "right") - 1, f.at[at] * 4 + f.kind[at]
    own, first = np.unique(f.own[at], return_index=True)
    packed = [entries[a:z].tobytes() for a, z in zip(first, [*first[1:], len(at)])]
    here = [pa.array(np.full(len(own), table[c][0].as_py(), np.int64)) for c in ("span", "i", "j")]
    return pa.table([*here, pa.array(f.keys[own]), pa.array(f.sizes[own]), pa.array(f.labels[own]), pa.array(packed, pa.binary())], schema=_MET)


def _crossings(table: pa.Table, wide: dict[int, int], num: int, den: int) -> pa.Table:
    """Pairs of the sets that ``_meetings`` found in a range, whose whole bitmaps leave a link possible."""
    worker.claim("signature ranges")
    span, i, j = (table[c][0].as_py() for c in ("span", "i", "j"))
    table = table.sort_by("key")  # numbers compare as keys do
    blobs = table["entries"].to_pylist()
    entries = np.frombuffer(b"".join(blobs), _MEETING)
    own = np.repeat(np.arange(len(blobs), dtype=np.uint32), [len(x) // _MEETING.itemsize for x in blobs])
    order = np.lexsort((own, entries["run"]))
    run, own, at_kind = entries["run"][order], own[order], entries["at_kind"][order]
    bounds = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
    keys, labels, sizes = (table[c].to_numpy() for c in ("key", "label", "n"))
    side = _block_of(keys, wide[span]) if i != j else None
    f = _Range(own, at_kind >> 2, at_kind & 3, bounds, keys, labels, sizes, Bitmaps(table["bitmap"].to_pylist()), side)
    a, b = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        a.append(f.own[i])
        b.append(f.own[j])

    _cross(f, num, den, add)
    return _pairs(f, a, b)


def _led(table: pa.Table) -> tuple[int, tuple[int, bytes], dict[int, tuple[int, bytes]]]:
    """The leading key of a block, what was sent of its set, and of the sets that it is compared with."""
    lead = table["a"][0].as_py()
    sets = {k: (n, x) for k, n, x in zip(table["key"].to_pylist(), table["n"].to_pylist(), table["sent"].to_pylist())}
    return lead, sets.pop(lead), sets


def _thin(table: pa.Table, num: int, den: int) -> pa.Table:
    """Pairs of a block whose bitmaps leave a link possible."""
    worker.claim("signature ranges")
    lead, (n, own), sets = _led(table)
    kept = [k for k, (m, other) in sets.items() if (den + num) * bitmap_difference(own, other) <= (den - num) * (n + m)]
    return pa.table([pa.array([lead] * len(kept), pa.int64()), pa.array(kept, pa.int64())], schema=_PAIRS)


def _verify(table: pa.Table, num: int, den: int) -> pa.Table:
    """Pairs of a block that link."""
    worker.claim("signature ranges")
    lead, (n, packed), sets = _led(table)
    own = np.frombuffer(packed, _U)
    linked = []
    for key, (m, other) in sets.items():
        other = np.frombuffer(other, _U)
        near = np.searchsorted(own, other)
        both = int((own[np.minimum(near, n - 1)] == other).sum())
        if den * both >= num * (n + m - both):
            linked.append(key)
    return pa.table([pa.array([lead] * len(linked), pa.int64()), pa.array(linked, pa.int64())], schema=_PAIRS)


class JaccardJoin:
    """Links and components of ``docs(doc_id, text)`` under ``den * |A and B| >= num * |A or B|``."""

    def __init__(self, docs: DataFrame, words: int = 5, num: int = 80, den: int = 100):
        self.docs, self.words, self.num, self.den = docs.select("doc_id", F.col("text").alias("_text"), F.xxhash64("text").alias("_hash")), words, num, den
        self.spark = docs.sparkSession

    def _ranges(self, entries: int, each: int) -> int:
        return max(2 * self.spark.sparkContext.defaultParallelism, -(-entries // each))

    def _dealt(self, signed: DataFrame, meets: Callable, entries: int, first: int | None = None) -> tuple[GroupedData, dict[int, int]]:
        """Signatures by range and pair of blocks, and the number of blocks of the ranges that are cut."""
        ranges = self._ranges(entries, RANGE_ENTRIES)
        tally = signed.select("sigs").mapInArrow(_tally(ranges, first), "span long, entries long").groupBy("span").agg(F.sum("entries").alias("entries"))
        wide = {r.span: -(-r.entries // RANGE_ENTRIES) for r in tally.filter(F.col("entries") > WIDE).collect()}
        dealt = signed.select("key", "n", "sigs", "digest", "label").mapInArrow(_deal(ranges, first, wide, meets), "span long, i long, j long, owners binary, entries binary")
        return dealt.groupBy("span", "i", "j"), wide

    def _candidates(self, signed: DataFrame, meet: Callable[[_Range, int, int], pa.Table], meets: Callable, entries: int, first: int) -> DataFrame:
        num, den = self.num, self.den
        dealt, wide = self._dealt(signed, meets, entries, first)
        met = dealt.applyInArrow(lambda t: meet(_gather(t, wide), num, den), "a long, b long")
        return storage.materialize(met.distinct(), "candidates")

    def _crossed(self, labelled: DataFrame, signed: DataFrame, entries: int) -> tuple[DataFrame, DataFrame]:
        """Sets that have partners, by range, and pairs of them whose bitmaps leave a link possible."""
        num, den = self.num, self.den
        dealt, wide = self._dealt(labelled, _everyone, entries)
        met = storage.materialize(dealt.applyInArrow(lambda t: _meetings(t, wide, num, den), "span long, i long, j long, key long, n long, label long, entries binary"), "meetings")
        maps = thinned(signed.select("key", "bitmap"), ["key"], met).groupBy("key").agg(F.first("bitmap").alias("bitmap"))
        pairs = met.join(maps, "key").groupBy("span", "i", "j").applyInArrow(lambda t: _crossings(t, wide, num, den), "a long, b long")
        return met, storage.materialize(pairs.distinct(), "thinned")

    @staticmethod
    def _routes(pairs: DataFrame) -> DataFrame:
        """(key, a, block): where each set of a pair is to be sent."""
        count = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        blocked = pairs.join(count, "a").select(F.col("b").alias("key"), "a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
        heads = count.select(F.col("a").alias("key"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        # only blocks that a pair falls into need their head
        return blocked.unionByName(heads.join(blocked.select("a", "block").distinct(), ["a", "block"], "left_semi").select("key", "a", "block"))

    def _thinned(self, pairs: DataFrame, signed: DataFrame) -> DataFrame:
        """Pairs whose bitmaps leave a link possible."""
        num, den = self.num, self.den
        sides = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key")))
        maps = thinned(signed.select("key", "n", "bitmap"), ["key"], sides).groupBy("key").agg(F.first("n").alias("n"), F.first("bitmap").alias("sent"))
        return storage.materialize(self._routes(pairs).join(maps, "key").groupBy("a", "block").applyInArrow(lambda t: _thin(t, num, den), "a long, b long"), "thinned")

    def _texts(self, asked: DataFrame, classes: DataFrame) -> DataFrame:
        """``asked(key, ...)`` with the second half of the key and a text of each class."""
        asked = storage.materialize(asked.join(classes.select("key", "other", "lead"), "key"), "asked")
        texts = thinned(self.docs, ["_hash"], asked.select(F.col("lead.hash").alias("_hash")))
        return texts.join(asked, (F.col("_hash") == F.col("lead.hash")) & F.col("doc_id").eqNullSafe(F.col("lead.doc_id"))).drop("doc_id", "_hash", "lead")

    def _verified(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs that link."""
        num, den = self.num, self.den
        routes = self._routes(pairs).groupBy("key").agg(F.collect_list(F.struct("a", "block")).alias("routes"))
        sent = self._texts(routes, classes).mapInArrow(_route(self.words), "a long, block long, key long, n long, sent binary")
        return storage.materialize(sent.groupBy("a", "block").applyInArrow(lambda t: _verify(t, num, den), "a long, b long"), "links")

    def _scanned(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, hash, n, key, other, base, bitmap, digest) of all rows, and (key, other, doc_id, lead) of the classes."""
        schema = ", ".join(f"{c} {'long' if k < 5 else 'binary'}" for k, c in enumerate(_SCAN))
        scanned = storage.materialize(self.docs.mapInArrow(_scan(self.words, self.num, self.den), schema), "shingle-bases")
        lead = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
        while True:
            classes = scanned.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min(lead).alias("lead"), F.min("other").alias("other"), F.max("other").alias("most"))
            classes = storage.materialize(classes, "classes")
            clash = classes.filter("other <> most").select(F.col("key").alias("_key"))
            if clash.isEmpty():
                return scanned, classes
            hit = scanned.join(clash, F.col("key") == F.col("_key"), "left").withColumn("key", F.when(F.col("_key").isNull(), F.col("key")).otherwise(F.xxhash64("key", "other"))).drop("_key")
            scanned, before = storage.materialize(hit, "shingle-bases"), scanned
            storage.drop(before, classes)

    def _signed(self, scanned: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(key, n, sigs, bitmap, digest) of every class, more than once if several batches hold it, in two tables."""
        num, den = self.num, self.den
        bases = scanned.filter("base is not null").select("key", "n", "base", "bitmap", "digest")
        spans = self._ranges((bases.agg(F.sum(F.octet_length("base"))).first()[0] or 0) // 8, FRONT_ENTRIES)
        common = bases.select("base").mapInArrow(_fronts(spans), "span long, front binary").groupBy("span").applyInArrow(lambda t: _frequent(t, FREQUENT), "half long, sets long")
        kept = common.orderBy(F.desc("sets"), "half").limit(FREQUENT_KEPT).toArrow()
        halves = np.sort(kept["half"].to_numpy().astype(np.uint32) * GATHER).tobytes()
        schema = "key long, n long, sigs binary, bitmap binary, digest binary"
        signed = storage.materialize(bases.mapInArrow(_sign(num, den, halves), schema), "signatures")
        again = signed.filter("sigs is null").select("key").distinct()
        whole = storage.materialize(self._texts(again, classes).mapInArrow(_sign_texts(self.words, num, den, halves), schema), "signatures")
        return signed, whole

    def resolve(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, n, key, other) of every row, and (key, other, doc_id, root) of every class of equal sets."""
        scanned, classes = self._scanned()
        based, whole = self._signed(scanned, classes)
        signed = based.filter("sigs is not null").unionByName(whole)
        many, total = signed.agg(F.count(F.lit(1)), F.sum(F.octet_length("sigs"))).first()
        links = roots = None
        labelled = signed.withColumn("label", F.col("key"))
        for meet, meets, first in ((_stars, _leaders, STARS), (_chains, _alone, CHAINED), (None, None, None)):
            if meet is not None:
                candidates = self._candidates(labelled, meet, meets, first * many, first)
                thin = self._thinned(candidates, signed)
            else:
                candidates, thin = self._crossed(labelled, signed, (total or 0) // _STORED.itemsize)
            verified = self._verified(thin, classes)
            found = verified.select(F.col("a").alias("u"), F.col("b").alias("v"))
            before, roots = roots, storage.materialize(components(found if links is None else links.unionByName(found)), "roots")
            storage.drop(candidates, thin, verified, before)
            # labels replace what they join, so that the next round sees one component as one
            links = roots.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
            labelled = signed.join(roots, signed["key"] == roots["node"], "left").select("key", "n", "sigs", "digest", F.coalesce("root", "key").alias("label"))
        rows = storage.materialize(scanned.select("doc_id", "n", "key", "other"), "shingled-rows")
        rooted = storage.materialize(classes.join(roots, classes["key"] == roots["node"], "left").select("key", "other", "doc_id", F.coalesce("root", "key").alias("root")), "rooted-classes")
        storage.drop(scanned, classes, based, whole, roots)
        return rows, rooted

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        rows, rooted = self.resolve()
        least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        found = rooted.join(least, "root").select(F.col("key").alias("_key"), "component_id")
        whole = rows.join(found, (F.col("key") == F.col("_key")) & (F.col("n") > 0), "left")
        return whole.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked by shingle similarity of ``num / den`` or more."""
    return JaccardJoin(docs, words, num, den).run()


def _with_set(words: int):
    """Rows with their set's size and the second half of its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.claim("shingles")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(text, words) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s)[1] for s in sets], pa.int64())], names=["row", "n", "other"])

    return run


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs``, all columns, with one row of each component."""
    rows, rooted = JaccardJoin(docs, words, num, den).resolve()
    # nulls last: a component is led by its smallest id, and by the least key of those that have it
    led = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "other")).alias("lead")).select("lead.doc_id", "lead.other")
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    many = storage.materialize(ids.filter("rows > 1 or doc_id is null").select(F.col("doc_id").alias("_many")), "repeated-ids")
    chosen = led.select("doc_id").unionByName(rows.filter("n = 0").select("doc_id")).distinct().select(F.col("doc_id").alias("_chosen"))
    with_id = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"))
    single = with_id.join(chosen, F.col("_doc") == F.col("_chosen"), "left_semi")
    if many.isEmpty():
        return single.select("row.*")
    single = single.join(many, F.col("_doc").eqNullSafe(F.col("_many")), "left_anti").select("row")
    schema = T.StructType([with_id.schema["row"], T.StructField("n", T.LongType()), T.StructField("other", T.LongType())])
    repeated = with_id.join(many, F.col("_doc").eqNullSafe(F.col("_many")), "left_semi").select("row", F.col("row.text").alias("text"))
    repeated = repeated.mapInArrow(_with_set(words), schema).withColumn("_doc", F.col("row.doc_id"))
    led = led.select(F.col("doc_id").alias("_lead"), F.col("other").alias("_other"))
    kept = repeated.join(led, F.col("_doc").eqNullSafe(F.col("_lead")) & (F.col("other") == F.col("_other")) & (F.col("n") > 0), "left")
    kept = kept.filter((F.col("_other").isNotNull()) | ((F.col("n") == 0) & F.col("_doc").isNotNull()))
    kept = kept.groupBy("_doc", "other").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    wordless = repeated.filter("n = 0 and _doc is null").select("row")
    return single.unionByName(kept).unionByName(wordless).select("row.*")
