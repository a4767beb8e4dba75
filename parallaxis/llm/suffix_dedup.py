"""Removal of repeated passages by a logarithmic family of sparse suffix arrays.

A passage of ``length`` bytes that also starts earlier is removed. Every window of that length owns an anchor: of the
``GRAM``-byte strings in it, the one whose fingerprint is smallest. Neighbouring windows mostly share theirs, so a text
falls into runs of windows about one anchor, a few hundredths of its bytes in number, and equal windows have equal
anchors wherever they stand. An entry of the index is such a run: its anchor's fingerprint, that of the run's bytes,
and its place. Equal runs are one entry, that of the earliest place; fingerprints of anchor and run are 128 bits
together and are taken for their strings.

A new batch of documents is fingerprinted, entries that repeat within a block of it are settled there, and the rest is
merge-scanned with the levels of the index in the order of anchor, run and place. A run that is held already, or occurs
earlier in the batch, is repeated as a whole. Different runs about one anchor share windows where passages begin or end:
their bytes are fetched, and the suffixes that begin at their windows are sorted by their bytes, those of the batch and
of the levels alike; neighbours with ``length`` equal bytes are matches, of which the earliest stays. What is new becomes
a level; levels of equal rank are merged before the next batch, so there are as many levels as the number of batches has
binary digits.

Anchors that very many runs share are found on a sample, which decides only how rows are dealt: their runs are dealt by
their own fingerprints and compared window by window, so that no task holds all runs of one anchor.

Places are (doc_id, byte offset) in the order of ids, and batches have to come in that order. Edge cases: a null text
is empty, and a text shorter than ``length`` bytes stays; null ids come before all others; rows that repeat an id and a
text are treated alike (equal places are not earlier than each other), rows of one id with different texts are told
apart; very long texts are cut into blocks that overlap, which loses no window; runs of one repeated byte, or of a short
period, are windows like others; empty tables give no rows; extra columns are ignored, or carried if named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parallaxis.llm import storage, thinning

LENGTH, GRAM, BATCHES = 100, 32, 4
#: Bytes of a block of documents, window starts that are fingerprinted at once (few, so that they stay in a core's cache), rows
#: of a batch of documents, and runs whose suffixes one group sorts.
BLOCK, CHUNK, BATCH_ROWS, SORTED_RUNS = 1 << 21, 1 << 16, 500, 8_000
#: An anchor counts as hot from this many runs in the sample, and from this share of it; one document in SAMPLE.
HOT_RUNS, HOT_SHARE, SAMPLE = 50, 1e-4, 16
_FIRST = -(1 << 63)

_ENTRY = "core long, run long, doc long, own long, lo long, n int"
_MARK = "doc long, own long, lo long, n int"


class _Prints:
    """Polynomial fingerprints modulo 2^64 of all substrings of a block, by prefix sums."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.of_byte = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 1 << 62)) * 2 + 1
        self.power, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (base, pow(base, -1, 1 << 64)))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.power[: len(data)], out=out[1:])
        return out


_prints: dict[int, _Prints] = {}


def _print(seed: int) -> _Prints:
    if seed not in _prints:
        _prints[seed] = _Prints(seed, 4 * CHUNK)
    return _prints[seed]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _runs_within(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    nothing = np.zeros(0, np.int64)
    if len(data) < length:
        return nothing, nothing, nothing, nothing
    first, second = _print(1), _print(2)
    sums = first.prefix(data)
    grams = _mixed((sums[gram:] - sums[:-gram]) * first.inverse[: len(data) - gram + 1])
    place = np.uint64((1 << 24) - 1)
    least = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)  # ties go to the first
    width, span = 1, length - gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(data) - length + 1], least[span - width :])
    starts = np.flatnonzero(np.arange(len(least)) + length <= ends[: len(least)])
    if not len(starts):
        return nothing, nothing, nothing, nothing
    anchor = (least[starts] & place).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(starts) != 1)]))
    lo, n = starts[begins], np.diff(np.append(begins, len(starts)))
    sums = second.prefix(data)
    run = _mixed((sums[lo + n + length - 1] - sums[lo]) * second.inverse[lo] + n.astype(np.uint64))
    return lo, n, grams[anchor[begins]].view(np.int64), run.view(np.int64)


def runs_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lo, n, core, run): windows lo to lo + n - 1 share an anchor; ``ends`` has each byte's end of document."""
    parts = []
    for at in range(0, max(1, len(data)), CHUNK):
        piece = slice(at, at + CHUNK + length - 1)
        lo, *rest = _runs_within(data[piece], ends[piece] - at, length, gram)
        parts.append((lo + at, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, document of each piece, its text's hash, its offset in the text, its end in the block): whole windows."""
    pieces, size = [], 0

    def block():
        docs, owns, froms, parts = zip(*pieces)
        lengths = np.array([len(p) for p in parts])
        return np.frombuffer(b"".join(parts), np.uint8), np.array(docs, np.int64), np.array(owns, np.int64), np.array(froms, np.int64), np.cumsum(lengths)

    for batch in batches:
        docs, owns = batch.column("doc").to_numpy(), batch.column("own").to_numpy()
        for k, text in enumerate(batch.column("text")):
            whole = memoryview(text.as_buffer()) if text.is_valid else b""
            for at in range(0, max(0, len(whole) - length + 1), BLOCK):
                piece = whole[at : at + BLOCK + length - 1]
                pieces.append((docs[k], owns[k], at, piece))
                size += len(piece)
                if size >= BLOCK // 2:
                    yield block()
                    pieces, size = [], 0
    if pieces:
        yield block()


def _entries(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, docs, owns, froms, stops in _blocks(batches, length):
            begins = np.concatenate([[0], stops[:-1]])
            lo, n, core, own_run = runs_of(data, np.repeat(stops, stops - begins), length)
            piece = np.searchsorted(stops, lo, "right")
            doc, own, at = docs[piece], owns[piece], lo - begins[piece] + froms[piece]
            order = np.lexsort((at, doc, own_run, core))
            core, own_run, doc, own, at, n = (x[order] for x in (core, own_run, doc, own, at, n))
            same = np.zeros(len(core), bool)
            same[1:] = (core[1:] == core[:-1]) & (own_run[1:] == own_run[:-1])
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(core)))) if len(core) else np.zeros(0, np.int64)
            held = (doc > doc[lead]) | ((doc == doc[lead]) & (at > at[lead]))
            yield pa.RecordBatch.from_pydict({"core": core, "run": own_run, "doc": doc, "own": own, "lo": at, "n": pa.array(n.astype(np.int32)), "held": pa.array(held)})

    return run


def _fetched(length: int):
    """Bytes of runs, from documents with lists of what to fetch; a hot anchor's windows come one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("core", "sub", "doc", "own", "lo", "n", "fresh", "window")}

            def add(core, sub, doc, own, lo, n, fresh, window, out=out):
                for k, x in zip(out, (core, sub, doc, own, lo, n, fresh, window)):
                    out[k].append(x)

            for k in range(batch.num_rows):
                text, doc, own = (memoryview(batch.column("text")[k].as_buffer()), batch.column("doc")[k].as_py(), batch.column("own")[k].as_py())
                for r in batch.column("runs")[k].as_py():
                    lo, n = r["lo"], r["n"]
                    if not r["hot"]:
                        add(r["core"], 0, doc, own, lo, n, r["fresh"], bytes(text[lo : lo + n + length - 1]))
                        continue
                    for at in range(lo, lo + n):
                        window = bytes(text[at : at + length])
                        add(r["core"], hash_of(window), doc, own, at, 1, r["fresh"], window)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return run


def hash_of(window: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)


def _scanned(length: int):
    """Sorts the suffixes of a group of runs by their first bytes, and marks those of the batch that start earlier too."""

    def scan(table: pa.Table) -> pa.Table:
        get = {c: table.column(c).combine_chunks() for c in table.column_names}
        doc, own, lo, n, fresh = (get[c].to_numpy(zero_copy_only=False) for c in ("doc", "own", "lo", "n", "fresh"))
        n = n.astype(np.int64)
        data = np.frombuffer(b"".join(get["window"].to_pylist()), np.uint8)
        begins = np.concatenate([[0], np.cumsum(n + length - 1)[:-1]])
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        # by place, so that a stable sort leaves the earliest of equal suffixes in front
        by_place = np.lexsort((lo[row] + step, doc[row]))
        row, step = row[by_place], step[by_place]
        suffixes = np.lib.stride_tricks.sliding_window_view(data, length)[begins[row] + step]
        suffixes = np.ascontiguousarray(suffixes).view(f"S{length}").ravel()
        array = np.argsort(suffixes, kind="stable")
        row, step, suffixes = row[array], step[array], suffixes[array]
        at = lo[row] + step
        same = np.concatenate([[False], suffixes[1:] == suffixes[:-1]])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(row))))
        hit = np.flatnonzero(fresh[row] & ((doc[row] > doc[row[lead]]) | ((doc[row] == doc[row[lead]]) & (at > at[lead]))))
        hit = hit[np.lexsort((step[hit], row[hit]))]
        r, s = row[hit], step[hit]
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(r) != 0) | (np.diff(s) != 1)])) if len(r) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(r))) if len(r) else begin
        return pa.table({"doc": doc[r[begin]], "own": own[r[begin]], "lo": lo[r[begin]] + s[begin], "n": pa.array(count.astype(np.int32))})

    return scan


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled meanwhile is removed from the executors' disks as soon as the table that it makes is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class SuffixFamily:
    """An index of passages to which batches of documents are added in the order of their ids."""

    def __init__(self, spark: SparkSession, length: int = LENGTH):
        if length < 2 * GRAM:
            raise ValueError(f"passages must have {2 * GRAM} bytes at least")
        self.spark, self.length = spark, length
        #: (rank, entries), and the documents of all batches
        self.levels: list[tuple[int, DataFrame]] = []
        self.texts: DataFrame | None = None

    def _settle(self) -> None:
        """Merges levels of equal rank: sorted runs without common entries."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels[-2:]
            merged = storage.materialize(a.unionByName(b).repartition("core").sortWithinPartitions("core", "run"), "suffix-level")
            storage.drop(a, b)
            self.levels[-2:] = [(rank + 1, merged)]

    def _hot(self, rows: DataFrame) -> DataFrame | None:
        """Anchors of the batch that very many runs share, at most 1 / HOT_SHARE of them; None if there are none."""
        sample = rows.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
        counts = sample.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("fresh"))
        found = storage.materialize(counts.filter((F.col("n") >= HOT_RUNS) & F.col("fresh")), "hot-anchors")
        hot = found
        if not found.isEmpty():
            hot = storage.materialize(found.filter(F.col("n") >= HOT_SHARE * sample.count()).select("core", F.lit(True).alias("hot")), "hot-anchors")
            storage.drop(found)
        if hot.isEmpty():
            storage.drop(hot)
            return None
        return hot

    def add(self, docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """(doc, own, lo, n): windows of ``docs(doc, own, text)`` that also start earlier, there or in the index.

        ``texts``, if given, is one frame of all documents so far, these included; else those of all batches are kept.
        """
        self._settle()
        length, spark = self.length, self.spark
        with storage.arrow_rows(spark, BATCH_ROWS):
            found = storage.materialize(docs.select("doc", "own", "text").mapInArrow(_entries(length), _ENTRY + ", held boolean"), "suffix-entries")
        self.texts = texts if texts is not None else docs if self.texts is None else self.texts.unionByName(docs)
        rows = found.filter(~F.col("held")).drop("held").withColumn("fresh", F.lit(True))
        for _, level in self.levels:
            rows = rows.unionByName(level.withColumn("fresh", F.lit(False)))
        hot = self._hot(rows)
        rows = rows.withColumn("hot", F.lit(False)) if hot is None else rows.join(F.broadcast(hot), "core", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        # an anchor's runs meet in one task, a hot anchor's equal runs do
        rows = rows.withColumn("deal", F.when(F.col("hot"), F.col("run")).otherwise(F.lit(0)))
        group, equal = Window.partitionBy("core", "deal"), Window.partitionBy("core", "deal", "run").orderBy("doc", "lo")
        scanned = (
            rows.withColumn("number", F.row_number().over(equal)).withColumn("later", F.rank().over(equal) > 1)
            .withColumn("several", F.col("hot") | (F.min("run").over(group) < F.max("run").over(group)))
            .withColumn("met", F.col("several") & ~F.col("later") & (F.col("hot") | F.max("fresh").over(group)))
            .filter("fresh or met").drop("deal", "several")
        )
        scanned = storage.materialize(scanned, "suffix-scan")
        entries = [f.split()[0] for f in _ENTRY.split(", ")]
        self.levels.append((0, storage.materialize(scanned.filter("fresh and not later and number = 1").select(*entries), "suffix-level")))  # in the order of the scan
        whole = found.filter("held").unionByName(scanned.filter("fresh and later"), allowMissingColumns=True).select("doc", "own", "lo", "n")
        marks = storage.materialize(whole.unionByName(self._matched(scanned.filter("met"))), "suffix-marks")
        storage.drop(found, scanned, hot)
        return marks

    def _matched(self, runs: DataFrame) -> DataFrame:
        """Windows of the batch that different runs about one anchor share, the earliest left out."""
        number = runs.agg(F.sum(F.when(F.col("hot"), F.col("n")).otherwise(1))).first()[0] or 0
        asked = runs.groupBy("doc", "own").agg(F.collect_list(F.struct("core", "lo", "n", "fresh", "hot")).alias("runs"))
        texts = thinning.thinned(self.texts, ["doc", "own"], runs)  # repeated rows bring equal places, which do not mark each other
        schema = "core long, sub long, doc long, own long, lo long, n int, fresh boolean, window binary"
        fetched = texts.join(asked, ["doc", "own"]).mapInArrow(_fetched(self.length), schema)
        groups = max(1, -(-number // SORTED_RUNS))
        dealt = fetched.withColumn("group", F.pmod(F.xxhash64("core", "sub"), F.lit(groups)))
        return dealt.groupBy("group").applyInArrow(_scanned(self.length), _MARK)


def _cut(length: int, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, marks in zip(batch.column("text"), batch.column("marks")):
                whole = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                parts, at, gone, number = [], 0, 0, 0
                for m in marks.as_py() or ():
                    lo, hi = m["lo"], m["lo"] + m["n"] + length - 1
                    if lo > at or not number:
                        parts.append(whole[at:lo])
                        number += 1
                        at = lo
                    if hi > at:
                        gone += hi - at
                        at = hi
                parts.append(whole[at:])
                sizes.append(len(whole))
                removed.append(gone)
                spans.append(number)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def placed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, own, text, keep...) of ``docs(doc_id, text)``: the id that orders it, and what tells texts of one id apart."""
    kept = (F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(keep))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc"), F.xxhash64("text").alias("own"), "text", *kept)


def dedup_passages(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., n_bytes, n_removed, n_spans, kept): what is left of every document's bytes, and how much is gone."""
    own = placed(docs, keep)
    types = dict(docs.dtypes)
    cuts = [c for c in own.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 1000)).first()[0] or []] if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    family, marks = SuffixFamily(docs.sparkSession, length), []
    with _shuffles_removed(docs.sparkSession):
        texts = own.select("doc", "own", "text")
        for low, high in zip(edges, edges[1:]):
            upto = texts if high is None else texts.filter(F.col("doc") <= high)
            marks.append(family.add(upto if low is None else upto.filter(F.col("doc") > low), upto))
    found = marks[0]
    for more in marks[1:]:
        found = found.unionByName(more)
    listed = found.groupBy("doc", "own").agg(F.sort_array(F.collect_list(F.struct("lo", "n"))).alias("marks"))
    schema = "".join(f"kept_{k} {types[c]}, " for k, c in enumerate(keep)) + "n_bytes long, n_removed long, n_spans long, kept binary"
    out = own.join(listed, ["doc", "own"], "left").mapInArrow(_cut(length, tuple(f"kept_{k}" for k in range(len(keep)))), schema)
    return out.select(*(F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)), "n_bytes", "n_removed", "n_spans", "kept")
