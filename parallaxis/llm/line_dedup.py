"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

A line's key is its text without white space at the ends and with A-Z lower-cased, hashed to 128 bits. The store
holds three tables, all in the shared folder:

* postings ``(doc_id, hi, lo, sign)``: which document holds which key, and with sign -1 which no longer does;
* counts ``(hi, lo, d_docs)``: signed changes of the number of documents that hold a key;
* filters ``(shard, blob)``: for each shard of the key space, a cuckoo filter of the keys that two or more
  documents hold. Filters take deletions, so removing documents reverses what inserting them did.

A batch appends to postings and counts and looks up its own keys' counts alone; those that rise to two documents or
fall below enter or leave the filters. ``compact`` folds what batches appended into one table each.

To drop lines, postings meet the filter of their shard; the counts of the few that pass settle false positives, and
the smallest of their documents keeps the line. Shards are as many as keep a filter under ``FILTER_KEYS`` keys, and
the postings of a shard are dealt out by document as well, so a line that a third of all documents hold is spread over
many groups. Lines of more than a ``HOT_KEYS``-th of all postings, of which there are at most so many, meet their
postings by broadcast. Documents that lose no line are not shuffled.

Edge cases: a null or empty text is one empty line; a null doc_id counts as the smallest id; rows that repeat a
doc_id are one document; a document inserted again gains the lines that it did not hold; one deleted twice, or never
inserted, changes nothing; keys shorter than ``min_chars`` code points never drop; empty tables give empty results;
kept columns that are named as a result column give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallaxis.llm import storage, worker
from parallaxis.llm.thinning import thinned

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: Keys in one filter shard, and postings in one probing group, at most on average.
FILTER_KEYS = 500_000
PROBE_ROWS = 250_000
#: Keys that are broadcast at most, because each has more than this share of all postings.
HOT_KEYS = 100_000
#: Batches after which ``insert`` and ``delete`` compact.
BATCHES = 16
SMALLEST = -(1 << 63)

_POSTING = "doc_id long, hi long, lo long"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte key of a line, or None if it is too short to take part."""
    key = line.strip(SPACE).lower()
    n = len(key)
    if n < min_chars or (n < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; bulk insertion, membership and deletion of 128-bit keys."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int):
        self.table = np.zeros((max(1, buckets), self.SLOTS), np.uint16)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(1, int(np.ceil(np.log2(max(1, keys) / (cls.SLOTS * 0.8))))))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        own = cls(1)
        own.table = np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy()
        return own

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = len(self.table) - 1
        print_ = (hi.astype(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = (lo.astype(np.uint64) >> np.uint64(16)).astype(np.int64) & mask
        return print_, first, first ^ self._step(print_)

    def _step(self, print_: np.ndarray) -> np.ndarray:
        return (print_.astype(np.int64) * 0x5BD1E995 >> 7) & (len(self.table) - 1)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        p, a, b = self._places(hi, lo)
        return (self.table[a] == p[:, None]).any(1) | (self.table[b] == p[:, None]).any(1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if a key found no place; the filter is then to be built anew, larger, from the exact table."""
        p, a, b = self._places(hi, lo)
        rest = np.arange(len(p))
        for place in (a, b):
            for slot in range(self.SLOTS):
                free = rest[self.table[place[rest], slot] == 0]
                _, one = np.unique(place[free], return_index=True)
                put = free[one]
                self.table[place[put], slot] = p[put]
                rest = np.setdiff1d(rest, put, assume_unique=True)
        return all(self._kick(int(p[i]), int(b[i])) for i in rest)

    def _kick(self, print_: int, bucket: int) -> bool:
        for turn in range(self.KICKS):
            row = self.table[bucket]
            empty = np.flatnonzero(row == 0)
            if len(empty):
                row[empty[0]] = print_
                return True
            slot = (turn * 7 + print_) % self.SLOTS
            print_, row[slot] = int(row[slot]), print_
            bucket ^= int(self._step(np.array([print_], np.uint16))[0])
        return False

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Removes one fingerprint for each key; every key must have been inserted."""
        for p, a, b in zip(*self._places(hi, lo)):
            for place in (a, b):
                at = np.flatnonzero(self.table[place] == p)
                if len(at):
                    self.table[place, at[0]] = 0
                    break


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, hi, lo) once for each document and distinct key in its rows of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.claim("lines")
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, 1024):
                counts, keys = [], []
                for text in batch.column(1).slice(at, 1024).to_pylist():
                    own = {k for line in (text or "").encode("utf-8", "replace").split(b"\n") if (k := line_key(line, min_chars))}
                    counts.append(len(own))
                    keys += own
                pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + 1024], counts)), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["doc_id", "hi", "lo"])

    return docs.select(F.coalesce("doc_id", F.lit(SMALLEST)).alias("doc_id"), "text").mapInArrow(run, _POSTING)


def _once(posted: DataFrame, docs: DataFrame) -> DataFrame:
    """``posted``, in which documents of one row are distinct as they are, without repeats."""
    rows = docs.groupBy(F.coalesce("doc_id", F.lit(SMALLEST)).alias("_many")).agg(F.count(F.lit(1)).alias("rows"))
    many = storage.materialize(rows.filter("rows > 1").select("_many"), "repeated-ids")
    if many.isEmpty():
        return posted
    repeated = posted.join(many, F.col("doc_id") == F.col("_many"), "left_semi").distinct()
    return posted.join(many, F.col("doc_id") == F.col("_many"), "left_anti").unionByName(repeated)


def _build(table: pa.Table) -> pa.Table:
    hi, lo = table["hi"].to_numpy(), table["lo"].to_numpy()
    own = CuckooFilter.sized(len(hi))
    while not own.insert(hi, lo):
        own = CuckooFilter(2 * len(own.table))
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "blob": pa.array([own.dump()], pa.binary())})


def _probe(posted: pa.Table, filters: pa.Table) -> pa.Table:
    if not posted.num_rows or not filters.num_rows:
        return posted.select(["doc_id", "hi", "lo", "sign"]).slice(0, 0)
    found = CuckooFilter.load(filters["blob"][0].as_py()).contains(posted["hi"].to_numpy(), posted["lo"].to_numpy())
    return posted.select(["doc_id", "hi", "lo", "sign"]).filter(pa.array(found))


def _change(changes: pa.Table, filters: pa.Table) -> pa.Table:
    """One shard's filter after its keys' insertions (sign 1) and deletions (sign -1)."""
    shard = (changes if changes.num_rows else filters)["shard"][0].as_py()
    own = CuckooFilter.load(filters["blob"][0].as_py()) if filters.num_rows else CuckooFilter.sized(changes.num_rows)
    hi, lo, sign = changes["hi"].to_numpy(), changes["lo"].to_numpy(), changes["sign"].to_numpy()
    own.delete(hi[sign < 0], lo[sign < 0])
    full = not own.insert(hi[sign > 0], lo[sign > 0])
    return pa.table({"shard": pa.array([shard], pa.int64()), "blob": pa.array([None if full else own.dump()], pa.binary())})


class LineStore:
    """The incremental store. ``insert`` and ``delete`` leave it as if built from the remaining documents."""

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, filter_keys: int = FILTER_KEYS, probe_rows: int = PROBE_ROWS):
        self.spark, self.min_chars, self.filter_keys, self.probe_rows = spark, min_chars, filter_keys, probe_rows
        self.segments: list[DataFrame] = []
        self.counts: list[DataFrame] = []
        self.filters: DataFrame | None = None
        self.shards = self.shared = 0
        self.pure = True

    def _shard(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("shard", F.pmod(F.col("lo"), F.lit(self.shards)).cast("long"))

    def _live(self, part: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> DataFrame:
        """(doc_id, hi, lo) of what documents hold now, of the rows that ``part`` takes of each segment."""
        rows = reduce(DataFrame.unionByName, (part(s) for s in self.segments))
        if self.pure:
            return rows.select("doc_id", "hi", "lo")
        return rows.groupBy("doc_id", "hi", "lo").agg(F.sum("sign").alias("sign")).filter("sign > 0").drop("sign")

    def _counted(self, part: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> DataFrame:
        """(hi, lo, n_docs), exact, for the keys that ``part`` takes of each segment."""
        rows = reduce(DataFrame.unionByName, (part(c) for c in self.counts))
        if len(self.counts) == 1:
            return rows.select("hi", "lo", F.col("d_docs").alias("n_docs"))
        return rows.groupBy("hi", "lo").agg(F.sum("d_docs").alias("n_docs")).filter("n_docs > 0")

    @property
    def refs(self) -> DataFrame:
        """The exact references: (hi, lo, n_docs, first_doc, last_doc)."""
        ends = self._live().groupBy("hi", "lo").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        return self._counted().join(ends, ["hi", "lo"])

    def _rebuild(self) -> None:
        shared = self._counted().filter("n_docs >= 2")
        self.shared = shared.count()
        self.shards = max(1, -(-self.shared // self.filter_keys))
        built = self._shard(shared.select("hi", "lo")).groupBy("shard").applyInArrow(_build, "shard long, blob binary")
        self.filters = storage.materialize(built, "line-filters")

    def _append(self, batch: DataFrame, sign: int) -> None:
        """Adds a batch of postings, updates its keys' counts and lets those that cross two into or out of the filters."""
        batch = storage.materialize(batch.withColumn("sign", F.lit(sign)), "line-postings")
        delta = storage.materialize(batch.groupBy("hi", "lo").agg(F.sum("sign").alias("d_docs")), "line-counts")
        changed = None
        if self.counts:
            before = self._counted(lambda c: thinned(c, ["hi", "lo"], delta))
            both = delta.join(before, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("n_docs", F.lit(0)).alias("old"), (F.coalesce("n_docs", F.lit(0)) + F.col("d_docs")).alias("new"))
            crossed = both.filter("(old >= 2) <> (new >= 2)").select("hi", "lo", F.when(F.col("new") >= 2, 1).otherwise(-1).alias("sign"))
            changed = storage.materialize(self._shard(crossed), "line-changes")
        self.segments.append(batch)
        self.counts.append(delta)
        self.pure = self.pure and sign > 0
        if changed is None:
            return self._rebuild()
        self.shared += changed.agg(F.sum("sign")).first()[0] or 0
        filters = storage.materialize(changed.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_change, "shard long, blob binary"), "line-filters")
        storage.drop(changed, self.filters)
        self.filters = filters
        if self.shared > 2 * self.shards * self.filter_keys or not filters.filter("blob is null").isEmpty():
            storage.drop(filters)
            self._rebuild()
        if len(self.counts) > BATCHES:
            self.compact()

    def compact(self) -> LineStore:
        """Folds the batches into one table of postings and one of counts."""
        old = [*self.segments, *self.counts]
        self.segments, self.counts = [storage.materialize(self._live().withColumn("sign", F.lit(1)), "line-postings")], [storage.materialize(self._counted().withColumnRenamed("n_docs", "d_docs"), "line-counts")]
        self.pure = True
        storage.drop(*old)
        return self

    def insert(self, docs: DataFrame) -> LineStore:
        """Adds ``docs(doc_id, text)``."""
        posted = _once(postings(docs, self.min_chars), docs)
        if self.segments:
            posted = storage.materialize(posted, "line-postings")
            held = self._live(lambda s: thinned(s, ["doc_id"], posted))
            posted = posted.join(held, ["doc_id", "hi", "lo"], "left_anti")
        self._append(posted, 1)
        return self

    def delete(self, ids: DataFrame) -> LineStore:
        """Removes the documents named in ``ids(doc_id)``."""
        gone = ids.select(F.coalesce("doc_id", F.lit(SMALLEST)).alias("doc_id")).distinct()
        if self.segments:
            self._append(self._live(lambda s: thinned(s, ["doc_id"], gone)).join(gone, "doc_id", "left_semi"), -1)
        return self

    def drops(self) -> DataFrame:
        """(doc_id, hi, lo): keys that lose their lines in that document, because a smaller doc_id holds them."""
        total = sum(s.count() for s in self.segments)
        salts = max(1, -(-total // (self.shards * self.probe_rows)))
        filters = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

        def probed(segment: DataFrame) -> DataFrame:
            salted = self._shard(segment).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
            return salted.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInArrow(_probe, _POSTING + ", sign int")

        passed = storage.materialize(self._live(probed), "line-passed")
        firsts = passed.groupBy("hi", "lo").agg(F.min("doc_id").alias("first_doc"))
        shared = storage.materialize(firsts.join(self._counted().filter("n_docs >= 2"), ["hi", "lo"]), "line-shared")
        often = F.col("n_docs") > total // HOT_KEYS
        hot = F.broadcast(shared.filter(often).select("hi", "lo", "first_doc"))
        rare = shared.filter(~often).select("hi", "lo", "first_doc")
        met = passed.join(hot, ["hi", "lo"]).unionByName(passed.join(hot, ["hi", "lo"], "left_anti").join(rare, ["hi", "lo"]))
        return met.filter("doc_id > first_doc").select("doc_id", "hi", "lo")

    def apply(self, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """``docs`` without the dropped lines: doc_id, ``keep``, text, n_lines, n_dropped."""
        min_chars = self.min_chars
        keep = tuple(c for c in keep if c.lower() not in {"doc_id", *(f.name for f in _LEFT)})
        columns = ["doc_id", *keep]
        own, listed = storage.fresh(columns, "own_id"), storage.fresh(columns, "drops")
        schema = T.StructType([*docs.select(*columns).schema, *_LEFT])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker.claim("lines")
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    kept, n_lines, n_dropped = [], [], []
                    for text, gone in zip(part.column("text").to_pylist(), part.column(listed).to_pylist()):
                        lines = (text or "").encode("utf-8", "replace").split(b"\n")
                        n_lines.append(len(lines))
                        if gone:
                            out = {np.array([d["hi"], d["lo"]], "<i8").tobytes() for d in gone}
                            lines = [x for x in lines if line_key(x, min_chars) not in out]
                        n_dropped.append(n_lines[-1] - len(lines))
                        kept.append(b"\n".join(lines).decode())
                    arrays = [part.column(c) for c in columns] + [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

        base = docs.select(*columns, "text").withColumn(own, F.coalesce("doc_id", F.lit(SMALLEST)))
        drops = storage.materialize(self.drops().groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct("hi", "lo")).alias(listed)), "line-drops")
        some = thinned(base, [own], drops).join(drops, own, "left").drop(own)
        none = thinned(base, [own], drops, how="left_anti").drop(own).withColumn(listed, F.lit(None).cast(drops.schema[listed].dataType))
        return some.mapInArrow(run, schema).unionByName(none.mapInArrow(run, schema))


_LEFT = T.StructType().add("text", "string").add("n_lines", "long").add("n_dropped", "long")


def dedup_lines(docs: DataFrame, keep: tuple[str, ...] = (), min_chars: int = MIN_CHARS) -> DataFrame:
    """One pass over a corpus: insert everything, then drop every repeated line but the smallest doc_id's."""
    return LineStore(docs.sparkSession, min_chars).insert(docs).apply(docs, keep)
