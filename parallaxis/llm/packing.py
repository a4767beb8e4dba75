"""Mixture-controlled sequence packing by deficit round-robin.

Every source is a queue of documents. A window (one training sequence) is filled by deficit round-robin over the
queues: each earns ``window * share`` tokens, spends them when they make a piece of ``PIECE`` tokens at least, and
carries what it could not spend, or was given beyond its share, to later windows. When a queue runs out the others
share what it had.

Queues span the corpus, so windows mix sources however the input is clustered. A first pass tokenizes it into blocks
of bounded size in the shared folder and counts tokens by partition and source: then every block knows the place of
its documents in their queues. A window is dealt out by a rule that any task can evaluate: rounds of ``ROUND`` windows
begin at places in closed form (``Plan.before``, in which no queue is more than a token from its share), and within a
round the deficits are carried from window to window (``deal``). So the second pass is a map that names each piece's
sequence and offset; no document is shuffled, and a lost task repeats its blocks.

The corpus' last ``total % window`` tokens are cut into sequences whose lengths are powers of two, so nothing at all
is padded when ``window`` is one.

The driver holds the totals of at most ``QUEUES`` sources; smaller ones form one more queue, as do those that given
``shares`` do not name, which come last.

Edge cases: a null or empty text is the end id alone; null sources form one queue; equal rows are packed once each;
an empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parallaxis.llm import storage, tokens, worker

WINDOW = 4096
#: Tokens after which a block is closed; a longer document makes a longer block.
BLOCK_TOKENS = 500_000
#: Documents that a worker is given at once: beside its cached chunks there is little room for texts.
BATCH_ROWS = 512
#: Windows of a round, sources with a queue of their own, and tokens below which a queue waits for a later window.
ROUND, QUEUES, PIECE = 256, 1000, 64
#: Numbers of dealt rounds that a task keeps at hand, and rounds that it deals at once.
KEPT, AHEAD = 2_000_000, 16
#: Rows of per-partition places that are still broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

_BLOCKS = "part long, block long, doc_ids array<long>, sources array<string>, lengths array<long>, ids binary, seen_sources array<string>, seen_tokens array<long>"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _blocks(path: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        part, k = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        seen: dict[str | None, int] = {}
        docs: list[tuple[int | None, str | None, bytes]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal docs, size, k
            names = list(seen)
            row = {
                "part": [part], "block": [k], "doc_ids": [[d for d, _, _ in docs]], "sources": [[s for _, s, _ in docs]],
                "lengths": [[len(b) // 4 for _, _, b in docs]], "ids": [_narrow(b"".join(b for _, _, b in docs))],
                "seen_sources": [names], "seen_tokens": [[seen[s] for s in names]],
            }
            for _, s, b in docs:
                seen[s] = seen.get(s, 0) + len(b) // 4
            docs, size, k = [], 0, k + 1
            return pa.RecordBatch.from_pydict(row, schema=_SCHEMA)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pydict()
                for d, s, ids in zip(rows["doc_id"], rows["source"], encode(rows["text"])):
                    docs.append((d, s, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= block_tokens:
                        yield close()
        if docs:
            yield close()

    return run


_SCHEMA = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()), ("seen_sources", pa.list_(pa.string())), ("seen_tokens", pa.list_(pa.int64()))])


def _narrow(ids: bytes) -> bytes:
    """A width byte, then the ids in two bytes each where all of them fit, else four."""
    a = np.frombuffer(ids, "<u4")
    return b"\x02" + a.astype("<u2").tobytes() if not len(a) or a.max() < 1 << 16 else b"\x04" + ids


def _widen(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if stored[:1] == b"\x02" else "<u4", offset=1).astype("<u4")


def capacities(total: int, window: int) -> list[int]:
    """Sequence lengths for so many tokens: full windows, then powers of two for what is left."""
    rest = total % window
    return [window] * (total // window) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


@dataclass
class Plan:
    """What the packed corpus holds of each queue before any place in it.

    ``at`` and ``held`` are the knots of piecewise linear functions: ideally the first ``at[k]`` tokens hold
    ``held[k, q]`` of queue q. A token is due where its queue's function reaches its middle.
    """

    totals: np.ndarray
    window: int
    at: np.ndarray
    held: np.ndarray
    rounds: dict[int, np.ndarray] = field(default_factory=dict)
    dealt: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, totals: np.ndarray, weights: np.ndarray, window: int) -> Plan:
        totals = np.asarray(totals, np.int64)
        held = [np.zeros(len(totals))]
        while (open_ := held[-1] < totals).any():
            rate = np.where(open_, weights, 0.0)
            if not rate.any():
                rate = np.where(open_, totals - held[-1], 0.0)
            rate = rate / rate.sum()
            lasts = np.where(rate > 0, (totals - held[-1]) / np.where(rate > 0, rate, 1.0), np.inf)
            now = np.minimum(totals, held[-1] + rate * lasts.min())
            now[lasts <= lasts.min() * (1 + 1e-9)] = totals[lasts <= lasts.min() * (1 + 1e-9)]
            held.append(now)
        held = np.array(held)
        return cls(totals, window, held.sum(1), held)

    @property
    def total(self) -> int:
        return int(self.totals.sum())

    def ideal(self, places: np.ndarray) -> np.ndarray:
        """Tokens of each queue that its share earns it among the first ``places``."""
        k = np.clip(np.searchsorted(self.at, places, "right") - 1, 0, len(self.at) - 2)
        slope = (self.held[k + 1] - self.held[k]) / np.maximum(self.at[k + 1] - self.at[k], 1e-300)[:, None]
        return np.minimum(self.totals, self.held[k] + slope * (places - self.at[k])[:, None])

    def due(self, queue: int, token: int) -> float:
        return float(np.interp(token + 0.5, self.held[:, queue], self.at))

    def _before(self, place: int) -> np.ndarray:
        """Tokens of each queue among the first ``place``: those due first, ties to the first queue."""
        if place >= self.total:
            return self.totals
        own = np.clip(np.floor(self.ideal(np.array([place]))[0] + 0.5).astype(np.int64), 0, self.totals)
        # rounding may be a token off what is due, and only that is one order for all places
        for q in range(len(own)):
            while own[q] and self.due(q, own[q] - 1) >= place:
                own[q] -= 1
            while own[q] < self.totals[q] and self.due(q, own[q]) < place:
                own[q] += 1
        short = place - int(own.sum())
        if short > 0:
            heap = [(self.due(q, n), q) for q, n in enumerate(own) if n < self.totals[q]]
            heapq.heapify(heap)
            for _ in range(short):
                _, q = heap[0]
                own[q] += 1
                heapq.heapreplace(heap, (self.due(q, own[q]), q)) if own[q] < self.totals[q] else heapq.heappop(heap)
        elif short < 0:
            heap = [(-self.due(q, n - 1), -q) for q, n in enumerate(own) if n > 0]
            heapq.heapify(heap)
            for _ in range(-short):
                q = -heap[0][1]
                own[q] -= 1
                heapq.heapreplace(heap, (-self.due(q, own[q] - 1), -q)) if own[q] > 0 else heapq.heappop(heap)
        return own

    def before(self, k: int) -> np.ndarray:
        """Tokens of each queue before round k."""
        if k not in self.rounds:
            if len(self.rounds) > 10_000:
                self.rounds.clear()
            self.rounds[k] = self._before(k * ROUND * self.window)
        return self.rounds[k]

    def round_of(self, queue: int, token: int) -> int:
        k = min(int(self.due(queue, token) // (ROUND * self.window)), (self.total - 1) // (ROUND * self.window))
        while self.before(k)[queue] > token:
            k -= 1
        while self.before(k + 1)[queue] <= token:
            k += 1
        return k

    def _dealt(self, ks: list[int]) -> None:
        """Deals out the rounds among ``ks`` that are not at hand, whole ones side by side."""
        size = ROUND * self.window
        ks = [k for k in ks if k not in self.dealt]
        whole = [k for k in ks if (k + 1) * size <= self.total]
        if whole:
            start, stop = (np.array([self.before(k + d) for k in whole]) for d in (0, 1))
            self.dealt.update(zip(whole, deal(stop - start, [self.window] * ROUND, self, np.array(whole) * size)))
        for k in set(ks) - set(whole):  # the last one
            rest = (self.before(k + 1) - self.before(k))[None]
            self.dealt[k] = deal(rest, capacities(self.total - k * size, self.window), self, np.array([k * size]))[0]

    def windows(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all windows of rounds ``first`` to ``last``: what each queue gave before it, and gives to it."""
        ks = list(range(first, last + 1))
        if any(k not in self.dealt for k in ks):
            # dealt side by side, rounds that the next documents need cost little more; all queues' places fit in KEPT
            n = len(self.totals)
            ahead = min(AHEAD, KEPT // (ROUND * n * n), (self.total - 1) // (ROUND * self.window) + 1 - first)
            more = [*ks, *range(last + 1, first + ahead)]
            if len(self.dealt) + len(more) > max(KEPT // (ROUND * n), len(more)):
                self.dealt.clear()
            self._dealt(more)
        gives = np.concatenate([self.dealt[k] for k in ks])
        return self.before(first) + np.cumsum(gives, 0) - gives, gives


def _by_turn(amounts: np.ndarray, rank: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """What of ``amounts`` each queue gets if they are served by descending ``rank`` up to ``limit`` in all."""
    order = np.argsort(-rank, axis=1, kind="stable")
    wanted = np.take_along_axis(amounts, order, 1)
    got = np.clip(limit[:, None] - (np.cumsum(wanted, 1) - wanted), 0, wanted)
    out = np.empty_like(amounts)
    np.put_along_axis(out, order, got, 1)
    return out


def deal(tokens_of: np.ndarray, capacity: list[int], plan: Plan | None = None, places: np.ndarray | None = None) -> np.ndarray:
    """Deficit round-robin over rounds side by side: (round, window, queue) from (round, queue) tokens.

    Every window is filled to its capacity, every queue gives all of its tokens. Queues earn what ``plan`` says for
    rounds that begin at ``places``, by default the same in all windows.
    """
    left, deficit = tokens_of.copy(), np.zeros(tokens_of.shape)
    out = np.empty((len(left), len(capacity), left.shape[1]), np.int64)
    quantum, upto = tokens_of / max(1, sum(capacity)), np.cumsum([0, *capacity])
    due = None if plan is None else plan.ideal(places)
    for w, room in enumerate(capacity):
        if plan is None:
            deficit += quantum * room
        else:
            now = plan.ideal(places + upto[w + 1])
            deficit += now - due
            due = now
        full = np.full(len(left), room)
        earned = np.clip(np.floor(deficit + 1e-9), 0, left).astype(np.int64)
        earned[deficit < np.minimum(PIECE, left)] = 0
        give = _by_turn(earned, deficit, full)
        # what rounding, empty and waiting queues leave open goes to the longest queues
        give += _by_turn(left - give, (left - give).astype(float), full - give.sum(1))
        left -= give
        deficit -= give
        out[:, w] = give
    return out


def _pieces(plan: Plan, queue: int, place: int, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cuts documents that follow each other in a queue from ``place`` on: (document, start, length, sequence, offset)."""
    starts = place + np.cumsum(lengths) - lengths
    stop, found = place + int(lengths.sum()), []
    first, last = plan.round_of(queue, place), plan.round_of(queue, stop - 1)
    step = max(1, min(64, KEPT // (ROUND * len(plan.totals))))
    for k in range(first, last + 1, step):
        until = min(k + step - 1, last)
        before, gives = plan.windows(k, until)
        edges = before[:, queue]
        low, high = max(place, int(plan.before(k)[queue])), min(stop, int(plan.before(until + 1)[queue]))
        if high <= low:
            continue
        inside = edges[(edges > low) & (edges < high)]
        cuts = np.unique(np.concatenate([[low], starts[(starts > low) & (starts < high)], inside, [high]]))
        at = cuts[:-1]
        doc = np.searchsorted(starts, at, "right") - 1
        window = np.searchsorted(edges, at, "right") - 1
        offset = (np.cumsum(gives, 1) - gives)[window, queue] + at - edges[window]
        found.append((doc, at - starts[doc], np.diff(cuts), window + k * ROUND, offset))
    return tuple(np.concatenate(x) for x in zip(*found))


def _pack(plan: Plan, names: dict[str | None, int], with_ids: bool):
    rest = len(plan.totals) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.claim("packing")  # cached chunks are of no more use
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                place = dict(row["places"])
                for s, n in zip(row["seen_sources"], row["seen_tokens"]):
                    q = names.get(s, rest)
                    place[q] = place.get(q, 0) + n
                ids, lengths = _widen(row["ids"]).tobytes(), np.array(row["lengths"], np.int64)
                first = np.cumsum(lengths) - lengths
                queue = np.array([names.get(s, rest) for s in row["sources"]])
                docs, sources = row["doc_ids"], row["sources"]
                for q in np.unique(queue):
                    own = np.flatnonzero(queue == q)
                    doc, start, length, sequence, offset = _pieces(plan, int(q), place.get(int(q), 0), lengths[own])
                    doc = own[doc]
                    begins = (first[doc] + start) * 4
                    raw = [ids[b:e] for b, e in zip(begins.tolist(), (begins + length * 4).tolist())]
                    cols = {
                        "doc_id": pa.array([docs[x] for x in doc], pa.int64()), "start": pa.array(start), "length": pa.array(length),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()), "doc_tokens": pa.array(lengths[doc]),
                        "sequence_id": pa.array(sequence), "offset": pa.array(offset), "source": pa.array([sources[x] for x in doc], pa.string()),
                    }
                    if with_ids:
                        cols["ids"] = pa.array(raw, pa.binary())
                    yield pa.RecordBatch.from_pydict(cols)

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = 2, shares: dict[str | None, float] | None = None, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False) -> DataFrame:
    """Packs ``docs(doc_id, text, source)`` into sequences of at most ``window`` tokens.

    ``shares`` gives the target proportion of tokens for each source; by default it is each source's proportion in
    the corpus, so all queues last as long as the corpus. One row for each piece; ``with_ids`` adds its ids as
    packed little-endian uint32.
    """
    spark = docs.sparkSession
    schema = _PIECES + (", ids binary" if with_ids else "")
    path = vocabulary or tokens.default_vocabulary()
    with storage.arrow_rows(spark, BATCH_ROWS):
        blocks = storage.materialize(docs.select("doc_id", "source", "text").mapInArrow(_blocks(path, end_id, block_tokens), _BLOCKS), "blocks")
    counted = (
        blocks.select("part", F.explode(F.arrays_zip("sources", "lengths")).alias("d"))
        .groupBy("part", F.col("d.sources").alias("source")).agg(F.sum("d.lengths").alias("n"))
    )
    counted = storage.materialize(counted, "mixture")
    if shares is None:
        largest = counted.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(QUEUES).select("source").collect()
        named = sorted((r.source for r in largest), key=lambda s: (s is None, s or ""))
    else:
        named = sorted(shares, key=lambda s: (s is None, s or ""))
    names = {s: q for q, s in enumerate(named)}
    table = F.broadcast(spark.createDataFrame([(s, q) for s, q in names.items()], "own string, queue int"))
    queued = counted.join(table, F.col("source").eqNullSafe(F.col("own")), "left").groupBy("part", F.coalesce("queue", F.lit(len(names))).alias("queue")).agg(F.sum("n").alias("n"))
    queued = storage.materialize(queued, "queues")
    totals = np.zeros(len(names) + 1, np.int64)
    for r in queued.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # one row for each queue
        totals[r.queue] = r.n
    if not totals.any():
        return spark.createDataFrame([], schema)
    weights = totals.astype(float) if shares is None else np.array([*(max(0.0, shares[s]) for s in named), 0.0])
    plan = Plan.of(totals, weights, window)
    by_queue = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = queued.withColumn("place", F.coalesce(F.sum("n").over(by_queue), F.lit(0))).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("queue", "place"))).alias("places"))
    if queued.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    storage.drop(counted)
    return blocks.join(places, "part").mapInArrow(_pack(plan, names, with_ids), schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): whole sequences from pieces with ids; a group is one window at most."""
    listed = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("listed", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), listed.alias("listed")).select("sequence_id", "n_tokens", joined.alias("ids"))
