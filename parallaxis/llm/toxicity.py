"""Toxicity by multiple-instance learning: noisy-or over sentences, trained from document labels alone.

A sentence scores ``p = sigmoid(bias + sum of its words' weights)`` and a document ``1 - prod(1 - p)``. A sentence adds
to its document only what its words add to the bias, and one without known features nothing, so that length alone makes
no document toxic; fitting takes the sentences that hold a known feature. Labels say only whether some sentence is
toxic; the likelihood of the noisy-or puts the blame on the sentences that toxic documents have and clean ones lack. A
word's features are the word and its leading 3 to 8 letters, so that inflected and compounded forms share weights.

Fitting takes a bounded sample of labelled documents (``sample`` of each class, by hash of the id): its ids, at most
``2 * sample`` rows, are broadcast, features are counted on the executors, and the driver sees the ``features`` best
of them and, for each sampled document, only the sentences that hold one: ``SENTENCES`` of them at most, evenly spaced.
Scoring is a map over the whole texts.

Edge cases: a null or empty text is one empty sentence and scores 0.0; null labels are ignored, and
if one class has no labelled rows every score is the share of the other class's complement (0.0 or 1.0, 0.0 without
labels); equal rows score equally; of rows that share an id, fitting takes the one of least text; an empty table gives
an empty result; extra columns are ignored, and kept ones that are named as a result column give way to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallaxis.llm import storage, worker

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Labelled documents of each class, and candidate features, that fitting takes at most.
SAMPLE, FEATURES = 6000, 8192
#: Sentences with known features that fitting takes of one document at most.
SENTENCES = 4000
THRESHOLD = 0.3
#: What a sentence's known features start from, at most.
MAX_BIAS = -11.0


def in_fold(doc_id: Column, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:k] for k in PREFIXES if len(word) > k)]


@dataclass
class NoisyOr:
    weights: dict[str, float]
    bias: float
    constant: float | None = None

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))


class WordWeights(dict):
    """Weights of words met so far, at most ``most``; few words begin as a feature does, the others weigh nothing."""

    def __init__(self, model: NoisyOr, most: int = 400_000):
        super().__init__()
        self.model, self.most = model, most
        self.starts = {f.removeprefix("=")[:3] for f in model.weights}

    def __missing__(self, word: str) -> float:
        value = self.model.word(word) if word[:3] in self.starts else 0.0
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, seen: Column) -> DataFrame:
    picked = labels.filter(seen & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    each = [picked.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (1, 0)]
    ids = each[0].unionByName(each[1]).withColumnRenamed("doc_id", "_id")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return storage.materialize(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"), "toxicity-sample")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.claim("toxicity")
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def out() -> Iterator[pa.RecordBatch]:
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())], names=["feature", "pos", "neg"])
        for c in counts.values():
            c.clear()

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update({f for w in set(WORD.findall((text or "").lower())) for f in features(w)})
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield from out()
    yield from out()


def _bags(index: dict[str, int]):
    """For each document, its label and the known features of the sentences that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = [[index[f] for w in set(WORD.findall(s)) for f in features(w) if f in index] for s in SENTENCE.findall((text or "").lower())]
                found = [x for x in found if x]
                rows.append(found[:: -(-len(found) // SENTENCES)] if found else found)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(rows, pa.list_(pa.list_(pa.int32())))], names=["toxic", "bags"])

    return run


def fit(docs: DataFrame, labels: DataFrame, seen: Column | None = None, sample: int = SAMPLE, max_features: int = FEATURES, steps: int = 400, ridge: float = 0.02) -> NoisyOr:
    """Learns from ``labels(doc_id, toxic)`` rows for which ``seen`` holds, and the texts of ``docs``."""
    rows = _sampled(docs, labels, sample, F.lit(True) if seen is None else seen)
    counted = rows.mapInArrow(_count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # candidates: features that toxic documents have clearly more often, by the strength of the evidence
    lean = F.log((F.col("pos") + 0.5) / (F.col("neg") + 0.5))
    best = counted.filter("pos >= 3 and pos > 2 * neg").orderBy(F.desc(lean * F.sqrt("pos")), "feature").limit(max_features)
    names = [r.feature for r in best.select("feature").collect()]
    found = rows.mapInArrow(_bags({n: k for k, n in enumerate(names)}), "toxic int, bags array<array<int>>").toArrow()
    storage.drop(rows)
    y = np.array(found["toxic"].to_pylist(), float)
    if not len(y) or y.min() == y.max():
        return NoisyOr({}, 0.0, float(y[0]) if len(y) else 0.0)
    order = np.arange(len(y))
    bags = found["bags"].to_pylist()
    doc = np.repeat(order, [len(b) for b in bags])
    sentences = [s for b in bags for s in b]
    entry = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    feature = np.array([f for s in sentences for f in s], np.int64)
    w, b = np.zeros(len(names)), MAX_BIAS
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(entry, w[feature], len(sentences))
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(doc, np.logaddexp(0, z), len(y))  # -log(1 - P)
        # d loss / d clean: 1 for clean documents, -(1 - P) / P for toxic ones
        g = np.where(y == 1, -1 / np.expm1(np.maximum(clean, 1e-9)), 1.0)
        gz = g[doc] * p
        grad = np.append(np.bincount(feature, gz[entry], len(w)) + ridge * w, gz.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], min(b - move[-1], MAX_BIAS)
    return NoisyOr({n: float(x) for n, x in zip(names, w) if abs(x) > 1e-3}, float(b))


_SPAN = T.StructType().add("start", "long").add("end", "long").add("score", "double")
_SCORED = T.StructType().add("score", "double").add("n_sentences", "long").add("offending", T.ArrayType(_SPAN))


def _score(model: NoisyOr, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.claim("toxicity")
        base, weight = float(np.logaddexp(0, model.bias)), WordWeights(model).__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                score, n, spans = [], [], []
                for text in part.column("text").to_pylist():
                    low = (text or "").lower()
                    hit = any(map(weight, set(WORD.findall(low)))) if model.weights else False
                    # lower-casing may change a text's length, so spans are counted on the text as it is
                    places = [x.span() for x in SENTENCE.finditer(text or "")] if hit else ()
                    count = len(places) if hit else len(SENTENCE.findall(low)) or 1
                    clean, own = 0.0, []
                    for a, b in places:
                        z = model.bias + sum(map(weight, set(WORD.findall(text[a:b].lower()))))
                        if z <= model.bias:
                            continue
                        clean += float(np.logaddexp(0, z)) - base
                        p = float(1 / (1 + np.exp(-z)))
                        if p >= THRESHOLD:
                            own.append({"start": a, "end": b, "score": p})
                    n.append(count)
                    spans.append(own)
                    score.append(model.constant if model.constant is not None else float(-np.expm1(-clean)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
                    names=[*columns, "score", "n_sentences", "offending"],
                )

    return run


def score(docs: DataFrame, model: NoisyOr, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, score, n_sentences and offending: the places (code points) and scores of toxic sentences."""
    columns = ["doc_id", *(c for c in keep if c.lower() not in {"doc_id", *(f.name for f in _SCORED)})]
    base = docs.select(*columns, *([] if "text" in columns else ["text"]))
    return base.mapInArrow(_score(model, columns), T.StructType([*docs.select(*columns).schema, *_SCORED]))
