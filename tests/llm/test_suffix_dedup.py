"""Repeated passages against every window of every text."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.llm import queries, storage, suffix_dedup
from parallaxis.llm.suffix_dedup import SuffixFamily, dedup_passages, runs_of


def by_definition(rows, length=100):
    """(bytes, removed, runs removed, what is left) for rows (doc_id, text), in their order."""
    place = lambda d, s: (d is not None, d or 0, s)
    first: dict[bytes, tuple] = {}
    for d, text in rows:
        b = (text or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, place(d, s)), place(d, s))
    out = []
    for d, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < place(d, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in frame.collect()), key=repr)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "naïve", "日本語"]) + str(rng.randrange(10_000)) for _ in range(n))


def test_query_by_definition(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op11_suffix_dedup(spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    assert sorted(map(tuple, got.collect()), key=repr) == by_definition(rows)


@pytest.mark.parametrize("batches", [1, 3])
def test_awkward_texts(spark, batches):
    rng = random.Random(5)
    passage, other = words(rng, 40), words(rng, 30)
    rows = [
        (None, passage[:150]), (None, None), (0, ""), (1, None), (2, "short"), (3, "x" * 99), (4, "x" * 100), (5, "x" * 1000), (6, "ab" * 400 + "x" * 120),
        (7, words(rng, 50) + passage + words(rng, 5)), (8, passage), (9, passage[1:-1] + other), (9, other + passage), (10, other), (10, other),
        (11, passage + passage), (12, words(rng, 3) + other[:100]), (13, words(rng, 3) + other[:99]), (14, "é" * 200), (15, "aé" * 200 + "\x00" * 300), (16, "\x00" * 150 + "\n" * 150),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lo", F.lit(1)).withColumn("marks", F.lit("m")).withColumn("core", F.lit(None).cast("int"))
    got = dedup_passages(frame, batches=batches, keep=("doc_id", "lo", "marks", "core"))
    assert got.columns == ["doc_id", "lo", "marks", "core", "n_bytes", "n_removed", "n_spans", "kept"]
    assert found(got) == by_definition(rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_passages(none).collect() == []


def test_text_of_several_blocks(spark):
    """Passages that cross from block to block of one text, and repeat in another."""
    rng = random.Random(6)
    far = "".join(rng.choices("abcdefghijklmnop ", k=suffix_dedup.BLOCK + 70_000))
    rows = [(1, far), (2, far[suffix_dedup.BLOCK - 300 : suffix_dedup.BLOCK + 300] + " and more"), (3, far[500:650])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), batches=2).collect()}
    assert got == {1: (len(far), 0, 0), 2: (609, 600, 1), 3: (150, 150, 1)}


def test_anchor_of_very_many_runs(spark):
    """A short string in every document, in different surroundings: dealt by windows, and nothing missed."""
    rng = random.Random(7)
    stamp = "the very same stamp of forty-eight bytes, always"
    rows = [(d, words(rng, 8) + stamp + words(rng, 8)) for d in range(3000)]
    rows += [(3000 + d, words(rng, 2) + rows[7 * d][1][20:170] + words(rng, 2)) for d in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    family = SuffixFamily(spark)
    marks = family.add(suffix_dedup.placed(frame))
    assert marks.count() > 0
    entries = family.levels[0][1].withColumn("fresh", F.lit(True))
    assert family._hot(entries) is not None
    assert found(dedup_passages(frame, batches=2)) == by_definition(rows)


def test_batches_one_after_another(spark, sf_dir):
    """Eight batches leave levels whose ranks are the binary digits of eight, and mark what one batch marks."""
    own = storage.materialize(suffix_dedup.placed(spark.read.parquet(f"{sf_dir}/documents.parquet")), "own")
    whole = SuffixFamily(spark).add(own)
    family, ranks = SuffixFamily(spark), []
    covered = lambda frame: {(r.doc, r.lo + k) for r in frame.collect() for k in range(r.n)}
    got = set()
    for low in range(0, 200, 40):
        got |= covered(family.add(own.filter((F.col("doc") >= low) & (F.col("doc") < low + 40))))
        ranks.append([r for r, _ in family.levels])
    assert got == covered(whole)
    assert ranks == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0]]
    # an entry is held once, however many levels there are
    held = family.levels[0][1].unionByName(family.levels[1][1])
    assert held.count() == held.select("core", "run").distinct().count()


def test_runs_cover_all_windows():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    ends = np.repeat([1500, 1590, 5000], [1500, 90, 3410])
    lo, n, core, run = runs_of(data, ends)
    starts = np.concatenate([np.arange(a, a + k) for a, k in zip(lo, n)])
    assert starts.tolist() == [*range(1401), *range(1590, 4901)]
    assert n.max() <= suffix_dedup.LENGTH - suffix_dedup.GRAM + 1 and len(lo) < 0.06 * len(starts)
    again = runs_of(data[1590:], np.full(3410, 3410))
    assert (again[2] == core[lo >= 1590]).all() and (again[3] == run[lo >= 1590]).all()
