"""Whitening against integers of any size and a plain eigendecomposition."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parallaxis.llm import queries, whitening


def by_definition(rows):
    """(ids, n, exact deviations, covariance) of usable rows."""
    ok = [(i, [float(c) for c in v]) for i, v in rows if v and None not in v and all(map(math.isfinite, v))]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in ok], object)
    n, s = len(x), x.sum(0)
    off = n * x - s
    cov = (off.T @ off) / n**3
    return [i for i, _ in ok], n, [int(d) for d in (off * off).sum(1)], cov.astype(float), off.astype(float) / n


def test_query_by_definition(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids, n, deviations, cov, off = by_definition(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = queries.op12_embedding_whitening(spark, sf_dir)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = {(r.vec_id, r.component): r for r in got.collect()}
    assert got.keys() == {(i, c) for i in ids for c in range(1, 9)}
    assert {(r.vec_id, r.n, r.deviation) for r in got.values()} == {(i, n, d) for i, d in zip(ids, deviations)}
    assert max(r.identity_error for r in got.values()) < 1e-9
    for c in range(8):
        own = np.array([got[i, c + 1].whitened for i in ids])
        want = off @ vectors[:, c] / math.sqrt(values[c])
        sign = np.sign((own * want).sum())
        assert np.allclose(own, sign * want, rtol=1e-6, atol=1e-6)
        assert all(abs(got[i, c + 1].explained / (values[c] / np.trace(cov)) - 1) < 1e-9 for i in ids)


def test_exact_over_many_partitions(spark):
    """More partitions than one group adds up, empty ones among them, and components of very different size."""
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=3) * [1e-3, 1.0, 1e12]]) for k in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(whitening.FAN_IN + 40)
    model = whitening.fit(frame)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], object)
    s = x.sum(0)
    assert model.n == 900 and model.sums == s.tolist()
    assert (model.centred == 900 * (x.T @ x) - np.outer(s, s)).all()


def test_awkward_vectors(spark):
    rows = [
        (1, [0.5, -0.25]), (2, [0.5, 0.75]), (2, [0.5, 0.75]), (None, [-1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [-0.0, 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("w", F.lit("w")).withColumn("deviation", F.lit(0)).withColumn("part", F.lit(1))
    usable = [r for r in rows if r[0] in (1, 2, None, 9)]
    ids, n, deviations, _, _ = by_definition(usable)
    got = whitening.whiten(frame, whitening.fit(frame)).collect()
    assert sorted(((r.vec_id, int(r.deviation)) for r in got if r.component == 1), key=repr) == sorted(zip(ids, deviations), key=repr)
    assert {r.component for r in got} == {1, 2} and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9


def test_no_variance_and_no_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")
    got = whitening.whiten(frame, whitening.fit(frame)).collect()
    assert len(got) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], "vec_id long, embedding array<float>")
    got = whitening.whiten(line, whitening.fit(line)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and max(r.identity_error for r in got) < 1e-9
    none = frame.limit(0)
    assert whitening.fit(none) is None and whitening.whiten(none, None).collect() == []


def test_components_beyond_a_long(spark):
    """Held at the ends of a long; moments stay exact, and deviations of too many digits are null."""
    frame = spark.createDataFrame([(1, [1e300, 2.0]), (2, [1.0, 2.0]), (3, [-1e30, 5.0])], "vec_id long, embedding array<double>")
    model = whitening.fit(frame)
    top = (1 << 63) - 1
    x = np.array([[top, 102_048], [101_024, 102_048], [-top, 105_120]], object)
    assert model.sums == x.sum(0).tolist() and (model.centred == 3 * (x.T @ x) - np.outer(x.sum(0), x.sum(0))).all()
    assert all(r.deviation is None or r.deviation >= 0 for r in whitening.whiten(frame, model).collect())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 62), 1 << 62), min_size=2, max_size=2), min_size=1, max_size=40))
def test_residues_give_back_the_product(rows):
    x = np.array(rows, np.int64)
    moduli = whitening.primes(2 * len(rows) * (1 << 124))
    assert (whitening.from_residues({p: whitening.scatter(x, p) for p in moduli}) == x.astype(object).T @ x.astype(object)).all()


def test_primes_run_out():
    with pytest.raises(ValueError):
        whitening.primes(10**9, limit=10)
