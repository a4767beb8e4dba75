"""Exact embedding whitening: a scatter of residues.

Components are held as integers (``grid`` steps a unit, moved by ``shift``). Every partition multiplies its rows with
themselves modulo several primes below 2^20, in doubles that stay exact, with a column of ones beside the components:
that one product holds the scatter, the sums and the count. Residues are added up over all partitions, in two steps so
that no group grows with their number, and the Chinese remainder theorem gives back the integers. Their number of digits,
and so the number of primes, follows from the row count and the largest component. The centred scatter n*G - S*S' is
then exact whatever the mean, and only its eigenvectors are rounded.

Edge cases: a vector that is null, or holds a null or a component that is not finite, is dropped. Vectors are fitted
and whitened by the most common length of those that stay (ties: the shorter); others, empty ones included, have no
rows. A component whose integer leaves the range of a long is held at its end. Repeated rows count as often as they
occur; null ids are carried. A direction in which nothing varies has no unit scale: its ``whitened`` is null, and
``identity_error`` leaves it out; with no variance at all ``explained`` is null too. A deviation beyond 38 digits is
null. An empty table gives no rows. Extra columns are ignored, or carried if named in ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.llm import storage

GRID, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Primes lie below it, so that this many products of residues add up exactly in a double.
PRIME_LIMIT, EXACT_ROWS = 1 << 20, 1 << 12
#: Partial products that one group adds up.
FAN_IN = 256
_LONG = (1 << 63) - 1


def primes(product: int, limit: int = PRIME_LIMIT) -> list[int]:
    """The largest primes below ``limit`` whose product exceeds ``product``."""
    sieve = np.ones(limit, bool)
    sieve[:2] = False
    for k in range(2, math.isqrt(limit) + 1):
        if sieve[k]:
            sieve[k * k :: k] = False
    found, reached = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if reached > product:
            return found
        found.append(p)
        reached *= p
    if reached <= product:
        raise ValueError("the primes below the limit do not reach this far")
    return found


def from_residues(residues: dict[int, np.ndarray]) -> np.ndarray:
    """Integers, as Python's own, from their residues by prime: those nearest to zero."""
    whole = math.prod(residues)
    total = sum(r.astype(object) * (whole // p * pow(whole // p, -1, p)) for p, r in residues.items()) % whole
    return np.where(total > whole // 2, total - whole, total)


def _integers(column: pa.Array, d: int, grid: int, shift: int) -> np.ndarray:
    """(rows, d) longs of a column of lists that all have d entries."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    low, high = float(-(1 << 63)), float(1 << 63)
    scaled = np.floor(flat * grid)
    inside = (scaled >= low) & (scaled < high)
    x = np.where(inside, scaled, 0).astype(np.int64)
    x = np.where(inside, np.where(x > _LONG - shift, _LONG, x + shift), np.where(scaled < 0, -_LONG, _LONG))
    return x.reshape(-1, d)


def scatter(rows: np.ndarray, prime: int) -> np.ndarray:
    """rows' * rows modulo a prime, exact: products of residues are added in doubles, few enough at once."""
    out = np.zeros((rows.shape[1], rows.shape[1]), np.int64)
    for at in range(0, len(rows), EXACT_ROWS):
        r = np.mod(rows[at : at + EXACT_ROWS], prime).astype(np.float64)
        out = (out + np.mod(r.T @ r, prime).astype(np.int64)) % prime
    return out


_PARTIAL = "part long, prime int, line int, residues binary"


def _partials(d: int, moduli: list[int], grid: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {p: np.zeros((d + 1, d + 1), np.int64) for p in moduli}
        part, any_rows = 0, False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part, any_rows = batch.column("part")[0].as_py(), True
            x = _integers(batch.column("vector"), d, grid, shift)
            x = np.concatenate([x, np.ones((len(x), 1), np.int64)], 1)
            for p in moduli:
                total[p] = (total[p] + scatter(x, p)) % p
        if any_rows:
            for p, sums in total.items():
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(d + 1, part, np.int64)), "prime": pa.array(np.full(d + 1, p, np.int32)), "line": pa.array(np.arange(d + 1, dtype=np.int32)),
                    "residues": pa.array([line.astype("<i4").tobytes() for line in sums], pa.binary()),
                })

    return run


def _added(table: pa.Table) -> pa.Table:
    """One row for a group of partial products of one prime and line, at most FAN_IN of them."""
    prime = table.column("prime")[0].as_py()
    total = sum(np.frombuffer(b, "<i4").astype(np.int64) for b in table.column("residues").to_pylist()) % prime
    return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int64()), "prime": table.column("prime")[:1], "line": table.column("line")[:1], "residues": pa.array([total.astype("<i4").tobytes()], pa.binary())})


def _vectors(frame: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is usable, with its largest component by size."""
    usable = F.col(column).isNotNull() & F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return frame.filter(usable)


@dataclass(frozen=True)
class Whitening:
    """Exact moments of a table of vectors, and what follows from them."""

    n: int
    sums: list[int]
    #: n^2 times the covariance: integers
    centred: np.ndarray
    #: eigenvalues of the covariance, falling, their unit eigenvectors as columns, and the covariance's trace
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    largest: int
    grid: int = GRID
    shift: int = SHIFT

    @property
    def d(self) -> int:
        return len(self.sums)

    def varies(self) -> np.ndarray:
        """Which components have a variance above what rounding makes."""
        return self.values > self.d * np.finfo(float).eps * max(float(self.values.max(initial=0.0)), 0.0)


def fit(frame: DataFrame, column: str = "embedding", grid: int = GRID, shift: int = SHIFT) -> Whitening | None:
    """Exact moments of all usable vectors of the most common length; None if there are none."""
    usable = _vectors(frame, column).select(F.col(column).alias("vector")).filter(F.size("vector") > 0)
    widest = F.array_max(F.transform("vector", lambda c: F.abs(c.cast("double"))))
    sizes = usable.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(widest).alias("top"))
    found = sizes.orderBy(F.desc("n"), "d").first()
    if found is None:
        return None
    d, largest = found.d, min(int(min(found.top * grid, float(_LONG))) + 1 + shift, _LONG)
    moduli = primes(2 * found.n * largest * largest)
    rows = usable.filter(F.size("vector") == d).select(F.spark_partition_id().cast("long").alias("part"), "vector")
    sums = rows.mapInArrow(_partials(d, moduli, grid, shift), _PARTIAL)
    count = rows.rdd.getNumPartitions()
    while count > 1:  # FAN_IN partial products at a time
        sums = sums.groupBy("prime", "line", F.floor(F.col("part") / FAN_IN)).applyInArrow(_added, _PARTIAL)
        count = -(-count // FAN_IN)
    # d + 1 lines of d + 1 residues for each prime: their number does not grow with the rows
    lines = sums.select("prime", "line", "residues").collect()
    residues = {p: np.zeros((d + 1, d + 1), np.int64) for p in moduli}
    for r in lines:
        residues[r.prime][r.line] = np.frombuffer(r.residues, "<i4")
    moments = from_residues(residues)
    n, total = int(moments[d, d]), moments[d, :d]
    centred = n * moments[:d, :d] - np.outer(total, total)
    covariance = np.array([[int(c) / (n * n) for c in line] for line in centred])  # each quotient is rounded once
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    trace = sum(int(centred[k, k]) for k in range(d)) / (n * n)
    return Whitening(n, [int(s) for s in total], centred, values[order], vectors[:, order], trace, largest, grid, shift)


def _projected(model: Whitening, keep: tuple[str, ...], components: int):
    ok = model.varies()[:components]
    axes = model.vectors[:, :components] / np.sqrt(np.where(ok, model.values[:components], 1.0))
    sums, n, d = model.sums, model.n, model.d
    #: whether n*x - S, and the sum of its squares, fit in a long
    reach = n * model.largest + max(map(abs, sums), default=0)
    fits, square_fits = reach < _LONG, d * reach * reach < _LONG

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column("vector"), d, model.grid, model.shift)
            off = n * x - np.array(sums, np.int64) if fits else n * x.astype(object) - np.array(sums, object)
            wide = off if square_fits else off.astype(object)
            squares = [int(s) for s in (wide * wide).sum(1)] if len(x) else []
            w = (off.astype(float) / n) @ axes
            lists = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), max(1, w.shape[1])).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([str(s) for s in squares], pa.string()), lists], names=[*keep, "deviation", "w"])

    return run


def whiten(frame: DataFrame, model: Whitening | None, column: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """(keep..., component, n, deviation, whitened, explained, identity_error) for every usable row and component.

    ``deviation`` is the exact sum of (n*x - S)^2 as a decimal. ``identity_error`` is measured on the whitened rows of
    ``frame``: it is small only if they are spread as the fitted ones.
    """
    kept = frame.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{column}`").alias("vector"))
    types = {f.name: f.dataType for f in kept.schema.fields}
    own = "".join(f"`{c}` {types[c].simpleString()}, " for c in keep)
    if model is None:
        return frame.sparkSession.createDataFrame([], own + "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    size = min(components, model.d)
    ok = model.varies()[:size]
    usable = _vectors(kept, "vector").filter(F.size("vector") == model.d)
    rows = usable.mapInArrow(_projected(model, keep, size), own + "deviation string, w array<double>")
    rows = storage.materialize(rows, "whitened")
    # centred before it is multiplied: the means come first
    n, *means = rows.agg(F.count(F.lit(1)), *(F.avg(F.get("w", F.lit(k))) for k in range(size))).first()
    error = None
    pairs = [(i, j) for i in range(size) for j in range(i, size) if ok[i] and ok[j]]
    if n and pairs:
        off = [F.get("w", F.lit(k)) - F.lit(means[k]) for k in range(size)]
        found = rows.agg(*(F.avg(off[i] * off[j]) for i, j in pairs)).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs))
    shares = [float(v) / model.trace if model.trace > 0 else None for v in model.values[:size]]
    facts = F.array(*(F.struct(F.lit(k + 1).alias("component"), F.lit(bool(ok[k])).alias("varies"), F.lit(shares[k]).cast("double").alias("explained")) for k in range(size)))
    each = rows.select(*(F.col(f"`{c}`") for c in keep), "deviation", F.explode(F.arrays_zip(facts.alias("fact"), F.col("w").alias("w"))).alias("c"))
    return each.select(
        *(F.col(f"`{c}`") for c in keep), F.col("c.fact.component").alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"),
        F.when(F.col("c.fact.varies"), F.col("c.w")).alias("whitened"), F.col("c.fact.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
