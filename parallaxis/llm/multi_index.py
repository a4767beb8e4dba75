"""Approximate nearest neighbours by largest inner product with an inverted multi-index.

Vectors are halved and each half is quantised by its own codebook, so ``k`` centroids a half make ``k * k`` cells. One
further coordinate a half, ``sqrt(M^2 - |x|^2)`` with M the largest norm, turns the largest inner product into the
smallest distance whatever the norms. A query walks the cells by summed distance with a heap until they hold enough
vectors; the distance at which it stops says which cells it visits. Everything in them is ranked by the inner product
of the original vectors in double precision.

How many vectors are enough is measured, not assumed: ``HELD_OUT`` sampled vectors that the codebooks are not fitted on
are searched by brute force over all rows, and the share of rows to visit is what finds ``recall`` of their neighbours.
It falls as clustered tables grow.

Each half's centroids are put in an order of likeness and cut into chunks; a chunk of either half make a tile of
cells, and a tile's vectors a block of about ``block`` rows, or several blocks by hash if it has more. Every vector is
in one block and is shuffled once. A query goes to the tiles of which it visits a cell, so what is shuffled for it
grows with the vectors that it visits, divided by a block's size. A task holds one block at a time and streams its
queries past it; for each it multiplies the visited cells alone and returns at most ``k`` rows. Codebooks, and the
counts of cells, are bounded by ``CENTROIDS``.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of another
length are an index of their own; ties go to the smaller vec_id; rows with a query's own vec_id are not its
candidates, other equal vectors are; with fewer than ``k`` candidates all are returned; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxis.llm import storage

#: Rows that codebooks are fitted on at most, and centroids of a half at most.
SAMPLE, CENTROIDS = 20_000, 512
#: Vectors that a cell holds on average, below CENTROIDS.
OCCUPANCY = 50
RECALL = 0.96
#: Sampled vectors that are not fitted on, but searched by brute force to learn how far to walk.
HELD_OUT = 256
#: Bytes of a block's vectors in double precision, and queries that meet a block at a time.
BLOCK_BYTES, QUERIES = 8_000_000, 128


def usable(vec: Column) -> Column:
    """Neither null, zero nor holding a null or non-finite component."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec.isNotNull() & F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None], 0)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(0)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _squared(x, centers).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)[:, None]
        centers = np.where(n > 0, sums / np.maximum(n, 1), centers)
    return centers


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: float) -> float:
    """Visits cells by summed distance with a heap until they hold ``enough`` vectors; the distance of the last."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, found, reached = [(first[a[0]] + second[b[0]], 0, 0)], 0, 0.0
    # a pair enters the heap once: from the pair on its left, or from above in the first column
    while heap and found < enough:
        reached, i, j = heapq.heappop(heap)
        found += counts[a[i], b[j]]
        if j + 1 < len(b):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))
    return float(reached)


@dataclass
class MultiIndex:
    norms: tuple[float, float]
    books: tuple[np.ndarray, np.ndarray]
    dim: int
    share: float = 1.0

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        cut = self.dim // 2
        return [x[:, :cut], x[:, cut:]]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The centroid of each half of stored vectors."""
        return np.stack([
            _squared(np.column_stack([h, np.sqrt(np.maximum(m * m - (h**2).sum(1), 0))]), book).argmin(1)
            for h, m, book in zip(self.halves(x), self.norms, self.books)
        ], 1)

    def distances(self, q: np.ndarray) -> list[np.ndarray]:
        """Squared distances of queries' halves, which have 0 as the further coordinate, to the centroids."""
        return [_squared(np.column_stack([h, np.zeros(len(h))]), book) for h, book in zip(self.halves(q), self.books)]

    def cell_counts(self, codes: np.ndarray) -> np.ndarray:
        k = len(self.books[0])
        return np.bincount(codes[:, 0] * k + codes[:, 1], minlength=k * k).reshape(k, k)


def _likeness(centers: np.ndarray) -> np.ndarray:
    """Centroids in an order in which neighbours are alike: halved by their main direction, again and again."""

    def halved(own: np.ndarray) -> np.ndarray:
        if len(own) < 3:
            return own
        x = centers[own] - centers[own].mean(0)
        own = own[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        return np.concatenate([halved(own[: len(own) // 2]), halved(own[len(own) // 2 :])])

    return halved(np.arange(len(centers)))


def fit(vectors: DataFrame, n: int, dim: int, sample: int = SAMPLE) -> tuple[MultiIndex, np.ndarray]:
    """Codebooks from at most ``sample`` rows by hash of vec_id, and vectors held out from fitting."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").toArrow()
    x = _matrix(rows["vec"])
    aside = min(HELD_OUT, len(x) // 4)
    asked, x = x[:aside], x[aside:]
    cut = dim // 2
    square = lambda a, b: F.aggregate(F.slice("vec", a, b), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    top = vectors.agg(*(F.max(square(a, max(b, 1)) if b else F.lit(0.0)) for a, b in ((1, cut), (cut + 1, dim - cut)))).first()
    index = MultiIndex((float(np.sqrt(top[0] or 0)), float(np.sqrt(top[1] or 0))), (np.empty(0), np.empty(0)), dim)
    centroids = int(min(CENTROIDS, len(x), max(4, round((n / OCCUPANCY) ** 0.5))))
    books = [_kmeans(np.column_stack([h, np.sqrt(np.maximum(m * m - (h**2).sum(1), 0))]), centroids) for h, m in zip(index.halves(x), index.norms)]
    index.books = tuple(b[_likeness(b)] for b in books)
    return index, asked


def _share(coded: DataFrame, index: MultiIndex, asked: np.ndarray, counts: np.ndarray, k: int, recall: float) -> float:
    """The share of all rows to visit so that ``recall`` of the exact neighbours of ``asked`` lie in visited cells."""
    total = int(counts.sum())
    k = min(k + 1, total)  # a vector that was held out is in the table too
    if not len(asked):
        return 1.0

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(asked), 0), 0.0), np.zeros((len(asked), 0), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            cells = b.column("c1").to_numpy() * len(index.books[0]) + b.column("c2").to_numpy()
            scores = np.concatenate([best[0], asked @ _matrix(b.column("vec")).T], 1)
            cells = np.concatenate([best[1], np.broadcast_to(cells, (len(asked), len(cells)))], 1)
            near = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(scores, near, 1), np.take_along_axis(cells, near, 1)
        n = best[0].shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), n)), pa.array(best[0].ravel()), pa.array(best[1].ravel())], names=["q", "score", "cell"])

    found = coded.select("vec", "c1", "c2").mapInArrow(nearest, "q long, score double, cell long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "cell")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("q", "cell").toArrow()
    first, second = index.distances(asked)
    needed = []
    for q, cell in zip(best["q"].to_numpy(), best["cell"].to_numpy()):
        sums = first[q][:, None] + second[q][None]
        needed.append(counts[sums <= sums.ravel()[cell]].sum())
    return float(min(1.0, np.quantile(needed, recall) / total))


class _Block:
    """The postings of one block in order of cell, and their search."""

    def __init__(self, parts: list[pa.RecordBatch], index: MultiIndex, k: int):
        table = pa.Table.from_batches(parts)
        cell = table["c1"].to_numpy() * len(index.books[0]) + table["c2"].to_numpy()
        order = np.argsort(cell, kind="stable")
        self.ids, self.x, cell = table["vec_id"].to_numpy()[order], _matrix(table["vec"])[order], cell[order]
        self.bounds = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        self.c1, self.c2 = np.divmod(cell[self.bounds[:-1]], len(index.books[0]))
        self.index, self.k = index, k

    def best(self, qid: np.ndarray, q: np.ndarray, reach: np.ndarray) -> list[list[dict]]:
        """The k best of the block for each query, over the cells that it visits."""
        first, second = self.index.distances(q)
        visits = first[:, self.c1] + second[:, self.c2] <= reach[:, None] * (1 + 1e-12) + 1e-12
        if visits.mean() > 0.5:
            scores = q @ self.x.T
            scores[~np.repeat(visits, np.diff(self.bounds), axis=1)] = -np.inf
        else:
            scores = np.full((len(q), len(self.ids)), -np.inf)
            for c in np.flatnonzero(visits.any(0)):
                own = np.flatnonzero(visits[:, c])
                a, z = self.bounds[c], self.bounds[c + 1]
                scores[own, a:z] = q[own] @ self.x[a:z].T
        out = []
        for i, row in enumerate(scores):
            row[self.ids == qid[i]] = -np.inf
            near = np.flatnonzero(np.isfinite(row))
            if len(near) > self.k:
                # equal vectors may differ in their last bits here, so all within rounding of the k-th are kept
                edge = np.partition(row[near], len(near) - self.k)[len(near) - self.k]
                near = near[row[near] >= edge - 1e-9 * (1 + abs(edge))]
            exact = (self.x[near] * q[i]).sum(1)
            order = np.lexsort((self.ids[near], -exact))[: self.k]
            out.append([{"score": float(s), "vec_id": int(v)} for s, v in zip(exact[order], self.ids[near[order]])])
        return out


_FOUND = pa.schema([("query_id", pa.int64()), ("found", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))])


def _meet(index: MultiIndex, k: int):
    """Rows come sorted by block, its postings before its queries: one block is held while its queries stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in ("tile", "salt", "asks")], 1)
            cuts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(1), [True]]))
            for a, z in zip(cuts, cuts[1:]):
                rows = batch.slice(a, z - a)
                if here != (own := tuple(at[a, :2])):
                    here, parts, block = own, [], None
                if not at[a, 2]:
                    parts.append(rows)
                elif parts:
                    block = block or _Block(parts, index, k)
                    for x in range(0, rows.num_rows, QUERIES):
                        part = rows.slice(x, QUERIES)
                        found = block.best(part.column("vec_id").to_numpy(), _matrix(part.column("vec")), part.column("reach").to_numpy())
                        yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(found, _FOUND.field(1).type)], schema=_FOUND)

    return run


def _search(valid: DataFrame, dim: int, n: int, k: int, recall: float, sample: int, block: int | None) -> DataFrame:
    spark = valid.sparkSession
    parallel = spark.sparkContext.defaultParallelism
    block = block or max(1024, min(BLOCK_BYTES // (8 * max(1, dim)), n // (2 * parallel)))
    index, held_out = fit(valid, n, dim, sample)
    centroids = len(index.books[0])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = index.codes(_matrix(b.column("vec"))) if b.num_rows else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes[:, 0].astype(np.int64)), pa.array(codes[:, 1].astype(np.int64))], names=[*b.schema.names, "c1", "c2"])

    kind = dict(valid.dtypes)["vec"]
    coded = storage.materialize(valid.mapInArrow(code, f"vec_id long, vec {kind}, asks boolean, c1 long, c2 long"), "postings")
    counts = np.zeros((centroids, centroids), np.int64)
    for r in coded.groupBy("c1", "c2").count().collect():  # at most centroids ** 2 rows
        counts[r.c1, r.c2] = r["count"]
    total = int(counts.sum())
    index.share = _share(coded, index, held_out, counts, k, recall)
    enough = max(index.share * total, min(total, k + 1))
    # chunks of centroids of about equal counts, as many that a tile has about a block of vectors
    chunks = max(1, min(centroids, round((total / block) ** 0.5)))
    chunk_of = [np.minimum(chunks - 1, np.cumsum(counts.sum(axis)) * chunks // (total + 1)) for axis in (1, 0)]
    tile_of = chunk_of[0][:, None] * chunks + chunk_of[1][None]
    sizes = np.bincount(tile_of.ravel(), counts.ravel(), minlength=chunks * chunks)
    salts = np.maximum(1, np.ceil(sizes / (2 * block))).astype(np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each posting in its block."""
        for b in batches:
            tile = tile_of[b.column("c1").to_numpy(), b.column("c2").to_numpy()]
            salt = b.column("hash").to_numpy() % salts[tile]
            fixed = pa.array(np.zeros(len(tile), np.int32)), pa.nulls(len(tile), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(salt), fixed[0], b.column("vec_id"), b.column("vec"), b.column("c1"), b.column("c2"), fixed[1]], names=_ROW)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query at the blocks with a cell that it visits, with the distance at which its walk stops."""
        used = counts > 0
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows, tiles, numbers, reaches = [], [], [], []
                for i, (f, s) in enumerate(zip(*index.distances(_matrix(part.column("vec"))))):
                    reach = walk(f, s, counts, enough)
                    for t in np.unique(tile_of[used & (f[:, None] + s[None] <= reach)]):
                        rows += [i] * int(salts[t])
                        tiles += [int(t)] * int(salts[t])
                        numbers += range(int(salts[t]))
                        reaches += [reach] * int(salts[t])
                n, own = len(rows), part.take(pa.array(rows, pa.int64()))
                nothing = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int64()), pa.array(numbers, pa.int64()), pa.array(np.ones(n, np.int32)), own.column("vec_id"), own.column("vec"), nothing, nothing, pa.array(reaches, pa.float64())], names=_ROW)

    schema = f"tile long, salt long, asks int, vec_id long, vec {kind}, c1 long, c2 long, reach double"
    posted = coded.select("vec_id", "vec", "c1", "c2", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)).alias("hash")).mapInArrow(place, schema)
    asked = coded.filter("asks").select("vec_id", "vec").repartition(max(2 * parallel, n // 100_000), "vec_id").distinct()
    routed = asked.mapInArrow(route, schema)
    blocks = max(2 * parallel, int(salts.sum()))
    met = posted.unionByName(routed).repartition(blocks, "tile", "salt").sortWithinPartitions("tile", "salt", "asks")
    found = met.mapInArrow(_meet(index, k), "query_id long, found array<struct<score:double,vec_id:long>>")
    # the rank limit is applied before the shuffle and again after it
    listed = found.select("query_id", F.explode("found").alias("f")).select("query_id", "f.score", "f.vec_id")
    best = listed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_ROW = ["tile", "salt", "asks", "vec_id", "vec", "c1", "c2", "reach"]


def search(embeddings: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, sample: int = SAMPLE, block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows of ``embeddings(vec_id, embedding)`` where ``is_query`` holds, the k found.

    Rows that repeat a query's vec_id are one query if their vectors are equal; the ranks of unequal ones are joint.
    """
    valid = embeddings.select("vec_id", F.col("embedding").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(usable(F.col("vec")) & F.col("vec_id").isNotNull())
    found = None
    for r in sorted(valid.groupBy(F.size("vec").alias("dim")).count().collect()):  # one row for each length of vectors
        own = _search(valid.filter(F.size("vec") == r.dim), r.dim, r["count"], k, recall, sample, block)
        found = own if found is None else found.unionByName(own)
    return found if found is not None else embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
