"""PatchMatch stereo: a depth and a normal for every pixel of a reference view, by propagation and random refinement.

One reference view with its few source views is one Arrow row and one task; views are independent until their depth
maps are checked against each other (``geometry.consistent_views``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cost of a hypothesis that cannot be judged, best sources averaged, and radius of a seed's patch in images
#: of this width; in others it is to scale.
WORST, BEST_SOURCES, SEED_RADIUS, SEED_WIDTH = 2.0, 3, 50, 1280
REFINEMENTS, SHRINK = 2, 0.6


@dataclass
class View:
    gray: np.ndarray
    k: np.ndarray
    r: np.ndarray
    t: np.ndarray


def sample(image: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Bilinear values, edges repeated."""
    h, w = image.shape
    u, v = np.clip(u, 0, w - 1), np.clip(v, 0, h - 1)
    x, y = np.minimum(u.astype(int), w - 2), np.minimum(v.astype(int), h - 2)
    a, b = u - x, v - y
    return (1 - b) * ((1 - a) * image[y, x] + a * image[y, x + 1]) + b * ((1 - a) * image[y + 1, x] + a * image[y + 1, x + 1])


class Matcher:
    """Costs of plane hypotheses of one reference view against its sources."""

    def __init__(self, ref: View, sources: list[View], radius: int):
        self.ref, self.radius = ref, radius
        self.inverse = np.linalg.inv(ref.k)
        self.maps = []
        for s in sources:
            rel = s.r @ ref.r.T
            self.maps.append((s.gray, s.k @ rel @ self.inverse, s.k @ (s.t - rel @ ref.t)))
        d = np.arange(-radius, radius + 1)
        self.offsets = np.stack(np.meshgrid(d, d), -1).reshape(-1, 2)

    def rays(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([x, y, np.ones_like(x)], -1) @ self.inverse.T

    def cost(self, x: np.ndarray, y: np.ndarray, depth: np.ndarray, normal: np.ndarray) -> np.ndarray:
        """1 - correlation over a patch on the plane, the mean of the best sources; from 0 to 2."""
        px = np.stack([x[:, None] + self.offsets[:, 0], y[:, None] + self.offsets[:, 1], np.ones((len(x), len(self.offsets)))], -1)
        plane = (self.rays(x.astype(float), y.astype(float)) * normal).sum(-1) * depth
        inverse = np.einsum("nkc,nc->nk", px @ self.inverse.T, normal) / np.where(np.abs(plane) < 1e-9, 1e-9, plane)[:, None]
        h, w = self.ref.gray.shape
        inside = (px[..., 0] >= 0) & (px[..., 0] < w) & (px[..., 1] >= 0) & (px[..., 1] < h) & (inverse > 0)
        own = sample(self.ref.gray, px[..., 0], px[..., 1])
        out = []
        for gray, a, b in self.maps:
            q = px @ a.T + b * inverse[..., None]
            z = np.where(q[..., 2] > 1e-9, q[..., 2], 1e-9)
            u, v = q[..., 0] / z, q[..., 1] / z
            ok = inside & (q[..., 2] > 1e-9) & (u >= 0) & (u < gray.shape[1]) & (v >= 0) & (v < gray.shape[0])
            other, n = sample(gray, u, v), ok.sum(1)
            m = np.maximum(n, 1)[:, None]
            da = np.where(ok, own - (own * ok).sum(1, keepdims=True) / m, 0)
            db = np.where(ok, other - (other * ok).sum(1, keepdims=True) / m, 0)
            va, vb = (da * da).sum(1) / m[:, 0], (db * db).sum(1) / m[:, 0]
            c = 1 - (da * db).sum(1) / m[:, 0] / np.sqrt(np.maximum(va * vb, 1e-24))
            out.append(np.where((n < len(self.offsets) // 2) | (va < 1e-6) | (vb < 1e-6), WORST, np.clip(c, 0, 2)))
        best = np.sort(np.stack(out), 0)[:BEST_SOURCES]
        return best.mean(0)


def start(matcher: Matcher, low: float, high: float, seeds: list[tuple[float, float, float]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Random depths in range and normals toward the camera; patches about seeds (x, y, depth) take theirs, last wins."""
    h, w = matcher.ref.gray.shape
    depth = rng.uniform(low, high, (h, w))
    normal = rng.normal(size=(h, w, 3))
    yy, xx = np.mgrid[:h, :w].astype(float)
    rays = matcher.rays(xx, yy)
    normal /= np.linalg.norm(normal, axis=-1, keepdims=True)
    normal *= -np.sign((normal * rays).sum(-1, keepdims=True) + 1e-12)
    reach = round(SEED_RADIUS * w / SEED_WIDTH)
    for x, y, d in seeds:
        ys = slice(max(0, round(y) - reach), max(0, round(y) + reach + 1))
        xs = slice(max(0, round(x) - reach), max(0, round(x) + reach + 1))
        depth[ys, xs] = d
        normal[ys, xs] = -rays[ys, xs] / np.linalg.norm(rays[ys, xs], axis=-1, keepdims=True)
    return depth, normal


def estimate(ref: View, sources: list[View], low: float, high: float, iterations: int = 12, radius: int = 5, seeds: list[tuple[float, float, float]] = (), seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, camera-frame normal and confidence (1 - cost / 2) of every pixel."""
    rng, matcher = np.random.default_rng(seed), Matcher(ref, sources, radius)
    depth, normal = start(matcher, low, high, list(seeds), rng)
    h, w = depth.shape
    yy, xx = np.mgrid[:h, :w]
    cost = matcher.cost(xx.ravel(), yy.ravel(), depth.ravel(), normal.reshape(-1, 3)).reshape(h, w)
    for turn in range(iterations):
        for parity in (0, 1):
            y, x = np.nonzero((yy + xx) % 2 == parity)

            def offer(d, n, y=y, x=x):
                ok = (d >= low) & (d <= high)
                c = np.full(len(d), np.inf)
                c[ok] = matcher.cost(x[ok], y[ok], d[ok], n[ok])
                won = c < cost[y, x]
                depth[y[won], x[won]], normal[y[won], x[won]], cost[y[won], x[won]] = d[won], n[won], c[won]

            for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
                ny, nx = np.clip(y + dy, 0, h - 1), np.clip(x + dx, 0, w - 1)
                offer(depth[ny, nx].copy(), normal[ny, nx].copy())
            reach = 0.5 * (high - low) * SHRINK**turn
            for _ in range(REFINEMENTS):
                d = depth[y, x] + rng.uniform(-reach, reach, len(y))
                n = normal[y, x] + rng.uniform(-1, 1, (len(y), 3)) * SHRINK**turn
                n /= np.linalg.norm(n, axis=1, keepdims=True)
                n *= -np.sign((n * matcher.rays(x.astype(float), y.astype(float))).sum(1, keepdims=True) + 1e-12)
                offer(d, n)
                reach *= 0.5
    return depth, normal, 1 - cost / 2


def depth_maps(jobs: DataFrame, iterations: int = 12, radius: int = 5) -> DataFrame:
    """(image_id, y, x, depth, nx, ny, nz, conf) for rows (image_id, width, height, low, high, views).

    ``views`` lists the reference first, then its sources, as structs (gray: packed float32, k, r, t: arrays); a column
    ``seeds``, if there is one, lists (x, y, depth) of known points. A row without sources has no pixels.
    """
    names = ["image_id", "y", "x", "depth", "nx", "ny", "nz", "conf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(n)[k].as_py() for n in b.schema.names}
                w, h = row["width"], row["height"]
                seen = [View(np.frombuffer(v["gray"], "<f4").reshape(h, w).astype(float), np.reshape(v["k"], (3, 3)), np.reshape(v["r"], (3, 3)), np.array(v["t"])) for v in row["views"]]
                if len(seen) < 2:
                    continue
                d, n, c = estimate(seen[0], seen[1:], row["low"], row["high"], iterations, radius, row.get("seeds") or [], seed=42 + 1_000_000 * row["image_id"])
                yy, xx = (a.ravel().astype(np.int32) for a in np.mgrid[:h, :w])
                planes = [d, n[..., 0], n[..., 1], n[..., 2], c]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, row["image_id"], np.int64)), pa.array(yy), pa.array(xx), *(pa.array(p.ravel().astype(np.float32)) for p in planes)], names=names)

    given = [c for c in ("image_id", "width", "height", "low", "high", "views", "seeds") if c in jobs.columns]
    # a number that adaptive execution does not merge: a view is seconds of work
    parts = max(jobs.count(), 1)
    return jobs.select(*given).repartition(min(parts, 8 * jobs.sparkSession.sparkContext.defaultParallelism), "image_id").mapInArrow(run, "image_id long, y int, x int, depth float, nx float, ny float, nz float, conf float")
