"""Two-view and n-view geometry: fundamental matrices by RANSAC, relative pose, triangulation, absolute pose, bundle
adjustment. Solvers are numpy on one pair, point or scene; the frames around them are grouped maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixel limit and confidence of fundamental matrices, fewest points, and rounds tried at most.
F_PIXELS, F_CONFIDENCE, F_POINTS, F_ROUNDS = 3.0, 0.99, 8, 2000
#: Pixel limit and confidence of absolute poses, rounds tried at most, and fewest points.
PNP_PIXELS, PNP_CONFIDENCE, PNP_ROUNDS, PNP_POINTS = 4.0, 0.99, 10_000, 6
HUBER = 1.0


def _normaliser(p: np.ndarray) -> np.ndarray:
    m = p.mean(0)
    s = np.sqrt(2) / max(np.sqrt(((p - m) ** 2).sum(1)).mean(), 1e-12)
    return np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])


def _homogeneous(p: np.ndarray) -> np.ndarray:
    return np.column_stack([p, np.ones(len(p))])


def fundamental(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised eight-point solution of b' F a = 0."""
    ta, tb = _normaliser(a), _normaliser(b)
    x, y = _homogeneous(a) @ ta.T, _homogeneous(b) @ tb.T
    f = np.linalg.svd((y[:, :, None] * x[:, None, :]).reshape(len(x), 9))[2][-1].reshape(3, 3)
    u, s, v = np.linalg.svd(f)
    f = tb.T @ (u @ np.diag([s[0], s[1], 0]) @ v) @ ta
    return f / (np.linalg.norm(f) or 1)


def epipolar_distance(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The larger of the pixel distances to the two epipolar lines."""
    x, y = _homogeneous(a), _homogeneous(b)
    lb, la = x @ f.T, y @ f
    e = np.abs((y * lb).sum(1))
    return np.maximum(e / np.maximum(np.hypot(lb[:, 0], lb[:, 1]), 1e-12), e / np.maximum(np.hypot(la[:, 0], la[:, 1]), 1e-12))


def ransac_fundamental(a: np.ndarray, b: np.ndarray, seed: int = 42) -> tuple[np.ndarray | None, np.ndarray]:
    """A fundamental matrix and its inliers; None with fewer than F_POINTS points or inliers."""
    n = len(a)
    best = np.zeros(n, bool)
    if n < F_POINTS:
        return None, best
    rng, rounds, k = np.random.default_rng(seed), F_ROUNDS, 0
    while k < rounds:
        pick = rng.choice(n, F_POINTS, replace=False)
        inside = epipolar_distance(fundamental(a[pick], b[pick]), a, b) < F_PIXELS
        if inside.sum() > best.sum():
            best = inside
            clear = inside.mean() ** F_POINTS
            rounds = min(F_ROUNDS, int(np.ceil(np.log(1 - F_CONFIDENCE) / np.log(max(1 - clear, 1e-12))))) if clear < 1 else 0
        k += 1
    if best.sum() < F_POINTS:
        return None, np.zeros(n, bool)
    f = fundamental(a[best], b[best])
    inside = epipolar_distance(f, a, b) < F_PIXELS
    return (f, inside) if inside.sum() >= best.sum() else (fundamental(a[best], b[best]), best)


def verify_pairs(matches: DataFrame, least: int = 30) -> DataFrame:
    """(image_i, image_j, kp_i, kp_j) inliers of ``matches(image_i, image_j, kp_i, kp_j, xi, yi, xj, yj)``.

    Pairs with fewer than ``least`` matches or inliers have none. A pair is a group: it holds at most as many rows as
    an image has features.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["kp_i", "kp_j"])
        keep = np.zeros(len(g), bool)
        if len(g) >= max(least, F_POINTS):
            seed = int(g.image_i.iloc[0]) * 1_000_003 + int(g.image_j.iloc[0]) + 42
            keep = ransac_fundamental(g[["xi", "yi"]].to_numpy(float), g[["xj", "yj"]].to_numpy(float), seed)[1]
        return g.loc[keep if keep.sum() >= least else np.zeros(len(g), bool), ["image_i", "image_j", "kp_i", "kp_j"]]

    return matches.groupBy("image_i", "image_j").applyInPandas(one, "image_i long, image_j long, kp_i long, kp_j long")


def triangulate(projections: np.ndarray, pixels: np.ndarray) -> np.ndarray | None:
    """The point seen at ``pixels`` (n x 2) by 3 x 4 ``projections``, or None at infinity."""
    rows = np.concatenate([pixels[:, :1] * projections[:, 2] - projections[:, 0], pixels[:, 1:] * projections[:, 2] - projections[:, 1]])
    x = np.linalg.svd(rows)[2][-1]
    return x[:3] / x[3] if abs(x[3]) >= 1e-10 else None


def accepted(x: np.ndarray, projections: np.ndarray, pixels: np.ndarray, centres: np.ndarray, max_error: float = 4.0, min_angle: float = 2.0) -> bool:
    """In front of all cameras, near its pixels, and seen under a wide enough angle by some two of them."""
    p = projections @ np.append(x, 1)
    if (p[:, 2] <= 0).any() or (np.linalg.norm(p[:, :2] / p[:, 2:] - pixels, axis=1) > max_error).any():
        return False
    rays = centres - x
    rays /= np.linalg.norm(rays, axis=1, keepdims=True)
    return float(np.degrees(np.arccos(np.clip((rays @ rays.T).min(), -1, 1)))) >= min_angle


def relative_pose(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Rotation and unit translation of the second camera, and how many points lie before both; rays are calibrated."""
    u, _, v = np.linalg.svd(e)
    u, v = u * np.sign(np.linalg.det(u)), v * np.sign(np.linalg.det(v))
    w = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    best = (np.eye(3), np.zeros(3), -1)
    first = np.eye(3, 4)
    for r in (u @ w @ v, u @ w.T @ v):
        for t in (u[:, 2], -u[:, 2]):
            second = np.column_stack([r, t])
            good = 0
            for p, q in zip(a, b):
                x = triangulate(np.stack([first, second]), np.stack([p, q]))
                good += x is not None and x[2] > 0 and (second @ np.append(x, 1))[2] > 0
            if good > best[2]:
                best = (r, t, good)
    return best


def essential(f: np.ndarray, k_i: np.ndarray, k_j: np.ndarray) -> np.ndarray:
    return k_j.T @ f @ k_i


def rotation(w: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(w)
    if angle < 1e-8:
        return np.eye(3)
    x, y, z = w / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def resection(points: np.ndarray, rays: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Linear pose from at least six points and calibrated image positions."""
    x, n = _homogeneous(points), len(points)
    rows = np.zeros((2 * n, 12))
    rows[0::2, 0:4], rows[0::2, 8:12] = x, -rays[:, :1] * x
    rows[1::2, 4:8], rows[1::2, 8:12] = x, -rays[:, 1:] * x
    p = np.linalg.svd(rows)[2][-1].reshape(3, 4)
    u, s, v = np.linalg.svd(p[:, :3])
    if s[0] < 1e-12:
        return None
    sign = np.sign(np.linalg.det(u @ v)) or 1
    r, t = sign * u @ v, sign * p[:, 3] / s.mean()
    return r, t


def absolute_pose(points: np.ndarray, pixels: np.ndarray, k: np.ndarray, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rotation, translation and inliers by RANSAC over six-point solutions, refined on the inliers."""
    n = len(points)
    if n < PNP_POINTS:
        return None
    rays = (_homogeneous(pixels) @ np.linalg.inv(k).T)[:, :2]
    rng, best, pose = np.random.default_rng(seed), np.zeros(n, bool), None

    def inside(r, t):
        p = (points @ r.T + t) @ k.T
        return (p[:, 2] > 0) & (np.linalg.norm(p[:, :2] / np.where(p[:, 2:] == 0, 1e-12, p[:, 2:]) - pixels, axis=1) < PNP_PIXELS)

    done, needed = 0, PNP_ROUNDS
    while done < needed:
        done += 1
        pick = rng.choice(n, PNP_POINTS, replace=False)
        made = resection(points[pick], rays[pick])
        if made is None:
            continue
        ok = inside(*made)
        if ok.sum() > best.sum():
            best, pose = ok, made
            # as many rounds as make a sample of inliers alone as likely as the confidence asks for
            miss = 1 - ok.mean() ** PNP_POINTS
            needed = min(PNP_ROUNDS, 1 if miss <= 0 else int(np.ceil(np.log(1 - PNP_CONFIDENCE) / np.log(miss))))
    if pose is None or best.sum() < PNP_POINTS:
        return None
    cameras = adjust([pose], points[best], np.zeros(best.sum(), int), np.arange(best.sum()), pixels[best], k, fix_points=True)[0]
    return (*cameras[0], inside(*cameras[0]))


def adjust(cameras, points, cam_of, point_of, pixels, k, fix_points: bool = False, fix_cameras: bool = False, fix_first: bool = True, rounds: int = 30):
    """Levenberg-Marquardt on Huber-weighted reprojection errors; points are eliminated before cameras are solved for.

    ``cameras`` are (R, t); observation m of ``pixels`` is of point ``point_of[m]`` in camera ``cam_of[m]``.
    """
    rot, tr, x = np.array([r for r, _ in cameras]), np.array([t for _, t in cameras]), np.array(points, float)
    damp = 1e-3
    focal = np.array([k[0, 0], k[1, 1]])

    def residuals(rot, tr, x):
        p = np.einsum("nij,nj->ni", rot[cam_of], x[point_of]) + tr[cam_of]
        z = np.where(np.abs(p[:, 2:]) < 1e-9, 1e-9, p[:, 2:])
        return p, p[:, :2] / z * focal + k[:2, 2] - pixels

    def cost(res):
        e = np.linalg.norm(res, axis=1)
        return np.where(e <= HUBER, e * e, 2 * HUBER * e - HUBER**2).sum()

    p, res = residuals(rot, tr, x)
    now = cost(res)
    nc, npts = len(rot), len(x)
    for _ in range(rounds):
        w = np.minimum(1, HUBER / np.maximum(np.linalg.norm(res, axis=1), 1e-12))
        z = p[:, 2]
        d = np.zeros((len(p), 2, 3))
        d[:, 0, 0], d[:, 0, 2] = focal[0] / z, -focal[0] * p[:, 0] / z**2
        d[:, 1, 1], d[:, 1, 2] = focal[1] / z, -focal[1] * p[:, 1] / z**2
        rx = p - tr[cam_of]
        skew = np.zeros((len(p), 3, 3))
        skew[:, 0, 1], skew[:, 0, 2], skew[:, 1, 0] = -rx[:, 2], rx[:, 1], rx[:, 2]
        skew[:, 1, 2], skew[:, 2, 0], skew[:, 2, 1] = -rx[:, 0], -rx[:, 1], rx[:, 0]
        jc = np.concatenate([-d @ skew, d], axis=2)
        jp = d @ rot[cam_of]
        if fix_points:
            jp = np.zeros_like(jp)
        if fix_cameras:
            jc = np.zeros_like(jc)
        elif fix_first and nc > 1:
            jc = jc * (cam_of > 0)[:, None, None]
        hcc, hpp = np.zeros((nc, 6, 6)), np.zeros((npts, 3, 3))
        gc, gp = np.zeros((nc, 6)), np.zeros((npts, 3))
        np.add.at(hcc, cam_of, w[:, None, None] * jc.transpose(0, 2, 1) @ jc)
        np.add.at(hpp, point_of, w[:, None, None] * jp.transpose(0, 2, 1) @ jp)
        np.add.at(gc, cam_of, np.einsum("n,nij,ni->nj", w, jc, res))
        np.add.at(gp, point_of, np.einsum("n,nij,ni->nj", w, jp, res))
        cross = w[:, None, None] * jc.transpose(0, 2, 1) @ jp
        while True:
            hp = np.linalg.inv(hpp + np.eye(3) * (damp * np.maximum(np.trace(hpp, axis1=1, axis2=2), 1e-9))[:, None, None])
            full = np.zeros((nc, nc, 6, 6))
            full[np.arange(nc), np.arange(nc)] = hcc + np.eye(6) * (damp * np.maximum(np.trace(hcc, axis1=1, axis2=2), 1e-9) + 1e-12)[:, None, None]
            right = gc.copy()
            if not fix_points and not fix_cameras:
                order = np.argsort(point_of, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(point_of[order])) + 1):
                    inv = hp[point_of[own[0]]]
                    left = cross[own] @ inv
                    right_part = left @ gp[point_of[own[0]]]
                    for a, m in enumerate(own):
                        right[cam_of[m]] -= right_part[a]
                        for b in own:
                            full[cam_of[m], cam_of[b]] -= left[a] @ cross[b].T
            dc = np.zeros((nc, 6)) if fix_cameras else -np.linalg.solve(full.transpose(0, 2, 1, 3).reshape(6 * nc, 6 * nc), right.ravel()).reshape(nc, 6)
            back = gp.copy()
            np.add.at(back, point_of, np.einsum("nij,ni->nj", cross, dc[cam_of]))
            dp = np.zeros((npts, 3)) if fix_points else -np.einsum("nij,nj->ni", hp, back)
            new = np.array([rotation(u[:3]) @ r for u, r in zip(dc, rot)]), tr + dc[:, 3:], x + dp
            p2, res2 = residuals(*new)
            then = cost(res2)
            if then < now:
                break
            damp *= 10
            if damp > 1e8:
                return list(zip(rot, tr)), x, now
        done = now - then < 1e-6 * now
        (rot, tr, x), p, res, now, damp = new, p2, res2, then, max(damp / 10, 1e-9)
        if done:
            break
    return list(zip(rot, tr)), x, now


SEEN = "array<struct<u:double,v:double,r:array<double>,t:array<double>>>"
#: Points that are solved side by side.
TOGETHER = 1024


def _by_point(observations: DataFrame, *also: str) -> DataFrame:
    """(point_id, also, seen): each point's pixels with the poses of their cameras, at most as many as there are cameras."""
    pose = F.struct("u", "v", F.array(*(f"r{i}" for i in range(9))).alias("r"), F.array(*(f"t{i}" for i in range(3))).alias("t"))
    return observations.groupBy("point_id").agg(*(F.first(c).alias(c) for c in also), F.collect_list(pose).alias("seen"))


def _flat(seen: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Point number, pixel, rotation and translation of all observations of a batch."""
    own = seen.flatten()
    of = np.repeat(np.arange(len(seen)), seen.value_lengths().to_numpy())
    pixels = np.stack([own.field(c).to_numpy() for c in ("u", "v")], 1)
    return of, pixels, own.field("r").flatten().to_numpy().reshape(-1, 3, 3), own.field("t").flatten().to_numpy().reshape(-1, 3)


def triangulate_many(of: np.ndarray, n: int, projections: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    """``triangulate`` of n points side by side, observation m being of point ``of[m]``; not finite at infinity."""
    place = np.arange(len(of)) - np.searchsorted(of, of)
    rows = np.zeros((n, place.max(initial=0) + 1, 2, 4))
    rows[of, place] = pixels[:, :, None] * projections[:, None, 2] - projections[:, :2]
    x = np.linalg.svd(rows.reshape(n, -1, 4), full_matrices=False)[2][:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.abs(x[:, 3:]) >= 1e-10, x[:, :3] / x[:, 3:], np.nan)


def accepted_many(x: np.ndarray, of: np.ndarray, projections: np.ndarray, pixels: np.ndarray, centres: np.ndarray, max_error: float = 4.0, min_angle: float = 2.0) -> np.ndarray:
    """``accepted`` of points side by side."""
    p = np.einsum("mij,mj->mi", projections, _homogeneous(x[of]))
    with np.errstate(divide="ignore", invalid="ignore"):
        fits = (p[:, 2] > 0) & (np.linalg.norm(p[:, :2] / p[:, 2:] - pixels, axis=1) <= max_error)
    bad = np.bincount(of, ~fits, len(x)) > 0
    place = np.arange(len(of)) - np.searchsorted(of, of)
    rays = np.zeros((len(x), place.max(initial=0) + 1, 3))
    away = centres - x[of]
    rays[of, place] = away / np.linalg.norm(away, axis=1, keepdims=True)
    used = (rays != 0).any(2)
    cos = np.where(used[:, :, None] & used[:, None], rays @ rays.transpose(0, 2, 1), 1.0).min((1, 2))
    return ~bad & (np.degrees(np.arccos(np.clip(cos, -1, 1))) >= min_angle)


def triangulate_points(observations: DataFrame, focal: float, cx: float, cy: float, max_error: float = 4.0, min_angle: float = 2.0) -> DataFrame:
    """(point_id, x, y, z, ok): points from ``observations(point_id, u, v, r0..r8, t0..t2)``, and whether they are accepted.

    Points at infinity have null places. One shuffle; points are solved ``TOGETHER`` at a time.
    """
    k = np.array([[focal, 0, cx], [0, focal, cy], [0, 0, 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, TOGETHER):
                part = b.slice(start, TOGETHER)
                of, pixels, r, t = _flat(part.column("seen"))
                projections = k @ np.concatenate([r, t[:, :, None]], 2)
                x = triangulate_many(of, part.num_rows, projections, pixels)
                ok = accepted_many(x, of, projections, pixels, -np.einsum("mji,mj->mi", r, t), max_error, min_angle)
                yield pa.RecordBatch.from_arrays([part.column("point_id").cast(pa.int64()), *(pa.array(c, pa.float64(), mask=np.isnan(c)) for c in x.T), pa.array(ok)], names=["point_id", "x", "y", "z", "ok"])

    return _by_point(observations).mapInArrow(run, "point_id long, x double, y double, z double, ok boolean")


def adjust_many(x: np.ndarray, of: np.ndarray, rot: np.ndarray, tr: np.ndarray, pixels: np.ndarray, k: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Levenberg-Marquardt of points side by side under fixed cameras, each with a damping of its own."""
    n, focal = len(x), np.array([k[0, 0], k[1, 1]])
    x, damp, open_ = x.copy(), np.full(n, 1e-3), np.ones(n, bool)

    def cost(x):
        p = np.einsum("mij,mj->mi", rot, x[of]) + tr
        res = p[:, :2] / np.where(np.abs(p[:, 2:]) < 1e-9, 1e-9, p[:, 2:]) * focal + k[:2, 2] - pixels
        e = np.linalg.norm(res, axis=1)
        return p, res, e, np.bincount(of, np.where(e <= HUBER, e * e, 2 * HUBER * e - HUBER**2), n)

    p, res, e, now = cost(x)
    for _ in range(rounds):
        if not open_.any():
            break
        w, z = np.minimum(1, HUBER / np.maximum(e, 1e-12)), np.where(np.abs(p[:, 2]) < 1e-9, 1e-9, p[:, 2])
        d = np.zeros((len(p), 2, 3))
        d[:, 0, 0], d[:, 0, 2] = focal[0] / z, -focal[0] * p[:, 0] / z**2
        d[:, 1, 1], d[:, 1, 2] = focal[1] / z, -focal[1] * p[:, 1] / z**2
        j = d @ rot
        h, g = np.zeros((n, 3, 3)), np.zeros((n, 3))
        np.add.at(h, of, w[:, None, None] * j.transpose(0, 2, 1) @ j)
        np.add.at(g, of, np.einsum("m,mij,mi->mj", w, j, res))
        step = np.linalg.solve(h + np.eye(3) * (damp * np.maximum(np.trace(h, axis1=1, axis2=2), 1e-9))[:, None, None], g[:, :, None])[:, :, 0]
        trial = np.where(open_[:, None], x - step, x)
        then = cost(trial)[3]
        better = open_ & (then < now)
        # a point is done when a step gains next to nothing, or when no step gains anything
        open_ &= ~((better & (now - then < 1e-6 * now)) | (~better & (damp > 1e8)))
        x, damp = np.where(better[:, None], trial, x), np.where(better, np.maximum(damp / 10, 1e-9), damp * 10)
        p, res, e, now = cost(x)
    return x


def adjust_points(observations: DataFrame, focal: float, cx: float, cy: float) -> DataFrame:
    """(point_id, x, y, z) refined with fixed cameras: every point is a problem of its own.

    ``observations`` carry point_id, x, y, z, u, v, r0..r8, t0..t2. One shuffle; points move ``TOGETHER`` at a time.
    """
    k = np.array([[focal, 0, cx], [0, focal, cy], [0, 0, 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, TOGETHER):
                part = b.slice(start, TOGETHER)
                of, pixels, r, t = _flat(part.column("seen"))
                x = adjust_many(np.stack([part.column(c).to_numpy() for c in "xyz"], 1), of, r, t, pixels, k)
                yield pa.RecordBatch.from_arrays([part.column("point_id").cast(pa.int64()), *map(pa.array, x.T)], names=["point_id", "x", "y", "z"])

    return _by_point(observations, "x", "y", "z").mapInArrow(run, "point_id long, x double, y double, z double")


def umeyama(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and translation that take points a nearest to b."""
    ma, mb = a.mean(0), b.mean(0)
    u, s, v = np.linalg.svd((b - mb).T @ (a - ma) / len(a))
    flip = np.diag([1, 1, np.sign(np.linalg.det(u @ v)) or 1])
    r = u @ flip @ v
    scale = np.trace(np.diag(s) @ flip) / ((a - ma) ** 2).sum(1).mean()
    return float(scale), r, mb - scale * r @ ma
