"""Adjustment, band joins, signed graphs, eigen-solvers, scatter, painting and tiles against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.functions import eigen
from parallaxis.operators import bands, bundle, mirror, painting, raster, tiles
from parallaxis.plans import fits, scene

# bundle adjustment ---------------------------------------------------------------------------------------------------


def rodrigues(w):
    a = np.linalg.norm(w)
    if a < 1e-8:
        return np.eye(3)
    k = w / a
    x = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + math.sin(a) * x + (1 - math.cos(a)) * x @ x


def dense_step(obs, points, poses, lens, damping):
    """One damped step by the whole normal matrix; (cameras, points) moved, and the cost before."""
    ci, pi = {c: k for k, c in enumerate(sorted(poses))}, {p: k for k, p in enumerate(sorted(points))}
    nc = 6 * len(ci)
    a, g, total = np.zeros((nc + 3 * len(pi),) * 2), np.zeros(nc + 3 * len(pi)), 0.0
    for p, c, u, v in obs:
        r, t = poses[c]
        turned = r @ points[p]
        x, y, z = turned + t
        res = np.array([lens.focal * x / z + lens.cx - u, lens.focal * y / z + lens.cy - v])
        size = np.linalg.norm(res)
        w = 1.0 if size <= bundle.HUBER else bundle.HUBER / size
        total += size**2 if size <= bundle.HUBER else 2 * bundle.HUBER * size - bundle.HUBER**2
        d = lens.focal * np.array([[1 / z, 0, -x / z**2], [0, 1 / z, -y / z**2]])
        skew = np.array([[0, turned[2], -turned[1]], [-turned[2], 0, turned[0]], [turned[1], -turned[0], 0]])
        j = np.zeros((2, len(g)))
        j[:, 6 * ci[c] : 6 * ci[c] + 6] = np.hstack([d @ skew, d])
        j[:, nc + 3 * pi[p] : nc + 3 * pi[p] + 3] = d @ r
        rows = np.flatnonzero(j.any(0))
        a[np.ix_(rows, rows)] += w * j[:, rows].T @ j[:, rows]
        g[rows] += w * j[:, rows].T @ res
    a[np.diag_indices_from(a)] = a.diagonal() * (1 + damping) + 1e-9
    step = -np.linalg.solve(a, g)
    cams = {c: (rodrigues(step[6 * k : 6 * k + 3]) @ poses[c][0], poses[c][1] + step[6 * k + 3 : 6 * k + 6]) for c, k in ci.items()}
    return cams, {p: points[p] + step[nc + 3 * k : nc + 3 * k + 3] for p, k in pi.items()}, total


def test_bundle_adjust_equals_dense_normal_equations(spark, sf_dir):
    lens = bundle.Lens(scene.FOCAL, scene.CX, scene.CY)
    observed = scene.seen(spark, sf_dir).filter("point_id < 25 and image_id < 5").select("point_id", "image_id", "u", "v")
    points = scene.points(spark, sf_dir).filter("v_id < 26").select(F.col("v_id").alias("point_id"), (F.col("x") + 2e-4).alias("x"), (F.col("y") - (F.col("v_id") % 3) * 1e-4).alias("y"), "z")
    cameras = scene.cameras(spark, sf_dir).filter("image_id < 5")
    obs = [tuple(r) for r in observed.collect()]
    pts = {r.point_id: np.array([r.x, r.y, r.z]) for r in points.collect()}
    poses = {r.image_id: (np.array(r[1:10]).reshape(3, 3), np.array(r[10:13])) for r in cameras.collect()}
    seen = {o[0] for o in obs}
    costs, damping = [], 0.5
    state = (poses, {p: x for p, x in pts.items() if p in seen})
    for _ in range(2):
        cams, found, total = dense_step(obs, state[1], state[0], lens, damping)
        costs.append(total)
        state, damping = (cams, found), damping / 10
    costs.append(dense_step(obs, state[1], state[0], lens, damping)[2])
    done = bundle.adjust(observed, points, cameras, lens, rounds=2, damping=0.5, tolerance=1e-8, most=200)
    assert costs[0] > costs[1] > costs[2] and np.allclose(done.costs, costs, rtol=1e-6) and done.observations == len(obs)
    for r in done.cameras.collect():
        assert np.allclose(np.array(r[1:10]).reshape(3, 3), state[0][r.image_id][0], atol=1e-6) and np.allclose(r[10:13], state[0][r.image_id][1], atol=1e-6)
    for r in done.points.collect():
        assert np.allclose([r.x, r.y, r.z], state[1].get(r.point_id, pts[r.point_id]), atol=1e-6)  # point 25 is not seen


def test_bundle_adjust_shuffles_only_sums_by_camera(spark, sf_dir):
    """Observations are stored once, as they are; a pass over them exchanges nothing but what cameras add up."""
    lens = bundle.Lens(scene.FOCAL, scene.CX, scene.CY)
    observed = scene.seen(spark, sf_dir).filter("point_id < 9").select("point_id", "image_id", "u", "v")
    points = scene.points(spark, sf_dir).withColumnRenamed("v_id", "point_id")
    done = bundle.adjust(observed, points, scene.cameras(spark, sf_dir), lens, rounds=1, most=1)
    assert done.held.columns == ["point_id", "image_id", "u", "v"] and done.held.count() == observed.count()
    system = bundle.Reduced(done.held, done.points, done.cameras, lens, 0.5, bundle.BUCKETS * spark.sparkContext.defaultParallelism)
    vectors = done.cameras.select("image_id", *(F.lit(1.0).alias(f"z_{k}") for k in range(6)))
    gathered = system._gathered(vectors, [f"z_{k}" for k in range(6)]).join(system.points, "point_id")
    plan = system._spread(system._solved(gathered, ["g0", "g1", "g2"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(image_id") == plan.count("Exchange hashpartitioning") == 1


def test_bundle_adjust_goes_on_until_nothing_is_gained(spark, sf_dir, monkeypatch):
    """The query sets no bound of its own, and rounds go on while steps lower the cost: here each goes nine tenths of the way."""
    given, real = [], bundle.adjust

    def noted(observations, points, cameras, lens, **bounds):
        given.append(bounds)
        return bundle.Adjusted(cameras, points, [0.0], 0, observations, True)

    monkeypatch.setattr(fits.bundle, "adjust", noted)
    assert fits.bundle_adjust(spark, sf_dir).columns == ["kind", "id", "x", "y", "z", "n"] and given == [{}]
    cameras, truth = scene.cameras(spark, sf_dir).filter("image_id < 2"), scene.points(spark, sf_dir).filter("v_id < 3").withColumnRenamed("v_id", "point_id")
    lens, rows = bundle.Lens(scene.FOCAL, scene.CX, scene.CY), []
    for c in cameras.collect():
        for p in truth.collect():
            x, y, z = np.array(c[1:10]).reshape(3, 3) @ [p.x, p.y, p.z] + np.array(c[10:13])
            rows += [(p.point_id, c.image_id, float(lens.focal * x / z + lens.cx + s), float(lens.focal * y / z + lens.cy)) for s in (-0.5, 0.5)]
    monkeypatch.setattr(bundle.Reduced, "__init__", lambda self, held, points, *rest: setattr(self, "points", points))
    monkeypatch.setattr(bundle.Reduced, "close", lambda self: None)
    monkeypatch.setattr(bundle.Reduced, "solve", lambda self, *a: cameras.select("image_id", *(F.lit(0.0).alias(f"x{k}") for k in range(6))))
    to = truth.toDF("point_id", "tx", "ty", "tz")
    monkeypatch.setattr(bundle.Reduced, "back", lambda self, steps: self.points.join(to, "point_id").select("point_id", *((0.9 * (F.col(c) - F.col(f"t{c}"))).alias(f"h{k}") for k, c in enumerate("xyz"))))
    off = truth.select("point_id", *((F.col(c) + 1e-3).alias(c) for c in "xyz"))
    done = real(spark.createDataFrame(rows, "point_id long, image_id long, u double, v double"), off, cameras, lens)
    assert done.converged and len(done.costs) > 5 and math.isclose(done.costs[-1], 0.25 * len(rows), rel_tol=1e-8)


def test_bundle_adjust_ends_where_no_step_lowers_the_cost(spark, sf_dir, monkeypatch):
    """Rejected steps are damped until they are too short, and the start is kept; with too few rounds it says so."""
    observed = scene.seen(spark, sf_dir).filter("point_id < 3 and image_id < 2").select("point_id", "image_id", "u", "v")
    points = scene.points(spark, sf_dir).filter("v_id < 3").withColumnRenamed("v_id", "point_id")
    monkeypatch.setattr(bundle.Reduced, "__init__", lambda self, held, points, *rest: setattr(self, "points", points))
    monkeypatch.setattr(bundle.Reduced, "close", lambda self: None)
    monkeypatch.setattr(bundle.Reduced, "solve", lambda self, *a: cameras.select("image_id", *(F.lit(0.0).alias(f"x{k}") for k in range(6))))
    monkeypatch.setattr(bundle.Reduced, "back", lambda self, steps: self.points.select("point_id", *(F.lit(0.03).alias(f"h{k}") for k in range(3))))
    cameras, lens = scene.cameras(spark, sf_dir).filter("image_id < 2"), bundle.Lens(scene.FOCAL, scene.CX, scene.CY)
    done = bundle.adjust(observed, points, cameras, lens)
    assert len(done.costs) == 1 and done.converged
    assert sorted(tuple(r) for r in done.points.collect()) == sorted(tuple(r) for r in points.collect())
    assert not bundle.adjust(observed, points, cameras, lens, rounds=2).converged


def test_bundle_adjust_of_nothing(spark, sf_dir):
    cameras, points = scene.cameras(spark, sf_dir), scene.points(spark, sf_dir).withColumnRenamed("v_id", "point_id")
    none = spark.createDataFrame([(None, 1, 1.0, 1.0), (1, None, 1.0, 1.0), (10**9, 1, 1.0, 1.0)], "point_id long, image_id long, u double, v double")
    done = bundle.adjust(none, points, cameras, bundle.Lens(1.0, 0.0, 0.0))
    assert done.costs == [0.0] and done.cameras.count() == cameras.count() and done.points.count() == points.count()


# band joins ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_rows", [5, 1000])
def test_band_join(spark, block_rows):
    rng = random.Random(1)
    a = [(k, rng.choice(["x", "y", None]), rng.choice([0.0, 0.5, -0.0, 7.25, None, float("nan"), float("inf"), rng.uniform(-9, 9)])) for k in range(150)]
    b = [(k, rng.choice(["x", "y", None]), rng.choice([0.0, 0.25, 1.0, 7.25, None, float("nan"), float("inf"), rng.uniform(-9, 9)])) for k in range(150)]
    left, right = spark.createDataFrame(a, "i long, g string, p double"), spark.createDataFrame(b, "j long, g string, q double")
    met = bands.band_join(left, right, "p", "q", 0.5, on=("g",), extra=F.col("i") != F.col("j"), block_rows=block_rows)
    want = sorted((i, j) for i, g, p in a for j, h, q in b if g is not None and g == h and p is not None and q is not None and abs(p - q) < 0.5 and i != j)
    assert sorted(tuple(r) for r in met.select("i", "j").collect()) == want and want
    assert "NestedLoop" not in met._jdf.queryExecution().toString() and "Cartesian" not in met._jdf.queryExecution().toString()
    assert bands.band_join(left, right, "p", "q", 0.0, on=("g",)).count() == 0
    assert bands.band_join(left.limit(0), right.drop("g"), "p", "q", 1.0).count() == 0


# signed graphs -------------------------------------------------------------------------------------------------------


def sides_by_search(nodes, edges):
    near = {n: [] for n in nodes}
    for u, v, f in edges:
        if u in near and v in near and f is not None:
            near[u].append((v, f))
            near[v].append((u, f))
    out = {}
    for n in sorted(near):
        if n in out:
            continue
        side, stack, ok = {n: False}, [n], True
        while stack:
            u = stack.pop()
            for v, f in near[u]:
                if v not in side:
                    side[v] = side[u] != f
                    stack.append(v)
                elif side[v] != (side[u] != f):
                    ok = False
        out |= {u: (u, n, s if ok else None, ok) for u, s in side.items()}
    return sorted(out.values())


def test_signed_components(spark):
    rng = random.Random(2)
    nodes = [*range(60), 10**12]
    edges = [(rng.randrange(60), rng.randrange(60), rng.random() < 0.5) for _ in range(45)]
    edges += [(5, 5, True), (6, 6, False), (7, None, True), (8, 9, None), (10, 4444, True), (11, 12, True), (11, 12, False)]
    frame = spark.createDataFrame([(n,) for n in [*nodes, None, 3]], "node long")
    linked = spark.createDataFrame(edges, "u long, v long, flipped boolean")
    sides = mirror.signed_components(frame, linked)
    want = sides_by_search(nodes, edges)
    assert sorted(tuple(r) for r in sides.collect()) == want
    assert {w[3] for w in want} == {True, False}
    bad = {n for n, _, _, ok in want if not ok}
    assert sorted(map(repr, map(tuple, mirror.contradictory(sides, linked).select("u", "v", "flipped").collect()))) == sorted(repr(e) for e in edges if e[0] in bad)
    small = {r.node: r.mirrored for r in mirror.minority(sides).collect()}
    for c in {w[1] for w in want}:
        own = [w for w in want if w[1] == c]
        k = sum(bool(w[2]) for w in own)
        assert all(small[n] == (None if not ok else (not s if 2 * k > len(own) else s)) for n, _, s, ok in own)
    assert mirror.signed_components(frame.limit(0), linked).count() == 0


@pytest.mark.parametrize("chunk", [2, 7, 10**6])
def test_signed_components_contract_edges_where_they_are(spark, chunk):
    rng = random.Random(chunk)
    edges = [(u, v, rng.random() < 0.4) for u, v in ((rng.randrange(90), rng.randrange(90)) for _ in range(80))] + [(k, k + 1, k % 3 == 0) for k in range(100, 160)]
    frame = spark.range(170).withColumnRenamed("id", "node")
    linked = spark.createDataFrame(edges, "u long, v long, flipped boolean").repartition(5)
    want = sides_by_search(list(range(170)), edges)
    assert {w[3] for w in want} == {True, False}
    for closed in (False, True):
        assert sorted(tuple(r) for r in mirror.signed_components(frame, linked, closed, chunk).collect()) == want


def test_signed_components_spread_only_links_of_stars(spark, monkeypatch):
    """A chain that lies together leaves nothing to be spread in rounds, and one that contradicts itself one node."""
    met = []
    monkeypatch.setattr(mirror.graph, "label_components", lambda nodes, edges, f=mirror.graph.label_components: met.append((nodes.count(), edges.count())) or f(nodes, edges))
    edges = [(k, k + 1, k % 3 == 0) for k in range(50)] + [(60, 61, True), (60, 61, False)]
    linked = spark.createDataFrame(edges, "u long, v long, flipped boolean").coalesce(1)
    sides = mirror.signed_components(spark.range(70).withColumnRenamed("id", "node"), linked, closed=True)
    assert met == [(2, 2)] and sides.filter("component = 0").count() == 51 and sides.filter("not satisfied").count() == 2


def test_interpolated(spark):
    rows = [("a", 1, None, 5.0), ("a", 2, True, 10.0), ("a", 3, False, 99.0), ("a", 6, True, 30.0), ("a", 7, False, 99.0), ("b", 1, False, 1.0), (None, 1, True, 4.0), (None, 3, None, None)]
    frame = spark.createDataFrame(rows, "g string, k long, ok boolean, p double")
    got = {(r.g, r.k): (r.p, r.before_k, r.after_k) for r in mirror.interpolated(frame, "k", F.col("ok"), ("p",), ("g",)).collect()}
    assert got == {
        ("a", 1): (10.0, None, 2), ("a", 2): (10.0, 2, 2), ("a", 3): (15.0, 2, 6), ("a", 6): (30.0, 6, 6), ("a", 7): (30.0, 6, None),
        ("b", 1): (None, None, None), (None, 1): (4.0, 1, 1), (None, 3): (4.0, 1, None),
    }


# eigen-solvers -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [3, 4])
def test_symmetric_eigenvectors(spark, n):
    rng = np.random.default_rng(3)
    made = [rng.normal(size=(n, n)) * 10.0 ** rng.integers(-6, 7) for _ in range(40)]
    made = [m + m.T for m in made] + [np.zeros((n, n)), np.eye(n) * 5, np.diag(np.arange(n, 0.0, -1)), np.ones((n, n)), np.diag([1e-12] * (n - 1) + [1e12])]
    made += [q @ np.diag([1.0, 1.0, 7.0, 7.0][:n]) @ q.T for q in [np.linalg.qr(rng.normal(size=(n, n)))[0] for _ in range(5)]]
    names = [f"a{i}{j}" for i in range(n) for j in range(i, n)]
    rows = [(k, *(float(m[i, j]) for i in range(n) for j in range(i, n))) for k, m in enumerate(made)]
    rows.append((len(made), None, *[1.0] * (len(names) - 1)))
    frame = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in names))
    got = eigen.symmetric(frame, {(i, j): F.col(f"a{i}{j}") for i in range(n) for j in range(i, n)}, n).collect()
    for r in got:
        if r.k == len(made):
            continue
        m = made[r.k]
        w, v = np.array([r[f"_eig_w{k}"] for k in range(n)]), np.array([[r[f"_eig_v{i}{k}"] for k in range(n)] for i in range(n)])
        size = max(np.abs(m).max(), 1e-300)
        assert np.allclose(w / size, np.linalg.eigvalsh(m) / size, atol=1e-12)
        assert np.allclose(m @ v / size, v * w / size, atol=1e-11) and np.allclose(v.T @ v, np.eye(n), atol=1e-12)


def test_plane_fit(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(30):
        flat = rng.normal(size=(12, 2)) @ rng.normal(size=(2, 3)) + rng.normal(size=(12, 3)) * 0.01 + rng.normal(size=3) * 50
        rows += [(k, *map(float, p)) for p in flat]
    rows += [(90, 1.0, 2.0, 3.0)] * 5 + [(91, float(t), 2.0 * t, 0.0) for t in range(6)] + [(92, 0.0, 0.0, 1.0), (92, 1.0, 0.0, 1.0)] + [(93, None, 1.0, 1.0), (93, 0.0, 0.0, 0.0), (93, 1.0, 0.0, 0.0), (93, 0.0, 1.0, 0.0)]
    rows += [(None, 0.0, 0.0, 5.0), (None, 1.0, 0.0, 5.0), (None, 0.0, 1.0, 5.0)]
    got = {r.k: r for r in eigen.plane_fit(spark.createDataFrame(rows, "k long, x double, y double, z double"), "k").collect()}
    for k in range(30):
        p = np.array([r[1:] for r in rows if r[0] == k])
        _, s, vt = np.linalg.svd(p - p.mean(0))
        n = np.array([got[k].nx, got[k].ny, got[k].nz])
        assert abs(abs(n @ vt[2]) - 1) < 1e-9 and abs(got[k].rms - s[2] / math.sqrt(len(p))) < 1e-9
        assert n[np.abs(n).argmax()] > 0 and np.allclose([got[k].cx, got[k].cy, got[k].cz], p.mean(0))
    assert all(got[k].nx is None and got[k].rms is None for k in (90, 91, 92))
    assert (got[93].n, got[93].nz, got[93].rms) == (3, 1.0, 0.0) and (got[None].nz, got[None].cz) == (1.0, 5.0)


def test_similarity_fit(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(25):
        p = rng.normal(size=(15, 3)) * [3, 1, 0.5]
        r = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        q = 2.5 * p @ (r * np.sign(np.linalg.det(r)) if k % 5 else -r * np.sign(np.linalg.det(r))).T + rng.normal(size=3) + rng.normal(size=(15, 3)) * (0.05 if k % 2 else 0)
        rows += [(k, *map(float, a), *map(float, b)) for a, b in zip(p, q)]
    rows += [(70, float(t), 0.0, 0.0, float(t), 1.0, 0.0) for t in range(5)] + [(71, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0)] * 4 + [(72, None, 1.0, 1.0, 2.0, 2.0, 2.0)]
    got = {r.k: r for r in eigen.similarity_fit(spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in "xyzuvw")), "k").collect()}
    for k in range(25):
        both = np.array([r[1:] for r in rows if r[0] == k])
        p, q = both[:, :3], both[:, 3:]
        a, b = p - p.mean(0), q - q.mean(0)
        u, s, vt = np.linalg.svd(b.T @ a / len(a))
        d = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
        r, scale = u @ d @ vt, (s * d.diagonal()).sum() / (a * a).sum() * len(a)
        assert abs(got[k].scale - scale) < 1e-9 and np.allclose([got[k][f"r{i}"] for i in range(9)], r.ravel(), atol=1e-8)
        assert np.allclose([got[k][f"t{i}"] for i in range(3)], q.mean(0) - scale * r @ p.mean(0), atol=1e-8)
        left = b - scale * a @ r.T
        assert abs(got[k].rms - math.sqrt((left * left).sum() / len(a))) < 1e-6
    assert all(got[k].scale is None and got[k].r0 is None for k in (70, 71)) and 72 not in got


# histograms, painting, tiles -----------------------------------------------------------------------------------------


def test_scattered(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), rng.uniform(-0.5, 4.5), rng.uniform(0, 4), rng.uniform(-9, 20), rng.uniform(0, 2)) for _ in range(300)] + [(1, None, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0, None), (2, 0.5, 0.5, 8.0, 1.0)]
    want = {}
    for k, x, y, o, m in rows:
        if None in (x, y, o, m):
            continue
        x, y = x - 0.5, y - 0.5
        for dx in (0, 1):
            for dy in (0, 1):
                for do in (0, 1):
                    cx, cy = math.floor(x) + dx, math.floor(y) + dy
                    if 0 <= cx < 4 and 0 <= cy < 4:
                        bin_ = (cy * 4 + cx) * 8 + (math.floor(o) + do) % 8
                        w = m * (1 - abs(x - cx)) * (1 - abs(y - cy)) * (1 - abs(o - math.floor(o) - do))
                        want[k, bin_] = want.get((k, bin_), 0) + w
    got = {(r.k, r.bin): r.weight for r in raster.scattered(spark.createDataFrame(rows, "k long, x double, y double, o double, m double"), "k").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("tile", [1, 4, 16])
def test_painted(spark, tile):
    rng = random.Random(7)
    rows = [(rng.randrange(2), *(rng.randrange(-6, 30) for _ in range(2)), *(rng.randrange(-6, 30) for _ in range(2)), k // 2, rng.random()) for k in range(160)] + [(0, None, 0, 9, 9, 999, 1.0), (3, -9, -9, -1, -1, 1, 1.0)]
    want = {}
    for image, x0, y0, x1, y1, o, d in rows:
        if x0 is None:
            continue
        for y in range(max(0, y0), min(20, y1 + 1)):
            for x in range(max(0, x0), min(27, x1 + 1)):
                want[image, y, x] = max(want.get((image, y, x), (-1, 0)), (o, d))
    frame = spark.createDataFrame(rows, "image_id long, x0 long, y0 long, x1 long, y1 long, o long, d double")
    got = {(r.image_id, r.y, r.x): r.d for r in painting.painted(frame, 27, 20, ["o"], ["d"], tile).collect()}
    assert got == {k: v[1] for k, v in want.items()}
    assert painting.painted(frame.limit(0), 27, 20, ["o"], ["d"], tile).count() == 0


H, W = 21, 34


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(8)
    spots = rng.uniform(0, 1, (2, H, W)) * 3
    y, x = np.mgrid[:H, :W]
    for _ in range(14):
        spots[rng.integers(2)] += 80 * np.exp(-((y - rng.uniform(0, H)) ** 2 + (x - rng.uniform(0, W)) ** 2) / (2 * rng.uniform(1.2, 2.4) ** 2))
    rows = [(k, r, c, float(spots[k, r, c])) for k in range(2) for r in range(H) for c in range(W)]
    return spots, spark.createDataFrame(rows, "image_id long, y long, x long, v double").repartition(5)


@pytest.mark.parametrize("tile", [10, 13, 64])
def test_blur_is_independent_of_tiles(spark, images, tile):
    found = {(r.image_id, r.y, r.x): r.v for r in tiles.pixels(tiles.gaussian(tiles.cut(images[1], ["v"], tile), 1.6), ["v"], tile).collect()}
    want = {(r.image_id, r.y, r.x): r.v for r in raster.gaussian(images[1], 1.6).collect()}
    assert found.keys() == want.keys() and max(abs(found[k] - want[k]) for k in want) < 1e-9


@pytest.mark.parametrize("tile", [11, 64])
def test_extrema_are_independent_of_tiles(spark, images, tile):
    sigmas = (1.0, 1.2, 2.2, 2.5)
    found = {(r.image_id, r.s, r.y, r.x): r.v for r in tiles.extrema(tiles.cut(images[1], ["v"], tile), sigmas, (H, W), tile).collect()}
    levels = [raster.gaussian(images[1], s) for s in sigmas]
    stack = None
    for s, (a, b) in enumerate(zip(levels, levels[1:])):
        one = raster.difference(b, a).withColumn("s", F.lit(s)).withColumn("v", F.round("v", 6))
        stack = one if stack is None else stack.unionByName(one)
    want = {(r.image_id, r.s, r.y, r.x): r.v for r in raster.extrema(stack).collect()}
    assert found.keys() == want.keys() and len(want) > 5 and all(abs(found[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.parametrize("tile", [5, 64])
def test_propagation_is_independent_of_tiles(spark, images, tile):
    target = images[0]
    y, x = np.mgrid[:H, :W]
    value = np.stack([(x * 7 + y * 13 + k * 5) % 97 for k in range(2)]).astype(float)
    rows = [(k, r, c, float(value[k, r, c]), float(target[k, r, c])) for k in range(2) for r in range(H) for c in range(W)]
    frame = spark.createDataFrame(rows, "image_id long, y long, x long, d double, g double")
    got = tiles.pixels(tiles.propagate(tiles.cut(frame, ["d", "g"], tile), 2, lambda v, data: np.abs(v - data[0]), tile), ["d", "g"], tile)
    for turn in range(4):
        before = value.copy()
        for k in range(2):
            for r in range(H):
                for c in range(W):
                    if (r + c) % 2 == turn % 2:
                        for dy, dx in tiles.NEIGHBOURS:
                            if 0 <= r + dy < H and 0 <= c + dx < W and abs(before[k, r + dy, c + dx] - target[k, r, c]) < abs(value[k, r, c] - target[k, r, c]):
                                value[k, r, c] = before[k, r + dy, c + dx]
    assert all(r.d == value[r.image_id, r.y, r.x] for r in got.collect()) and got.count() == value.size


def test_pixels_are_taken_for_as_many_as_they_are(spark, sf_dir):
    """An exploded frame passes for as small as what it came from, and all its pixels would be broadcast."""
    from parallaxis.plans import cameras, scene

    for frame in (scene.lattice(scene.cameras(spark, sf_dir), 32, 24), scene.raster(spark, sf_dir), cameras.depths(spark, sf_dir)):
        size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        assert size >= 16 * frame.count()


@pytest.mark.parametrize("gaps", [False, True])
def test_bilinear_over_tiles(spark, gaps):
    rng, w, h = random.Random(3), 70, 37
    pixels = {(i, y, x): rng.randrange(256) * 1.0 for i in range(2) for y in range(h) for x in range(w) if not gaps or rng.random() < 0.4}
    samples = [(i, x * 1.37 - 3, y * 1.21 - 2) for i in range(2) for y in range(h) for x in range(w)]
    want = {}
    for i, u, v in samples:
        cu, cv = max(0.0, min(w - 1.0, u)), max(0.0, min(h - 1.0, v))
        for dx in (0, 1):
            for dy in (0, 1):
                at = (i, min(int(cv) + dy, h - 1), min(int(cu) + dx, w - 1))
                if at in pixels:
                    share = ((cu % 1) if dx else 1 - cu % 1) * ((cv % 1) if dy else 1 - cv % 1)
                    want[i, u, v] = want.get((i, u, v), 0.0) + share * pixels[at]
    frame = spark.createDataFrame([(*k, v) for k, v in pixels.items()], "image_id long, y long, x long, v double")
    got = {(r.image_id, r.u, r.v): r.value for r in raster.bilinear(frame, spark.createDataFrame(samples, "image_id long, u double, v double"), w, h).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_band_edge_where_adding_the_width_rounds(spark):
    """SQL's bounds leave out 131072.55 against 131071.55 + 1; the distance alone, 1 less a rounding, does not."""
    a, b = 131072.55, 131071.55
    pairs = [(p, q) for p, q in ((a, b), (b, a)) if abs(p - q) < 1.0 and p > q - 1.0 and p < q + 1.0]
    assert abs(a - b) < 1.0 and len(pairs) < 2
    left = spark.createDataFrame([(1, a), (2, b)], "i long, p double")
    right = spark.createDataFrame([(1, a), (2, b)], "j long, q double")
    got = bands.band_join(left, right, "p", "q", 1.0).filter("i <> j").select("p", "q").collect()
    assert sorted((r.p, r.q) for r in got) == sorted(pairs)


def test_painted_many_batches(spark):
    """A tile whose rectangles come in several batches, under keys that are not numbers, some of them null."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", None, "b"]), x, y, x + rng.randrange(9), y + rng.randrange(9), k, None if k % 5 == 0 else rng.random()) for k in range(400) for x, y in [(rng.randrange(40), rng.randrange(40))]]
    want = {}
    for image, x0, y0, x1, y1, _, d in rows:
        for y in range(y0, min(37, y1 + 1)):
            for x in range(x0, min(41, x1 + 1)):
                want[image, y, x] = d
    frame = spark.createDataFrame(rows, "image_id string, x0 long, y0 long, x1 long, y1 long, o long, d double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {(r.image_id, r.y, r.x): r.d for r in painting.painted(frame, 41, 37, ["o"], ["d"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want
