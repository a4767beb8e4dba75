"""Sources, sinks and solvers on scenes whose answers are known."""

from __future__ import annotations

import itertools
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.model import Config
from parallaxis.operators import epipolar, features, geometry, matching, mvs
from parallaxis.sources import formats, images, synthetic
from parallaxis.streaming import captures


def exif_jpeg(order="<", make=b"Apple\0", model=b"iPhone 13\0", orientation=6, focal=(26, 5)):
    """A JPEG head with one APP1 block; strings of more than four bytes lie behind the directory."""
    mark = {"<": b"II", ">": b"MM"}[order]
    entries, extra, base = [], b"", 8 + 2 + 4 * 12 + 4
    for tag, text in ((0x010F, make), (0x0110, model)):
        entries.append(struct.pack(order + "HHII", tag, 2, len(text), base + len(extra)) if len(text) > 4 else struct.pack(order + "HHI", tag, 2, len(text)) + text.ljust(4, b"\0"))
        extra += text if len(text) > 4 else b""
    entries.append(struct.pack(order + "HHIHH", 0x0112, 3, 1, orientation, 0))
    sub = base + len(extra)
    entries.append(struct.pack(order + "HHII", 0x8769, 4, 1, sub))
    extra += struct.pack(order + "HHHII", 1, 0x920A, 5, 1, sub + 18) + b"\0\0\0\0" + struct.pack(order + "II", *focal)
    tiff = mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 4) + b"".join(entries) + b"\0\0\0\0" + extra
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    assert images.parse_exif(exif_jpeg(order)) == {"focal_mm": 5.2, "make": "Apple", "model": "iPhone 13", "orientation": 6, "valid": True}
    assert images.parse_exif(exif_jpeg(order, make=b"LG\0\0", focal=(1, 0))) | {"model": ""} == {"focal_mm": 0.0, "make": "LG", "model": "", "orientation": 6, "valid": True}
    for bad in (None, b"", b"\x89PNG" + b"0" * 20, exif_jpeg(order)[:40], exif_jpeg(order).replace(b"Apple\0", b"Apple\0")[:60]):
        assert not images.parse_exif(bad)["valid"]


def test_scan_directory(spark, tmp_path):
    for name, data in (("b.JPG", exif_jpeg()), ("a.png", b"x"), ("c.txt", b"y"), ("d.jpeg", b"\xff\xd8")):
        (tmp_path / name).write_bytes(data)
    got = {r.filename: (r.image_id, r.exif.make, r.exif.valid) for r in images.with_exif(images.scan_directory(spark, str(tmp_path))).collect()}
    assert got == {"a.png": (0, "", False), "b.JPG": (1, "Apple", True), "d.jpeg": (2, "", False)}
    assert images.scan_directory(spark, str(tmp_path / "missing")).count() == 0


def test_stream_of_captures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(exif_jpeg())
    query = captures.captures_by_camera(captures.arriving_images(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("captures").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert query.awaitTermination(60)
    assert [(r.make, r.captures) for r in spark.table("captures").collect()] == [("Apple", 1)]


def test_pfm(spark, tmp_path):
    plane = np.arange(12, dtype=np.float32).reshape(3, 4) / 7
    assert (formats.pfm_array(formats.pfm_bytes(plane)) == plane).all()
    assert formats.pfm_array(b"PF\n1 1\n-1\n" + b"\0" * 12) is None and formats.pfm_array(b"x") is None
    big = b"Pf\n4 3\n1.0\n" + plane[::-1].astype(">f4").tobytes()
    assert (formats.pfm_array(big) == plane).all()
    (tmp_path / "v.pfm").write_bytes(formats.pfm_bytes(plane))
    rows = formats.read_pfm(spark, str(tmp_path)).collect()
    assert {(r.y, r.x): r.depth for r in rows} == {(y, x): (None if plane[y, x] == 0 else plane[y, x]) for y in range(3) for x in range(4)}
    frame = spark.createDataFrame([(7, 4, 3, y, x, float(plane[y, x])) for y in range(3) for x in range(4)], "image_id long, width int, height int, y int, x int, depth float")
    assert formats.write_pfm(frame, str(tmp_path / "out")).first().pfm == formats.pfm_bytes(plane)


def test_mesh_and_cloud_text(spark):
    vertices, faces = synthetic.sphere_vertices(spark), synthetic.sphere_faces(spark)
    assert (vertices.count(), faces.count()) == (1986, 3968)
    v, f = formats.parse_obj(formats.obj_lines(vertices, faces))
    assert v.count() == 1986 and f.exceptAll(faces.select("v0", "v1", "v2")).count() == 0
    header, lines = formats.ply_lines(spark.createDataFrame([(1.0, 2.5, -3.0, 1.0, 0.5, 0.0)], "X double, Y double, Z double, r double, g double, b double"))
    assert "element vertex 1" in header and lines.first().value == "1.00000 2.50000 -3.00000 255 127 0"
    assert len(formats.stl_triangle(*np.eye(3))) == 50


def test_checkpoint(spark, tmp_path):
    rows = [(0, [1.0] * 9, [0.0] * 3, True), (1, [2.0] * 9, [1.0] * 3, False)]
    cams = spark.createDataFrame(rows, "image_id int, R array<double>, t array<double>, is_registered boolean")
    (tmp_path / "c.json").write_text(formats.checkpoint_json(cams, {"num_registered": 1}))
    back = formats.read_checkpoint(spark, str(tmp_path / "c.json"), "image_id:int,R:array<double>,t:array<double>,is_registered:boolean")
    assert {r.image_id: (r.R, r.is_registered) for r in back.collect()} == {0: ([1.0] * 9, True), 1: (None, False)}


def test_presets():
    assert Config(quality="low").preset().max_image_size == 1600
    assert Config(quality="low", max_image_size=99).preset(frozenset({"max_image_size"})).max_image_size == 99
    assert Config(quality="nope").preset() == Config(quality="nope")


def scene(seed=0, n=80, cameras=4):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 3))
    k = np.array([[800.0, 0, 320], [0, 800.0, 240], [0, 0, 1]])
    poses = [(epipolar.rotation(np.array([0.02 * c, 0.15 * c, 0.01 * c])), np.array([-0.6 * c, 0.05 * c, 6.0])) for c in range(cameras)]
    pixels = []
    for r, t in poses:
        p = (x @ r.T + t) @ k.T
        pixels.append(p[:, :2] / p[:, 2:])
    return x, k, poses, pixels


def test_fundamental_and_pose(spark):
    x, k, poses, px = scene()
    rng = np.random.default_rng(1)
    a, b = px[0] + rng.normal(0, 0.2, px[0].shape), px[1] + rng.normal(0, 0.2, px[1].shape)
    b[:20] = rng.uniform(0, 640, (20, 2))
    f, inside = epipolar.ransac_fundamental(a, b)
    assert inside[20:].all() and inside[:20].sum() <= 4 and epipolar.epipolar_distance(f, a[20:], b[20:]).max() < 3
    assert epipolar.ransac_fundamental(a[:7], b[:7])[0] is None
    rays = [(np.column_stack([p, np.ones(len(p))]) @ np.linalg.inv(k).T)[20:, :2] for p in (a, b)]
    r, t, good = epipolar.relative_pose(epipolar.essential(f, k, k), *rays)
    rel = poses[1][0] @ poses[0][0].T
    want = poses[1][1] - rel @ poses[0][1]
    assert good == 60 and np.degrees(np.arccos((np.trace(r @ rel.T) - 1) / 2)) < 2 and t @ want / np.linalg.norm(want) > 0.99
    rows = [(0, 1, i, i, *map(float, a[i]), *map(float, b[i])) for i in range(len(a))] + [(1, 2, i, i, 0.0, 0.0, 0.0, 0.0) for i in range(5)]
    frame = spark.createDataFrame(rows, "image_i long, image_j long, kp_i long, kp_j long, xi double, yi double, xj double, yj double")
    got = epipolar.verify_pairs(frame).collect()
    assert {r.image_i for r in got} == {0} and len(got) >= 60


def test_triangulation_and_absolute_pose():
    x, k, poses, px = scene()
    p = np.stack([k @ np.column_stack(pose) for pose in poses])
    centres = np.array([-r.T @ t for r, t in poses])
    for i in range(len(x)):
        seen = np.stack([c[i] for c in px])
        got = epipolar.triangulate(p, seen)
        assert np.allclose(got, x[i], atol=1e-6) and epipolar.accepted(got, p, seen, centres.copy())
        assert not epipolar.accepted(got, p, seen + 9, centres.copy())
    noisy = px[2] + np.random.default_rng(3).normal(0, 0.3, px[2].shape)
    noisy[:15] = 0
    r, t, inside = epipolar.absolute_pose(x, noisy, k)
    assert inside[15:].all() and not inside[:15].any() and np.allclose(r, poses[2][0], atol=0.01) and np.allclose(t, poses[2][1], atol=0.05)


def test_bundle_adjustment(spark):
    x, k, poses, px = scene(n=40)
    rng = np.random.default_rng(5)
    n, c = len(x), len(poses)
    cam_of, point_of = np.repeat(np.arange(c), n), np.tile(np.arange(n), c)
    start = [poses[0], *((epipolar.rotation(rng.normal(0, 0.01, 3)) @ r, t + rng.normal(0, 0.02, 3)) for r, t in poses[1:])]
    moved, y, cost = epipolar.adjust(start, x + rng.normal(0, 0.02, x.shape), cam_of, point_of, np.concatenate(px), k)
    error = [np.linalg.norm((q := (y @ r.T + t) @ k.T)[:, :2] / q[:, 2:] - s, axis=1).mean() for (r, t), s in zip(moved, px)]
    assert max(error) < 0.05 and cost < 1 and (moved[0][1] == poses[0][1]).all()
    rows = [(i, *map(float, x[i] + 0.01), *map(float, px[j][i]), *map(float, poses[j][0].ravel()), *map(float, poses[j][1])) for i in range(6) for j in range(c)]
    names = ["point_id", "x", "y", "z", "u", "v", *geometry.R, *geometry.T]
    got = epipolar.adjust_points(spark.createDataFrame(rows, names), 800.0, 320.0, 240.0).collect()
    assert all(np.allclose([r.x, r.y, r.z], x[r.point_id], atol=1e-4) for r in got) and len(got) == 6


def test_umeyama():
    rng = np.random.default_rng(6)
    a, r = rng.normal(size=(20, 3)), epipolar.rotation(np.array([0.3, -0.5, 1.0]))
    s, q, t = epipolar.umeyama(a, 2.5 * a @ r.T + [1, 2, 3])
    assert np.isclose(s, 2.5) and np.allclose(q, r) and np.allclose(t, [1, 2, 3])


def blobs(shift=(0.0, 0.0), turn=0.0, size=96):
    rng = np.random.default_rng(9)
    yy, xx = np.mgrid[:size, :size].astype(float)
    c, s = np.cos(turn), np.sin(turn)
    out = np.full((size, size), 0.4)
    for _ in range(28):
        y, x, w, h = *rng.uniform(14, size - 14, 2), rng.uniform(2, 5), rng.choice([-0.4, 0.5])
        dy, dx = y - size / 2, x - size / 2
        y, x = size / 2 + c * dy + s * dx + shift[0], size / 2 - s * dy + c * dx + shift[1]
        out += h * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * w * w))
    return np.clip(out, 0, 1)


def test_features_match_after_a_shift(spark):
    planes = [blobs(), blobs((3.0, 5.0))]
    rows = [(k, 96, 96, p.astype("<f4").tobytes()) for k, p in enumerate(planes)] + [(2, 0, 0, None)]
    found = features.detect_all(spark.createDataFrame(rows, "image_id long, width int, height int, gray binary"))
    local = found.toPandas()
    assert (local.groupby("image_id").size() >= 15).all() and set(local.image_id) == {0, 1}
    assert local.descriptor.map(lambda d: len(d) == 128 and max(d) <= 255).all() and ((local.angle >= 0) & (local.angle < 360.01)).all()
    pairs = spark.createDataFrame([(0, 1)], "image_i long, image_j long")
    matched = matching.match_pairs(found, pairs).toPandas().merge(local[local.image_id == 0], left_on="kp_i", right_on="kp_id").merge(local[local.image_id == 1], left_on="kp_j", right_on="kp_id", suffixes=("", "_j"))
    right = (np.hypot(matched.x_j - matched.x - 5, matched.y_j - matched.y - 3) < 1).mean()
    assert len(matched) >= 8 and right > 0.8
    assert len(features.detect(planes[0], most=5)) == 5


def test_patchmatch_on_a_slanted_plane(spark):
    h, w = 36, 48
    k = np.array([[60.0, 0, 24], [0, 60.0, 18], [0, 0, 1]])
    rng = np.random.default_rng(2)
    texture = features.smooth(rng.uniform(0, 1, (200, 200)), 1.2)
    texture = (texture - texture.min()) / np.ptp(texture)
    normal, offset = np.array([0.2, 0.0, -1.0]), -2.0  # n . X = offset

    def view(t):
        yy, xx = np.mgrid[:h, :w].astype(float)
        rays = np.stack([xx, yy, np.ones_like(xx)], -1) @ np.linalg.inv(k).T
        centre = -np.array(t)
        depth = (offset - normal @ centre) / (rays @ normal)
        at = centre + rays * depth[..., None]
        return mvs.View(mvs.sample(texture, at[..., 0] * 55 + 100, at[..., 1] * 55 + 100), k, np.eye(3), np.array(t)), depth

    (ref, depth), *others = [view(t) for t in ([0.0, 0, 0], [-0.15, 0, 0], [0.15, 0.05, 0])]
    d, n, conf = mvs.estimate(ref, [v for v, _ in others], 1.2, 3.5, iterations=4, radius=3)
    inner = np.s_[5:-5, 8:-8]
    assert (np.abs(d - depth)[inner] / depth[inner] < 0.05).mean() > 0.8 and d.min() >= 1.2 and d.max() <= 3.5
    assert np.allclose(np.linalg.norm(n, axis=-1), 1) and (conf >= 0).all() and (conf <= 1).all()
    pack = lambda v: {"gray": v.gray.astype("<f4").tobytes(), "k": k.ravel().tolist(), "r": np.eye(3).ravel().tolist(), "t": v.t.tolist()}
    jobs = spark.createDataFrame([(3, w, h, 1.2, 3.5, [pack(ref), pack(others[0][0])]), (4, w, h, 1.2, 3.5, [pack(ref)])], "image_id long, width int, height int, low double, high double, views array<struct<gray:binary,k:array<double>,r:array<double>,t:array<double>>>")
    got = mvs.depth_maps(jobs, iterations=1, radius=2)
    assert got.groupBy("image_id").agg(F.count("*").alias("n")).collect() == [(3, h * w)]


def test_reconstruction_recovers_the_ring(spark):
    from parallaxis.operators import sfm
    from parallaxis.plans import solvers

    got = {r.image_id: (np.reshape(r.R, (3, 3)), np.array(r.t)) for r in solvers.reconstructed(solvers.sightings(spark).filter("kp_id % 7 = 0 and image_id < 12")).collect()}
    truth = {r.image_id: (np.array([r[c] for c in geometry.R]).reshape(3, 3), np.array([r[c] for c in geometry.T])) for r in synthetic.ring_cameras(spark).collect()}
    assert set(got) == set(range(12))
    a = np.array([-r.T @ t for r, t in (got[i] for i in range(12))])
    b = np.array([-r.T @ t for r, t in (truth[i] for i in range(12))])
    s, q, t = epipolar.umeyama(a, b)
    assert np.linalg.norm(s * a @ q.T + t - b, axis=1).max() < 0.05 * 0.5
    for i in range(12):
        cos = (np.trace(got[i][0] @ q.T @ truth[i][0].T) - 1) / 2
        assert np.degrees(np.arccos(np.clip(cos, -1, 1))) < 2
    assert np.allclose(np.linalg.norm(sfm.on_circle(b + 0.001 * np.sin(np.arange(36).reshape(12, 3))) - b, axis=1), 0, atol=0.003)
    assert (sfm.on_circle(b[:3]) == b[:3]).all() and sfm.reconstruct({0: b[:, :2]}, {}, np.eye(3)).poses == {}


def test_solver_queries_against_the_tables(spark, sf_dir):
    from parallaxis.plans import scene, solvers

    part = {r.v_id: np.array([r.x, r.y, r.z]) for r in scene.points(spark, sf_dir).collect()}
    found = solvers.triangulate(spark, sf_dir).collect()
    assert len(found) > 150 and all(np.linalg.norm(part[r.point_id] - [r.x, r.y, r.z]) < 2e-3 for r in found if r.ok) and sum(r.ok for r in found) > 50
    sees = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").collect():
        sees.setdefault(r.l_suppkey, set()).add(r.l_partkey)
    pairs = solvers.fundamental_ransac(spark, sf_dir).collect()
    assert {(r.image_i, r.image_j) for r in pairs} == {(i, i + 1) for i in range(len(sees) - 1)} and all(r.kp_i == r.kp_j and r.kp_i in sees[r.image_i] & sees[r.image_j] for r in pairs)
    assert {r.image_id for r in solvers.sift_cuda(spark, sf_dir).collect()} <= set(sees)


def test_depth_maps_of_some_views(spark):
    from parallaxis.plans import solvers

    maps = solvers.mvs_ring(spark, "", "image_id < 8", iterations=3).toPandas()
    near = maps[maps.y.between(14, 22) & maps.x.between(18, 30)]
    assert near.depth.between(0.19, 0.24).mean() > 0.8 and set(maps.image_id) <= set(range(8)) and maps.image_id.nunique() > 3


def test_views_are_dealt_over_tasks(spark):
    from parallaxis.operators import mvs

    jobs = spark.range(40).selectExpr("id as image_id", "4 width", "3 height", "1.0D low", "2.0D high", "cast(array() as array<struct<gray:binary,k:array<double>,r:array<double>,t:array<double>>>) views")
    plan = mvs.depth_maps(jobs)
    assert plan.count() == 0 and plan.rdd.getNumPartitions() == 40


def shared_points(spark, sf_dir):
    """{(image, other image): points that both see}, by brute force, of a table of a hundred images."""
    seen = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect():
        seen.setdefault(r.l_orderkey, set()).add(r.l_suppkey)
    return Counter(p for s in seen.values() for p in itertools.permutations(s, 2))


def test_top_sources_of_all_images(spark):
    from parallaxis.plans import matching as plans

    sf_dir = "/root/testdata/sf0.01"
    of = {}
    for (i, j), n in shared_points(spark, sf_dir).items():
        of.setdefault(i, []).append((-n, j))
    assert len(of) == 100
    want = {(i, j, -n, rank) for i, rows in of.items() for rank, (n, j) in enumerate(sorted(rows)[:5], 1)}
    assert sorted(map(tuple, plans.topn_sources(spark, sf_dir).collect())) == sorted(want)


def test_source_candidates_of_all_images(spark):
    from parallaxis.plans import matching as plans

    sf_dir = "/root/testdata/sf0.01"
    degrees = lambda i, j: abs(i - j) * 7 % 120
    want = {(i, j): (n, np.sin(np.radians(min(30, degrees(i, j)))) * n) for (i, j), n in shared_points(spark, sf_dir).items() if 5 <= degrees(i, j) <= 90}
    got = {(r.ref_id, r.src_id): (r.shared, r.score) for r in plans.source_candidates(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and len({i for i, _ in got}) == 100
    assert all(got[p][0] == n and abs(got[p][1] - score) < 1e-6 for p, (n, score) in want.items())


def test_turntable_repair():
    from parallaxis.operators import sfm, turntable

    rng = np.random.default_rng(4)
    n, k = 12, np.array([[800.0, 0, 320], [0, 800.0, 240], [0, 0, 1]])
    x = rng.normal(0, 0.25, (120, 3))
    truth = {}
    for i in range(n):
        a = 2 * np.pi * i / n
        c = 3 * np.array([np.cos(a), np.sin(a), 0.15])
        fwd = -c / np.linalg.norm(c)
        right = np.cross(fwd, [0, 0, 1])
        right /= np.linalg.norm(right)
        r = np.stack([right, np.cross(fwd, right), fwd])
        truth[i] = (r, -r @ c)
    keypoints = {i: (q := (x @ r.T + t) @ k.T)[:, :2] / q[:, 2:] for i, (r, t) in truth.items()}
    matches = {(i, j): [(m, m) for m in range(120)] for i in range(n) for j in range(i + 1, n) if min(j - i, n - j + i) <= 2}
    scene = sfm.Scene(keypoints, k, dict(truth))
    assert not turntable.disambiguate(scene, matches, 0) and scene.poses == truth
    scene = sfm.Scene(keypoints, k, {i: truth[i % 6] for i in range(n)})
    assert turntable.disambiguate(scene, matches, 0) and len(scene.points) > 100
    assert all(np.allclose(scene.poses[i][0], truth[i][0], atol=0.02) for i in range(n))


def test_reconstruction_repairs_repeated_texture():
    from parallaxis.operators import sfm, turntable

    rng = np.random.default_rng(4)
    n, k = 12, np.array([[800.0, 0, 320], [0, 800.0, 240], [0, 0, 1]])
    x = rng.normal(0, 0.25, (120, 3))
    truth = []
    for a in 2 * np.pi * np.arange(n) / n:
        c = 3 * np.array([np.cos(a), np.sin(a), 0.15])
        fwd = -c / np.linalg.norm(c)
        right = np.cross(fwd, [0, 0, 1])
        right /= np.linalg.norm(right)
        r = np.stack([right, np.cross(fwd, right), fwd])
        truth.append((r, -r @ c))
    looks = [(q := (x @ r.T + t) @ k.T)[:, :2] / q[:, 2:] for r, t in truth]
    matches = {(i, j): [(m, m) for m in range(120)] for i in range(n) for j in range(i + 1, n)}
    # the far side looks like the near one
    scene = sfm.reconstruct({i: looks[i % 6] for i in range(n)}, matches, k)
    turned = [scene.poses[i][0] @ scene.poses[0][0].T for i in range(n)]
    assert all(np.allclose(q, truth[i][0] @ truth[0][0].T, atol=0.1) for i, q in enumerate(turned))
    assert turntable.duplicates(turntable.angles(scene, 0, turntable.orbit_axis(scene, 0)), n) == 0
    noisy = {i: p + rng.normal(0, 0.5, p.shape) for i, p in enumerate(looks)}
    centres = [np.array([s.centre(i) for i in range(n)]) for s in (sfm.reconstruct(noisy, matches, k, turntable=flag) for flag in (False, True))]
    off = [np.abs(sfm.on_circle(c) - c).max() for c in centres]
    assert off[0] > 1e-5 and off[1] < 1e-9


def test_reconstruction_of_the_whole_ring(spark):
    from parallaxis.plans import solvers

    got = {r.image_id: (np.reshape(r.R, (3, 3)), np.array(r.t), r.points) for r in solvers.sfm_ring(spark, "").collect()}
    truth = {r.image_id: (np.array([r[c] for c in geometry.R]).reshape(3, 3), np.array([r[c] for c in geometry.T])) for r in synthetic.ring_cameras(spark).collect()}
    assert set(got) == set(truth) == set(range(36)) and got[0][2] > 1500
    a, b = (np.array([-p[i][0].T @ p[i][1] for i in range(36)]) for p in (got, truth))
    s, q, t = epipolar.umeyama(a, b)
    assert np.linalg.norm(s * a @ q.T + t - b, axis=1).max() < 0.05 * 0.5


def test_command_line(capsys):
    from parallaxis import cli

    made = cli.parse("-i a -o b.obj --quality low --poisson-depth 11 --turntable".split())
    assert (made.max_image_size, made.poisson_depth, made.turntable) == (1600, 11, True)
    for argv, code in (([], 0), (["-h"], 0), (["-i", "a"], 1), (["--nope"], 1), (["-i", "a", "-o", "b", "--gpu"], 1)):
        with pytest.raises(SystemExit) as stop:
            cli.parse(argv)
        assert stop.value.code == code


def png(spark, path, plane):
    """Writes rows x columns x (red, green, blue) through the JVM."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(plane.shape[1], plane.shape[0], 1)
    for y, row in enumerate(plane.tolist()):
        for x, (r, g, b) in enumerate(row):
            image.setRGB(x, y, r << 16 | g << 8 | b)
    assert jvm.javax.imageio.ImageIO.write(image, "png", jvm.java.io.File(str(path)))


def test_images_as_they_are_shown(spark, tmp_path, monkeypatch, caplog):
    rng = np.random.default_rng(1)
    planes = {"b.png": rng.integers(0, 256, (4, 8, 3)), "d.png": rng.integers(0, 256, (2, 3, 3))}
    for name, plane in planes.items():
        png(spark, tmp_path / name, plane)
    (tmp_path / "a.jpg").write_bytes(exif_jpeg())  # a head without pixels: undecodable, so its id stays a gap
    (tmp_path / "c.txt").write_bytes(b"not an image")
    got = {r.filename: r for r in images.load_images(spark, str(tmp_path)).collect()}
    assert {n: r.image_id for n, r in got.items()} == {"b.png": 1, "d.png": 2} and "too few" in caplog.text
    r = got["b.png"]
    assert (r.width, r.height) == (8, 4) and (np.frombuffer(r.bgr, np.uint8).reshape(4, 8, 3)[..., ::-1] == planes["b.png"]).all()
    want = np.rint(planes["b.png"] @ np.array([0.299, 0.587, 0.114])) / 255
    assert np.allclose(np.frombuffer(r.gray, "<f4").reshape(4, 8), want) and np.allclose(r.K, [28 / 36 * 8, 0, 4, 0, 28 / 36 * 8, 2, 0, 0, 1])
    half = {r.filename: r for r in images.load_images(spark, str(tmp_path), max_size=4, focal_mm=4, sensor_mm=6).collect()}["b.png"]
    mean = planes["b.png"].reshape(2, 2, 4, 2, 3).mean((1, 3))
    assert (half.width, half.height) == (4, 2) and np.abs(np.frombuffer(half.bgr, np.uint8).reshape(2, 4, 3)[..., ::-1] - mean).max() <= 0.5
    assert half.K[0] == 4 * 4 / 6 and images.load_images(spark, str(tmp_path / "none")).count() == 0
    blue = np.zeros((2, 4, 3), np.uint8)
    blue[0, 0] = 255
    for turn, shape, at in ((6, (4, 2), (0, 1)), (3, (2, 4), (1, 3)), (8, (4, 2), (3, 0)), (5, (4, 2), (0, 0)), (7, (4, 2), (3, 1)), (2, (2, 4), (0, 3)), (4, (2, 4), (1, 0)), (1, (2, 4), (0, 0))):
        turned = images.shown(blue, turn)
        assert turned.shape[:2] == shape and tuple(np.argwhere(turned[..., 0] == 255)[0]) == at


def test_meshes_as_files(spark, tmp_path):
    vertices, faces = synthetic.sphere_vertices(spark, 4, 6), synthetic.sphere_faces(spark, 4, 6)
    n = faces.count()
    assert formats.write_stl(vertices, faces, f"file://{tmp_path}/m.stl") == n
    data = (tmp_path / "m.stl").read_bytes()
    assert len(data) == 84 + 50 * n and struct.unpack_from("<I", data, 80)[0] == n
    normal, corner = np.array(struct.unpack_from("<6f", data, 84 + 50 * 7)).reshape(2, 3)
    assert np.isclose(np.linalg.norm(normal), 1) and normal @ corner > 0
    header, lines = formats.ply_mesh_lines(vertices, faces)
    assert f"element face {n}" in header and lines.count() == n + vertices.count() and lines.collect()[-1].value.startswith("3 ")
    assert formats.write_checkpoints(False, "x/y.obj", {"v": vertices}) == formats.write_checkpoints(True, "", {"v": vertices}) == []
    (path,) = formats.write_checkpoints(True, f"{tmp_path}/out.obj", {"v": vertices})
    assert spark.read.parquet(path).count() == vertices.count()
    (tmp_path / "gt.json").write_text('{"cameras": [{"image": "v.jpg", "angle_deg": 19.6, "R": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "t": [0, 0, 1], "center": [0, 0, -1]}]}')
    true = formats.read_true_cameras(spark, str(tmp_path / "gt.json")).first()
    assert (true.image_id, true.R[4], true.center) == (2, 1.0, [0.0, 0.0, -1.0])


def test_points_side_by_side():
    x, k, poses, px = scene(n=30)
    rng = np.random.default_rng(8)
    of = np.concatenate([np.repeat(i, 2 + i % 3) for i in range(30)])
    cam = np.concatenate([np.arange(2 + i % 3) for i in range(30)])
    r, t = np.array([poses[c][0] for c in cam]), np.array([poses[c][1] for c in cam])
    seen = np.array([px[c][i] for c, i in zip(cam, of)]) + rng.normal(0, 0.3, (len(of), 2))
    p = k @ np.concatenate([r, t[:, :, None]], 2)
    many = epipolar.triangulate_many(of, 30, p, seen)
    centres = -np.einsum("mji,mj->mi", r, t)
    ok = epipolar.accepted_many(many, of, p, seen, centres, 0.4, 5.0)
    moved = epipolar.adjust_many(many + 0.05, of, r, t, seen, k)
    for i in range(30):
        own = of == i
        one = epipolar.triangulate(p[own], seen[own])
        assert np.allclose(many[i], one) and ok[i] == epipolar.accepted(one, p[own], seen[own], centres[own], 0.4, 5.0)
        n = own.sum()
        best = epipolar.adjust(list(zip(r[own], t[own])), [many[i] + 0.05], np.arange(n), np.zeros(n, int), seen[own], k, fix_cameras=True)[1]
        assert np.allclose(moved[i], best[0], atol=1e-3)
    assert 0 < ok.sum() < 30


def test_new_points_as_a_scan_makes_them(spark):
    from parallaxis.operators import sizes, views

    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), int(c) + 9, int(d), k) for k, (a, b, c, d) in enumerate(rng.integers(0, 9, (300, 4)))]
    tracked = {(0, k) for k in range(4)}
    used, want = set(tracked), []
    for i, p, j, q, k in rows:
        if (i, p) not in used and (j, q) not in used:
            used |= {(i, p), (j, q)}
            want.append(k)
    matches = spark.createDataFrame(rows, "image_i long, kp_i long, image_j long, kp_j long, place long")
    got = views.grown(matches, spark.createDataFrame(sorted(tracked), "image_id long, kp_id long"))
    assert sorted(r.place for r in got.collect()) == want
    placed = sizes.numbered(matches.select("place"), "place", rows=20)
    assert all(r.place == r.position for r in placed.collect()) and placed.count() == 300


def test_point_filter_rounds(spark):
    points = spark.createDataFrame([(k, float(k)) for k in range(30)], "point_id long, x double")
    scored = lambda p: p.select("point_id", (F.col("x") / 10).alias("mean_error"), F.when(F.col("point_id") == 3, 1).otherwise(5).alias("track"))
    kept = geometry.filter_rounds(points, scored, adjusted=lambda p: p.withColumn("x", F.col("x") - 1))
    assert sorted(r.point_id for r in kept.collect()) == [k for k in range(11) if k != 3]


def test_extrema_by_definition(spark):
    from parallaxis.operators import raster

    v = np.random.default_rng(4).integers(0, 40, (4, 9, 11)).astype(float)
    stack = spark.createDataFrame([(0, s, y, x, float(v[s, y, x])) for s, y, x in np.ndindex(v.shape)], "image_id int, s int, y int, x int, v double")
    want = set()
    for s, y, x in itertools.product(range(1, 3), range(1, 8), range(1, 10)):
        near = np.delete(v[s - 1 : s + 2, y - 1 : y + 2, x - 1 : x + 2].ravel(), 13)
        if v[s, y, x] > near.max() or v[s, y, x] < near.min():
            want.add((s, y, x))
    assert {(r.s, r.y, r.x) for r in raster.extrema(stack).collect()} == want and len(want) > 5
