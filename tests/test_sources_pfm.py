"""The PFM data source, orbit votes and observed statistics."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.operators import hypotheses, matching, views
from parallaxis.sources import formats, pfm, ply


def rows_of(planes):
    return [(n, p.shape[1], p.shape[0], y, x, None if np.isnan(p[y, x]) else float(p[y, x])) for n, p in planes.items() for y in range(p.shape[0]) for x in range(p.shape[1])]


@pytest.fixture(scope="module")
def planes():
    rng = np.random.default_rng(1)
    made = {f"m{k}.pfm": rng.normal(size=(rng.integers(1, 9), rng.integers(1, 12))).astype(np.float32) * np.float32(10.0) ** int(rng.integers(-30, 30)) for k in range(12)}
    made["m3.pfm"][0, 0] = np.nan
    made["odd name.pfm"] = np.array([[0.1, -0.0, 3e38], [1e-40, 2.5, 7.0]], np.float32)
    return made


def test_round_trip_is_exact(spark, planes, tmp_path):
    frame = spark.createDataFrame(rows_of(planes), "file string, width int, height int, y int, x int, depth float").repartition(7, "x")
    pfm.write(frame, f"{tmp_path}/maps")
    assert sorted(f.name for f in (tmp_path / "maps").iterdir()) == sorted(planes)
    for name, plane in planes.items():
        assert (formats.pfm_array((tmp_path / "maps" / name).read_bytes()) == np.nan_to_num(plane, nan=0.0, posinf=None)).all()
    for path in (f"{tmp_path}/maps", f"file://{tmp_path}/maps"):
        got = {(r.file, r.y, r.x): (r.width, r.height, r.depth) for r in pfm.read(spark, path).collect()}
        assert got == {(n, y, x): (w, h, None if d is None or d == 0 else d) for n, w, h, y, x, d in rows_of(planes)}
    one = spark.read.format("pfm").load(f"{tmp_path}/maps/m1.pfm")
    assert one.count() == planes["m1.pfm"].size and one.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="there already"):
        pfm.write(frame.filter("file = 'm1.pfm'"), f"{tmp_path}/maps")
    pfm.write(frame.filter("file = 'm1.pfm'").withColumn("depth", F.lit(2.0)), f"{tmp_path}/maps", "overwrite")
    assert (formats.pfm_array((tmp_path / "maps" / "m1.pfm").read_bytes()) == 2).all() and len(list((tmp_path / "maps").iterdir())) == len(planes)


def test_failed_task_leaves_no_file(spark, planes, tmp_path):
    frame = spark.createDataFrame(rows_of(planes), "file string, width int, height int, y int, x int, depth float")
    bad = frame.withColumn("file", F.when((F.col("file") == "m7.pfm"), F.lit("a/b.pfm")).otherwise(F.col("file")))
    with pytest.raises(Exception, match="not the name of a file"):
        pfm.write(bad, f"{tmp_path}/maps")
    assert not (tmp_path / "maps").exists() or list((tmp_path / "maps").iterdir()) == []
    with pytest.raises(Exception, match="do not follow|several partitions"):
        pfm.register(spark)
        frame.repartition(5, "x").write.format("pfm").mode("append").save(f"{tmp_path}/more")
    assert not (tmp_path / "more").exists() or list((tmp_path / "more").iterdir()) == []


def test_other_files_give_no_rows(spark, tmp_path):
    assert pfm.read(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "colour.pfm").write_bytes(b"PF\n1 1\n-1\n" + b"\0" * 12)
    (tmp_path / "short.pfm").write_bytes(b"Pf\n9 9\n-1.0\n" + b"\0" * 12)
    (tmp_path / "text.txt").write_bytes(b"x")
    (tmp_path / "big.pfm").write_bytes(b"Pf\n2 1\n1.0\n" + np.array([1.5, -2.0], ">f4").tobytes())
    assert [(r.file, r.y, r.x, r.depth) for r in pfm.read(spark, str(tmp_path)).orderBy("x").collect()] == [("big.pfm", 0, 0, 1.5), ("big.pfm", 0, 1, -2.0)]


def test_point_clouds(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(*map(float, rng.normal(size=3).astype(np.float32) * np.float32(1e3)), float(rng.integers(256)) / 255, 0.5, None) for _ in range(500)]
    frame = spark.createDataFrame(rows, "X double, Y double, Z double, r double, g double, b double").repartition(3)
    ply.write(frame, f"{tmp_path}/clouds")
    files = sorted(f.name for f in (tmp_path / "clouds").iterdir())
    assert len(files) == 3 and all(f.endswith(".ply") for f in files)
    got = ply.read(spark, f"file://{tmp_path}/clouds").collect()
    own = lambda x, y, z, r, g, b: (np.float32(x), np.float32(y), np.float32(z), round(r * 255), int(g * 255), int((b or 0) * 255))
    assert sorted(own(r.X, r.Y, r.Z, r.r, r.g + 1e-9, r.b) for r in got) == sorted(own(*r) for r in rows)
    assert all(sorted(r.place for r in got if r.file == f) == list(range(sum(r.file == f for r in got))) for f in files)
    with pytest.raises(Exception, match="without a coordinate"):
        ply.write(frame.withColumn("Y", F.when(F.col("X") > 0, F.col("Y"))), f"{tmp_path}/bad")
    assert not (tmp_path / "bad").exists() or list((tmp_path / "bad").iterdir()) == []
    ply.write(frame.limit(0), f"{tmp_path}/empty")
    (tmp_path / "clouds" / "mesh.ply").write_text("ply\nformat binary 1.0\nend_header\n")
    (tmp_path / "clouds" / "short.ply").write_text((tmp_path / "clouds" / files[0]).read_text()[:60])
    assert ply.read(spark, f"{tmp_path}/clouds").count() == 500 and ply.read(spark, f"{tmp_path}/empty").count() == 0


def test_orbit_votes(spark):
    """Points seen along a true orbit: both signs that turn it the right way see them, the others do not."""
    rng = np.random.default_rng(2)
    angles = {i: math.radians(10 * i) for i in range(6)}

    def seen(i, p):
        a, d = angles[i], 0.3 + 0.01 * i
        r = np.array([[-math.sin(a), math.cos(a), 0], [0, 0, -1], [-math.cos(a), -math.sin(a), 0]])
        x = r @ p + [0, 0, d]
        return 2000 * x[0] / x[2] + 640, 2000 * x[1] / x[2] + 480

    matches = [(i, i + 1, k, *map(float, seen(i, p)), *map(float, seen(i + 1, p))) for i in range(5) for k, p in enumerate(rng.normal(size=(12, 3)) * 0.03)]
    frame = spark.createDataFrame(matches, "i long, j long, kp long, ui double, vi double, uj double, vj double")
    orbit = spark.createDataFrame([(i, a, 0.3 + 0.01 * i) for i, a in angles.items()], "image_id long, angle double, distance double")
    first = hypotheses.tested(frame, "i", "kp")
    assert first.count() == 50 and first.agg(F.max("kp")).first()[0] == 9
    assert sorted(r.i for r in hypotheses.tested(frame, "i", "kp", enough=15).select("i").distinct().collect()) == [0, 1]
    got = {r.config: (r.axis, r.direction, r.tested, r.good) for r in hypotheses.orbit_votes(first.drop("kp"), orbit, 2000.0, 640.0, 480.0).collect()}
    assert [got[k][:3] for k in range(4)] == [(*c, 50) for c in hypotheses.CONFIGS]
    assert got[0][3] == got[3][3] == 50 and got[1][3] == got[2][3] < 50
    none = {r.config: (r.tested, r.good) for r in hypotheses.orbit_votes(first.drop("kp").limit(0), orbit, 2000.0, 640.0, 480.0).collect()}
    assert none == {k: (0, 0) for k in range(4)}


def test_statistics_come_with_the_table(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 1, 30), (0, 2, 50), (1, 2, 41)], "image_i long, image_j long, num_inliers long")
    group = "observed-stats"
    made, stats = matching.observed(pairs)
    spark.sparkContext.setJobGroup(group, group)
    made.write.parquet(f"{tmp_path}/pairs")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert stats.get == {"pairs": 3, "inliers": 121, "fewest": 30, "most": 50}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == jobs == 1
    none, stats = matching.observed(pairs.limit(0))
    none.collect()
    assert stats.get == {"pairs": 0, "inliers": None, "fewest": None, "most": None}


def test_two_best_with_ties(spark):
    """Ties go to the lower id, over blocks of any size; one descriptor has no second."""
    rows = [(0, 5, [0.0, 0.0]), (0, 2, [3.0, 4.0])] + [(1, k, [3.0, 4.0] if k % 2 else [0.0, 1.0]) for k in range(9)] + [(2, 7, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "image_id int, kp_id long, descriptor array<float>")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "image_q long, image_r long")
    for block in (2, 100):
        got = {(r.image_r, r.kp_q): (r.idx1, r.dist1, r.idx2, r.dist2) for r in matching.knn2(matching.packed(frame, block), pairs).collect()}
        assert got == {(1, 5): (0, 1.0, 2, 1.0), (1, 2): (1, 0.0, 3, 0.0), (2, 5): (7, 2.0, -1, matching.NO_SECOND), (2, 2): (7, 13.0, -1, matching.NO_SECOND)}


def test_neighbours_within_ids(spark):
    frame = spark.createDataFrame([(0,), (3,), (9,)], "image_id long")
    got = {(r.image_id, r.other) for r in views.neighbours(frame, 9, 2, ids=(0, 9)).collect()}
    assert got == {(0, 1), (0, 2), (0, 7), (0, 8), (0, 9), (3, 1), (3, 2), (3, 4), (3, 5), (9, 0), (9, 1), (9, 2), (9, 7), (9, 8)}


def test_small_files_share_a_partition(tmp_path):
    for k in range(300):
        (tmp_path / f"d{k:03}.pfm").write_bytes(b"Pf\n2 1\n-1.0\n" + b"\0" * 8)
    parts = pfm._Reader(str(tmp_path)).partitions()
    assert sum(len(p.paths) for p in parts) == 300 and len(parts) == 1
    with open(tmp_path / "d150.pfm", "ab") as large:
        large.truncate(pfm.PARTITION_BYTES)
    assert sorted(len(p.paths) for p in pfm._Reader(str(tmp_path)).partitions()) == [1, 149, 150]
    assert [p.paths for p in pfm._Reader(str(tmp_path / "none")).partitions()] == [[]]


def test_ranking_two_full_blocks_holds_one_product():
    """Peak beyond the product of two blocks, 33 MB: strips of it, not copies."""
    import tracemalloc

    import pyarrow as pa

    rng, kps = np.random.default_rng(0), np.arange(matching.BLOCK).astype("<i8").tobytes()
    mats = [rng.random((matching.BLOCK, 16), np.float32).tobytes() for _ in "qr"]
    row = pa.RecordBatch.from_pydict({"image_q": [0], "image_r": [1], "kps_q": [kps], "kps_r": [kps], "mat_q": mats[:1], "mat_r": mats[1:], "kind_q": ["<f4"], "kind_r": ["<f4"]})
    tracemalloc.start()
    assert [b.num_rows for b in matching._ranked(True)(iter([row]))] == [matching.BLOCK] * 2
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6


def test_covisibility_gathers_no_lists(spark):
    """Images of a point meet in a join, repeated ones once; null points and images pair with nothing, as in SQL."""
    rows = [(1, 0), (1, 1), (1, 1), (1, 2), (2, 0), (2, 1), (3, 5), (None, 7), (None, 8), (4, None), (4, 6)]
    found = views.covisibility(spark.createDataFrame(rows, "point_id long, image_id long"))
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(0, 1, 2), (0, 2, 1), (1, 2, 1)]
