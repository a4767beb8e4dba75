import numpy as np

from parallaxis.operators import geometry, hypotheses
from parallaxis.operators import matching as matchers
from parallaxis.plans import matching, scene


def test_lattice_deals_more_images_into_more_tasks(spark, monkeypatch):
    images = spark.range(40).withColumnRenamed("id", "image_id")
    monkeypatch.setattr(scene, "TASK_PIXELS", 24)
    dealt = scene.lattice(images, 4, 3)
    assert dealt.rdd.getNumPartitions() == 20 and dealt.distinct().count() == 40 * 12
    assert scene.lattice(images.limit(1), 4, 3).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_begun_pairs_are_those_that_are_tested(spark):
    rows = [(p, k) for p in range(40) for k in range((p * 7) % 15)]
    matches = spark.createDataFrame(rows, "p long, k long").repartition(5)
    for each, enough in ((10, 100), (3, 5), (1, 1), (20, 10**6)):
        tested = {r.p for r in hypotheses.tested(matches, "p", "k", each, enough).collect()}
        assert {r.p for r in hypotheses.begun(matches.select("p"), "p", each, enough).collect()} == tested


def test_votes_give_pixels_to_begun_pairs_alone(spark, sf_dir, monkeypatch):
    met = []
    monkeypatch.setattr(matching.hypotheses, "tested", lambda m, *a, f=hypotheses.tested: met.append(m) or f(m, *a))
    assert matching.valid_triangulations(spark, sf_dir).count() == 4
    assert "LeftSemi" in met[0]._jdf.queryExecution().optimizedPlan().toString()


def test_moved_pixels_are_rounded_to_six_decimals_first(spark):
    """A pixel that lands within half a millionth of the middle of two counts as in the middle, as in the SQL."""
    pose = {**{r: float(r in ("r0", "r4", "r8")) for r in geometry.R}, "t1": 0.0, "t2": 0.0}
    moves = [0.4999997, 0.5, 0.5000003, 0.5000007, 1.4999993, 1.4999997, 1.5000003, 2.5000003]
    cameras = spark.createDataFrame([{"image_id": k, "t0": t / 50, **pose} for k, t in enumerate([0.0, *moves])])
    depths = spark.createDataFrame([(0, 10, 5, 1.0), *((k + 1, x, 5, 1.0) for k in range(len(moves)) for x in range(10, 14))], "image_id long, x long, y long, depth double")
    sources = spark.createDataFrame([(0, k + 1) for k in range(len(moves))], "image_id long, src_id long")
    agreed = []
    for x in range(10, 14):
        own = depths.filter(f"image_id = 0 or x = {x}")
        agreed.append(geometry.consistent_views(own, cameras, sources, 50.0, 16.0, 12.0).filter("image_id = 0").first().views)
    assert agreed == [3, 2, 3, 0]


def test_isolated_images_are_those_of_all_pairs(spark, monkeypatch):
    """Whatever settles an image early, the result is that of matching all pairs whole; equal descriptors included."""
    rng = np.random.default_rng(7)
    own = rng.normal(size=(7, 30, 8))
    own[1, :15] = own[0, :15] + 0.01  # settled by the next image
    own[4, 20:] = own[2, 20:] + 0.01  # by the one after, and by its last block only
    own[6, ::3] = own[3, ::3] + 0.01  # by an image far away
    own[5, :20] = own[0, 0]  # many equal ones, with equals elsewhere
    rows = [(k, 100 * k + n, [float(x) for x in v]) for k, image in enumerate(own) for n, v in enumerate(image)]
    frame = spark.createDataFrame(rows, "image_id int, kp_id long, descriptor array<double>").repartition(3)
    whole = []
    monkeypatch.setattr(matchers, "match_pairs", lambda d, p, *a, f=matchers.match_pairs: whole.append(p.count()) or f(d, p, *a))
    for enough in (1, 5, 9, 11, 40):
        pairs = matchers.verified_pairs(matchers.match_pairs(frame, matchers.pairs_exhaustive(frame), 0.6), enough)
        want = sorted(r.image_id for r in matchers.isolated(frame, pairs).collect())
        for block, tried in ((4, (1, 3)), (50, (1,)), (7, ())):
            got = sorted(r.image_id for r in matchers.isolated_images(frame, enough, 0.6, block, tried).collect())
            assert got == want, (enough, block)
    assert max(whole) == 21 and min(whole) < 21
    assert matchers.isolated_images(frame.limit(0), 1).count() == 0
    assert [r.image_id for r in matchers.isolated_images(frame.filter("image_id = 3"), 1).collect()] == [3]


def test_settled_images_are_not_matched_whole(spark, monkeypatch):
    """Ten images that have enough matches in their first blocks: no pair is matched whole."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 8))
    rows = [(k, n, [float(x) for x in v]) for k in range(10) for n, v in enumerate(base + rng.normal(0, 0.01, base.shape))]
    frame = spark.createDataFrame(rows, "image_id int, kp_id long, descriptor array<double>")
    monkeypatch.setattr(matchers, "match_pairs", None)
    assert matchers.isolated_images(frame, 5, 0.6, 20).count() == 0
    monkeypatch.setattr(matching, "descriptors", lambda *a: frame)
    assert matching.isolated_images(spark, "").count() == 0
