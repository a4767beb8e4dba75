"""Matching and tracks. ``embeddings`` stands for descriptors (label = image, vec_id = keypoint), ``lineitem`` for
observations (order = point, supplier = image, line number = sequence), ``supplier`` and ``nation`` for image lists and
``events`` for per-key scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parallaxis import storage
from parallaxis.functions import vectors as V
from parallaxis.operators import graph, hypotheses, matching, raster, sizes, views
from parallaxis.plans import scene
from parallaxis.plans.catalog import query, table
from parallaxis.sources import pfm

#: The stand-in descriptors are far apart, so queries use the loosest tested ratio and few matches a pair.
RATIO, ENOUGH = 0.95, 5

_L2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"
_KNN = f"""
  d as (select a.label image_q, b.label image_r, a.vec_id kp_q, b.vec_id kp_r, {_L2} d2
        from embeddings a join embeddings b on a.label <> b.label),
  r as (select *, row_number() over (partition by image_q, image_r, kp_q order by d2, kp_r) rn,
               lead(d2) over (partition by image_q, image_r, kp_q order by d2, kp_r) d2_next,
               lead(kp_r) over (partition by image_q, image_r, kp_q order by d2, kp_r) kp2 from d),
  knn as (select image_q, image_r, kp_q, kp_r idx1, d2 dist1, coalesce(kp2, -1) idx2, coalesce(d2_next, 1e30) dist2 from r where rn = 1)"""
_MATCHES = f"""{_KNN},
  m as (select f.image_q::bigint image_i, f.image_r::bigint image_j, f.kp_q kp_i, f.idx1 kp_j, sqrt(f.dist1) distance
        from knn f join knn b on f.image_q = b.image_r and f.image_r = b.image_q and f.kp_q = b.idx1 and f.idx1 = b.kp_q
        where f.image_q < f.image_r and (f.dist2 <= 0 or f.dist1 < {RATIO}*{RATIO} * f.dist2)),
  verified as (select image_i, image_j, count(*) num_inliers from m group by all having count(*) >= {ENOUGH})"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("image_id"), F.col("vec_id").alias("kp_id"), F.col("embedding").alias("descriptor"))


def all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = descriptors(spark, sf_dir)
    return matching.match_pairs(own, matching.pairs_exhaustive(own), RATIO)


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.verified_pairs(all_matches(spark, sf_dir), ENOUGH)


@query("knn2_join", f"with {_KNN} select image_q::bigint image_q, image_r::bigint image_r, kp_q, idx1, round(dist1, 6) dist1, idx2, round(dist2, 6) dist2 from knn where image_q < image_r")
def knn2_join(spark, sf_dir):
    own = descriptors(spark, sf_dir)
    pairs = matching.pairs_exhaustive(own).select(F.col("image_i").alias("image_q"), F.col("image_j").alias("image_r"))
    found = matching.knn2(matching.packed(own), pairs)
    return found.withColumns({c: F.round(c, 6) for c in ("dist1", "dist2")})


@query("mutual_nn", f"""with {_KNN} select f.image_q::bigint image_q, f.image_r::bigint image_r, f.kp_q, f.idx1 kp_r from knn f
  join knn b on f.image_q = b.image_r and f.image_r = b.image_q and f.kp_q = b.idx1 and f.idx1 = b.kp_q where f.image_q < f.image_r""")
def mutual_nn(spark, sf_dir):
    own = descriptors(spark, sf_dir)
    found = matching.match_pairs(own, matching.pairs_exhaustive(own), ratio=1e6)
    return found.select(F.col("image_i").alias("image_q"), F.col("image_j").alias("image_r"), F.col("kp_i").alias("kp_q"), F.col("kp_j").alias("kp_r"))


@query("ratio_pred", f"with {_KNN} select image_q::bigint image_q, image_r::bigint image_r, kp_q, idx1 from knn where image_q < image_r and (dist2 <= 0 or dist1 < 0.81 * dist2)")
def ratio_pred(spark, sf_dir):
    own = descriptors(spark, sf_dir)
    pairs = matching.pairs_exhaustive(own).select(F.col("image_i").alias("image_q"), F.col("image_j").alias("image_r"))
    found = matching.knn2(matching.packed(own), pairs).filter(matching.passes_ratio(F.col("dist1"), F.col("dist2"), 0.9))
    return found.select("image_q", "image_r", "kp_q", "idx1")


@query("match_pair", f"with {_MATCHES} select image_i, image_j, kp_i, kp_j, round(distance, 6) distance from m where image_i = 0 and image_j = 1")
def match_pair(spark, sf_dir):
    own = descriptors(spark, sf_dir).filter("image_id in (0, 1)")
    return matching.match_pairs(own, matching.pairs_exhaustive(own), RATIO).withColumn("distance", F.round("distance", 6))


@query("match_features", f"with {_MATCHES} select image_i, image_j, count(*) num_inliers from m where image_i = 2 and image_j = 3 group by all")
def match_features(spark, sf_dir):
    own = descriptors(spark, sf_dir).filter("image_id in (2, 3)")
    return matching.verified_pairs(matching.match_pairs(own, matching.pairs_exhaustive(own), RATIO), 1)


@query("match_all_pairs", f"with {_MATCHES} select * from verified")
def match_all_pairs(spark, sf_dir):
    return verified(spark, sf_dir)


@query("pair_stats", f"with {_MATCHES} select count(*) pairs, sum(num_inliers)::bigint total, round(avg(num_inliers), 6) average from verified")
def pair_stats(spark, sf_dir):
    return verified(spark, sf_dir).agg(F.count(F.lit(1)).alias("pairs"), F.sum("num_inliers").alias("total"), F.round(F.avg("num_inliers"), 6).alias("average"))


@query("isolated_images", f"with {_MATCHES} select distinct label::bigint image_id from embeddings where label not in (select image_i from m group by image_i, image_j having count(*) >= 12 union all select image_j from m group by image_i, image_j having count(*) >= 12)")
def isolated_images(spark, sf_dir):
    return matching.isolated_images(descriptors(spark, sf_dir), 12, RATIO)


@query("matches_for_image", f"""with {_MATCHES} select image_i image_id, image_j other, kp_i kp_this, kp_j kp_other from m where image_i = 4
  union all select image_j, image_i, kp_j, kp_i from m where image_j = 4""")
def matches_for_image(spark, sf_dir):
    return matching.matches_for_image(all_matches(spark, sf_dir), 4)


@query("graph_components", f"""with recursive {_MATCHES},
  edge as (select image_i u, image_j v from m group by all having count(*) >= 12), both_ways as (select u, v from edge union select v, u from edge),
  nodes as (select distinct label::bigint node from embeddings),
  reach(node, root) as (select node, node from nodes union select b.v, r.root from reach r join both_ways b on b.u = r.node)
  select node, min(root) component from reach group by node""")
def graph_components(spark, sf_dir):
    pairs = matching.verified_pairs(all_matches(spark, sf_dir), 12)
    nodes = descriptors(spark, sf_dir).select(F.col("image_id").cast("long").alias("node")).distinct()
    return graph.label_components(nodes, pairs.select(F.col("image_i").alias("u"), F.col("image_j").alias("v")))


@query("pairs_exhaustive", "select a.n_nationkey image_i, b.n_nationkey image_j from nation a join nation b on a.n_nationkey < b.n_nationkey")
def pairs_exhaustive(spark, sf_dir):
    return matching.pairs_exhaustive(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("image_id")))


_RING = """ring as (select row_number() over (order by s_suppkey) - 1 p, (select count(*) from supplier) n from supplier)"""


@query("pairs_sequential", f"with {_RING} select distinct least(p, (p + k) % n) image_i, greatest(p, (p + k) % n) image_j from ring, range(1, 11) t(k) where p <> (p + k) % n")
def pairs_sequential(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    return matching.pairs_sequential(sizes.numbered(suppliers, "s_suppkey", name="image_id"), suppliers.count())


@query("pair_distinct", f"with {_RING} select count(*) pairs from (select distinct least(p, (p + k) % n), greatest(p, (p + k) % n) from ring, range(1, 11) t(k) where p <> (p + k) % n)")
def pair_distinct(spark, sf_dir):
    return pairs_sequential(spark, sf_dir).agg(F.count(F.lit(1)).alias("pairs"))


@query("circ_dist", f"with {_RING}, p as (select distinct least(p, (p + k) % n) a, greatest(p, (p + k) % n) b, n from ring, range(1, 11) t(k) where p <> (p + k) % n) select a, b, least(abs(a - b), n - abs(a - b)) dist from p")
def circ_dist(spark, sf_dir):
    """Ring distances of all sequential pairs."""
    n = table(spark, sf_dir, "supplier").count()
    pairs = pairs_sequential(spark, sf_dir).select(F.col("image_i").alias("a"), F.col("image_j").alias("b"))
    return pairs.withColumn("dist", matching.ring_distance(F.col("a"), F.col("b"), n))


@query("seq_order", f"with {_RING} select p image_id, row_number() over (order by least(least(abs(p - 3), n - abs(p - 3)), least(abs(p - 7), n - abs(p - 7))), p) - 1 place from ring")
def seq_order(spark, sf_dir):
    """All suppliers in the order of their ring distance from the nearer of two."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    key, n = F.col("image_id"), suppliers.count()
    near = F.least(matching.ring_distance(key, F.lit(3), n), matching.ring_distance(key, F.lit(7), n))
    placed = sizes.numbered(suppliers, "s_suppkey", name="image_id").select("image_id", near.alias("near"))
    return sizes.numbered(placed, "near", "image_id", name="place").select("image_id", "place")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point_id"), F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("kp_id"), F.col("l_linenumber").alias("seq"))


@query("obs_index", "select l_suppkey image_id, l_partkey kp_id, max(l_orderkey) point_id from lineitem group by all")
def obs_index(spark, sf_dir):
    return views.observation_index(observations(spark, sf_dir))


@query("covisibility", """with o as (select distinct l_orderkey p, l_suppkey i from lineitem)
  select a.i image_i, b.i image_j, count(*) shared from o a join o b on a.p = b.p and a.i < b.i group by all""")
def covisibility(spark, sf_dir):
    return views.covisibility(observations(spark, sf_dir))


@query("corr_2d3d", """with idx as (select l_suppkey i, l_partkey k, max(l_orderkey) p from lineitem group by all),
  c as (select o.l_suppkey i, o.l_partkey kp_this, idx.p point_id, row_number() over (partition by o.l_suppkey, o.l_partkey order by idx.i, idx.p) rn
        from (select distinct l_suppkey, l_partkey from lineitem) o join idx on idx.k = o.l_partkey and idx.i <> o.l_suppkey
        where least(abs(idx.i - o.l_suppkey), (select max(l_suppkey) from lineitem) - abs(idx.i - o.l_suppkey)) <= 5)
  select i image_id, kp_this, point_id from c where rn = 1""")
def corr_2d3d(spark, sf_dir):
    """For each keypoint, the point of the first neighbouring image (ring distance at most 5) that observes its match."""
    own = observations(spark, sf_dir)
    low, n = own.agg(F.min("image_id"), F.max("image_id")).first()
    matches = views.neighbours(own.select("image_id", "kp_id").distinct(), n or 1, ids=(low or 0, n or 0)).withColumn("kp_other", F.col("kp_id"))
    return views.correspondences(matches, views.observation_index(own)).withColumnRenamed("kp_id", "kp_this")


@query("first_wins", "select l_partkey kp_id, l_suppkey image_id, l_orderkey point_id from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey) rn from lineitem) where rn = 1")
def first_wins(spark, sf_dir):
    return views.first_wins(observations(spark, sf_dir), "kp_id", "point_id", "seq").select("kp_id", "image_id", "point_id")


@query("used_kps", "select count(*) used from (select distinct l_suppkey, l_partkey from lineitem)")
def used_kps(spark, sf_dir):
    return observations(spark, sf_dir).select("image_id", "kp_id").distinct().agg(F.count(F.lit(1)).alias("used"))


@query("untracked_anti", """select l_suppkey image_id, l_partkey kp_id, count(*) n from lineitem where l_linenumber > 3
  and (l_suppkey, l_partkey) not in (select (l_suppkey, l_partkey) from lineitem where l_linenumber <= 3) group by all""")
def untracked_anti(spark, sf_dir):
    own = observations(spark, sf_dir)
    fresh = views.untracked(own.filter("seq > 3"), own.filter("seq <= 3"))
    return fresh.groupBy("image_id", "kp_id").agg(F.count(F.lit(1)).alias("n"))


@query("obs_not_dup", """select distinct l_orderkey point_id, l_suppkey image_id from lineitem n where l_linenumber > 2
  and not exists (select 1 from lineitem o where o.l_orderkey = n.l_orderkey and o.l_suppkey = n.l_suppkey and o.l_linenumber <= 2)""")
def obs_not_dup(spark, sf_dir):
    own = observations(spark, sf_dir)
    return own.filter("seq > 2").join(own.filter("seq <= 2"), ["point_id", "image_id"], "left_anti").select("point_id", "image_id").distinct()


@query("mirror_contamination", """select distinct l_orderkey point_id from lineitem where l_orderkey not in
  (select l_orderkey from lineitem join supplier on l_suppkey = s_suppkey where s_acctbal < 0)""")
def mirror_contamination(spark, sf_dir):
    """Points that no mirrored camera sees; suppliers in debt stand for those."""
    own = observations(spark, sf_dir)
    mirrored = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("image_id"))
    return views.without_images(own.select("point_id").distinct(), own, mirrored)


@query("camera_lookup", "select l_orderkey point_id, l_linenumber seq, s_nationkey camera from lineitem join supplier on l_suppkey = s_suppkey where s_acctbal > 0")
def camera_lookup(spark, sf_dir):
    registered = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("image_id"), F.col("s_nationkey").alias("camera"))
    return observations(spark, sf_dir).join(registered, "image_id").select("point_id", "seq", "camera")


@query("points_append", "select count(*) points, count(distinct p) distinct_points from (select l_orderkey p from lineitem union all select o_orderkey from orders)")
def points_append(spark, sf_dir):
    old = observations(spark, sf_dir).select("point_id")
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"))
    return old.unionByName(new).agg(F.count(F.lit(1)).alias("points"), F.countDistinct("point_id").alias("distinct_points"))


@query("points_clear", "select distinct o_orderkey point_id from orders where o_orderstatus = 'F'")
def points_clear(spark, sf_dir):
    """Rebuilding a point set replaces the frame; nothing of the old one is read."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("point_id")).distinct()


@query("octave_union", f"""with {scene.RASTER}, o as (select 0 octave, * from rast union all select 1, image_id, y // 2, x // 2, v from rast where x % 2 = 0 and y % 2 = 0 union all select 2, image_id, y // 4, x // 4, v from rast where x % 4 = 0 and y % 4 = 0)
  select octave, image_id, count(*) n, round(sum(v), 4) total from o group by all""")
def octave_union(spark, sf_dir):
    """Each supplier's image, its half and its quarter, as one frame."""
    octave, both = scene.raster(spark, sf_dir).select("image_id", "y", "x", "v"), None
    for k in range(3):
        own = octave.withColumn("octave", F.lit(k))
        both, octave = own if both is None else both.unionByName(own), raster.half(octave)
    return both.groupBy("octave", "image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("feature_stats", "select count(*) total, round(count(*)::double / count(distinct label), 6) average from embeddings")
def feature_stats(spark, sf_dir):
    own = descriptors(spark, sf_dir)
    return own.agg(F.count(F.lit(1)).alias("total"), F.round(F.count(F.lit(1)) / F.countDistinct("image_id"), 6).alias("average"))


@query("inlier_count", "select l_suppkey image_id, sum((l_discount > 0.05)::int)::bigint inliers from lineitem group by all")
def inlier_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_id")).agg(F.count_if(F.col("l_discount") > 0.05).alias("inliers"))


@query("median_upper", "select l_suppkey image_id, list_sort(list(l_extendedprice))[(len(list(l_extendedprice)) // 2)::int + 1] median from lineitem group by all")
def median_upper(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id"), "l_extendedprice")
    return views.upper_median(own, "image_id", "l_extendedprice")


@query("depth_percentiles", """with d as (select l_suppkey image_id, list_sort(list(l_extendedprice)) d, avg(l_extendedprice) mean from lineitem group by all)
  select image_id, round(case when len(d) < 2 then mean * 0.3 else d[floor(len(d) * 0.05::double)::int + 1] * 0.5::double end, 6) depth_min,
         round(case when len(d) < 2 then mean * 3 else d[least(floor(len(d) * 0.95::double)::int, len(d) - 1) + 1] * 1.5::double end, 6) depth_max from d""")
def depth_percentiles(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id"), "l_extendedprice")
    return views.depth_range(own, "image_id", "l_extendedprice").withColumns({c: F.round(c, 6) for c in ("depth_min", "depth_max")})


@query("topn_sources", """with o as (select distinct l_orderkey p, l_suppkey i from lineitem),
  c as (select a.i ref_id, b.i src_id, count(*) shared from o a join o b on a.p = b.p and a.i <> b.i group by all),
  r as (select *, row_number() over (partition by ref_id order by shared desc, src_id) rank from c) select ref_id, src_id, shared, rank from r where rank <= 5""")
def topn_sources(spark, sf_dir):
    pairs = views.covisibility(observations(spark, sf_dir))
    both = pairs.select(F.col("image_i").alias("ref_id"), F.col("image_j").alias("src_id"), "shared").union(pairs.select("image_j", "image_i", "shared"))
    best = views.top_sources(both.withColumn("score", F.col("shared")), 5)
    return best.select("ref_id", "src_id", "shared", F.col("rank").cast("long").alias("rank"))


_SCORE = "case when deg < 5 or deg > 90 then 0.0::double else sin(radians(greatest(5.0::double, least(30.0::double, deg)))) end"
#: A stand-in angle between two images, from their ids alone.
_PAIR_DEG = "(abs(a.i - b.i) * 7 % 120)::double"


@query("source_candidates", f"""with o as (select distinct l_orderkey p, l_suppkey i from lineitem),
  c as (select a.i ref_id, b.i src_id, count(*) shared, {_PAIR_DEG} deg from o a join o b on a.p = b.p and a.i <> b.i group by all)
  select ref_id, src_id, shared, round({_SCORE} * shared, 6) score from c where {_SCORE} > 0""")
def source_candidates(spark, sf_dir):
    pairs = views.covisibility(observations(spark, sf_dir))
    pairs = pairs.withColumn("baseline_deg", (F.abs(F.col("image_i") - F.col("image_j")) * 7 % 120).cast("double"))
    return views.source_candidates(pairs).select("ref_id", "src_id", "shared", F.round("score", 6).alias("score"))


@query("baseline_score", f"select o_orderkey point_id, round(case when deg is null then null else {_SCORE} end, 6) score from (select o_orderkey, o_totalprice % 120 deg from orders)")
def baseline_score(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), F.round(views.baseline_score(F.col("o_totalprice") % 120), 6).alias("score"))


@query("topk_cost_mean", "select user_id, round(list_sum(list_sort(list(value))[1:3]) / least(3, count(value)), 6) cost from events where value is not null group by all")
def topk_cost_mean(spark, sf_dir):
    return views.lowest_mean(table(spark, sf_dir, "events"), "user_id", "value").withColumn("cost", F.round("cost", 6))


@query("best_hypothesis", "select user_id, min(event_id) filter (where value = lowest) event_id, any_value(lowest) cost from (select *, min(value) over (partition by user_id) lowest from events) group by user_id")
def best_hypothesis(spark, sf_dir):
    return views.lowest(table(spark, sf_dir, "events"), "user_id", "value", "event_id").withColumnRenamed("value", "cost")


@query("topk_response", """with r as (select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) rn from events),
  k as (select *, row_number() over (partition by user_id order by event_id) place from r where rn <= 20) select user_id, event_id, place from k""")
def topk_response(spark, sf_dir):
    """The strongest 20 of each key, then in their original order."""
    return views.strongest(table(spark, sf_dir, "events"), "user_id", "value", "event_id", 20)


@query("init_candidates", "with o as (select distinct l_orderkey p, l_suppkey i from lineitem), c as (select a.i image_i, b.i image_j, count(*) num_inliers from o a join o b on a.p = b.p and a.i < b.i group by all) select * from c where num_inliers >= 3 order by num_inliers desc, image_i, image_j limit 300")
def init_candidates(spark, sf_dir):
    """The 300 pairs with most inliers: a report, so the limit is the feature."""
    pairs = views.covisibility(observations(spark, sf_dir)).withColumnRenamed("shared", "num_inliers")
    return views.start_pairs(pairs, 3, 300)


_W = "(case when deg between 3 and 45 then 2.0 when deg <= 60 then 1.0 else 0.3 end * case when ring <= 5 then 2 else 1 end)::double"


@query("argmax_pair", f"""with o as (select distinct l_orderkey p, l_suppkey i from lineitem), n as (select max(i) n from o),
  c as (select a.i, b.i j, count(*) tri, (abs(a.i - b.i) * 7 % 120)::double deg, least(abs(a.i - b.i), any_value(n) - abs(a.i - b.i)) ring from o a join o b on a.p = b.p and a.i < b.i cross join n group by all),
  s as (select i image_i, j image_j, tri, round(tri * {_W}, 6) score from c where tri >= 3) select * from s order by score desc, image_i, image_j limit 1""".replace("any_value(n)", "n"))
def argmax_pair(spark, sf_dir):
    own = observations(spark, sf_dir)
    n = own.agg(F.max("image_id").alias("n"))
    gap = F.abs(F.col("image_i") - F.col("image_j"))
    deg, ring = (gap * 7 % 120).cast("double"), F.least(gap, F.col("n") - gap)
    weight = F.when(deg.between(3, 45), 2.0).when(deg <= 60, 1.0).otherwise(0.3) * F.when(ring <= 5, 2).otherwise(1)
    pairs = views.covisibility(own).filter("shared >= 3").crossJoin(F.broadcast(n))
    scored = pairs.select("image_i", "image_j", F.col("shared").alias("tri"), F.round(F.col("shared") * weight, 6).alias("score"))
    return views.best_pair(scored)


@query("ring_lead", "select o_orderkey i, o_totalprice theta, coalesce(lead(o_totalprice) over r, first_value(o_totalprice) over r) next_theta from orders window r as (partition by o_custkey order by o_orderkey)")
def ring_lead(spark, sf_dir):
    """Each customer's orders are a ring: the price of the next one, and of the first after the last."""
    ring = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    after = F.coalesce(F.lead("o_totalprice").over(ring), F.first("o_totalprice").over(ring))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("theta"), after.alias("next_theta"))


@query("direction_vote", "with r as (select s_suppkey i, s_acctbal theta from supplier) select case when sum(d) >= 0 then 1 else -1 end vote from (select lead(theta) over (order by i) - theta d from r)")
def direction_vote(spark, sf_dir):
    """The sign of the summed steps around the ring, without the step that closes it: what lies between first and last."""
    own = table(spark, sf_dir, "supplier")
    return own.agg(F.when(F.max_by("s_acctbal", "s_suppkey") - F.min_by("s_acctbal", "s_suppkey") >= 0, 1).otherwise(-1).alias("vote"))


_VOTES = f"""{scene.SEEN}, f as (select image_id, point_id kp, min(struct_pack(o := order_id, n := number, u := u, v := v)) s from seen group by all),
  m as (select a.image_id i, a.kp, a.s.u ui, a.s.v vi, b.s.u uj, b.s.v vj, row_number() over (partition by a.image_id order by a.kp) rn from f a join f b on a.kp = b.kp and b.image_id = a.image_id + 1),
  k as (select * from m where rn <= 10), t as (select i, count(*) n from k group by i), b as (select i, sum(n) over (order by i) - n before from t),
  c as (select * from (values (0, 1, 1), (1, -1, 1), (2, 1, -1), (3, -1, -1)) t(config, axis, direction)),
  w as (select c.*, k.*, axis * direction * radians(10.0::double * i) ai, axis * direction * radians(10.0::double * (i + 1)) aj, p.t2 di, q.t2 dj from k join b using (i) join ring p on p.image_id = i join ring q on q.image_id = i + 1 cross join c where before < 100),
  x as (select *, (ui-640)/2000 xi, (vi-480)/2000 yi, (uj-640)/2000 xj, (vj-480)/2000 yj, di*cos(ai) ci0, di*sin(ai) ci1, dj*cos(aj) cj0, dj*sin(aj) cj1 from w),
  y as (select *, sqrt(xi*xi + yi*yi + 1) li, sqrt(xj*xj + yj*yj + 1) lj from x),
  z as (select *, (-sin(ai)*xi - cos(ai))/li p0, (cos(ai)*xi - sin(ai))/li p1, -yi/li p2, (-sin(aj)*xj - cos(aj))/lj q0, (cos(aj)*xj - sin(aj))/lj q1, -yj/lj q2 from y),
  d as (select *, p0*q0 + p1*q1 + p2*q2 bb, p0*(ci0-cj0) + p1*(ci1-cj1) dd, q0*(ci0-cj0) + q1*(ci1-cj1) ee from z),
  s as (select *, (bb*ee - dd)/(1 - bb*bb) s, (ee - bb*dd)/(1 - bb*bb) t from d),
  g as (select *, (ci0 + s*p0 + cj0 + t*q0)/2 gx, (ci1 + s*p1 + cj1 + t*q1)/2 gy, (s*p2 + t*q2)/2 gz from s),
  v as (select *, di - cos(ai)*gx - sin(ai)*gy zi, dj - cos(aj)*gx - sin(aj)*gy zj, degrees(acos(greatest(-1.0::double, least(1.0::double, ((ci0-gx)*(cj0-gx) + (ci1-gy)*(cj1-gy) + gz*gz) / (sqrt((ci0-gx)**2 + (ci1-gy)**2 + gz*gz) * sqrt((cj0-gx)**2 + (cj1-gy)**2 + gz*gz)))))) angle from g),
  r as (select config, zi > 0 and zj > 0 and angle >= 2 and sqrt((2000*(cos(ai)*gy - sin(ai)*gx)/zi + 640 - ui)**2 + (480 - 2000*gz/zi - vi)**2) <= 4 and sqrt((2000*(cos(aj)*gy - sin(aj)*gx)/zj + 640 - uj)**2 + (480 - 2000*gz/zj - vj)**2) <= 4 valid from v),
  votes as (select config, axis, direction, count(valid) tested, count_if(coalesce(valid, false))::bigint good from c left join r using (config) group by all)"""


def _votes(spark, sf_dir) -> DataFrame:
    """Matches of suppliers with the next are parts that line items of both see, at their first pixels.

    Which pairs are tested follows from the ids of all line items; only theirs, at most a hundred, are given pixels.
    """
    seen = scene.seen(spark, sf_dir)
    own = seen.select(F.col("image_id").alias("i"), F.col("point_id").alias("kp")).distinct()
    used = hypotheses.begun(own.join(own.select((F.col("i") - 1).alias("i"), "kp"), ["i", "kp"]), "i")
    images = storage.materialize(used.select(F.explode(F.array("i", F.col("i") + 1)).alias("image_id")).distinct(), "begun-images")
    first = seen.join(F.broadcast(images), "image_id", "left_semi").groupBy("image_id", F.col("point_id").alias("kp")).agg(F.min(F.struct("order_id", "number", "u", "v")).alias("s"))
    a = first.select(F.col("image_id").alias("i"), "kp", F.col("s.u").alias("ui"), F.col("s.v").alias("vi"))
    b = first.select((F.col("image_id") - 1).alias("i"), "kp", F.col("s.u").alias("uj"), F.col("s.v").alias("vj"))
    matches = hypotheses.tested(a.join(b, ["i", "kp"]), "i", "kp").withColumn("j", F.col("i") + 1)
    orbit = scene.cameras(spark, sf_dir).select("image_id", F.radians(F.col("image_id") * 10.0).alias("angle"), F.col("t2").alias("distance"))
    return hypotheses.orbit_votes(matches.drop("kp"), orbit, scene.FOCAL, scene.CX, scene.CY)


@query("valid_triangulations", f"with {_VOTES} select config, tested, good from votes")
def valid_triangulations(spark, sf_dir):
    """For each sign of the orbit's axis and direction, how many of the first matches triangulate validly."""
    return _votes(spark, sf_dir).select("config", "tested", "good")


@query("argmax_config", f"with {_VOTES} select axis, direction, good from votes order by good desc, config limit 1")
def argmax_config(spark, sf_dir):
    """The signs under which most matches triangulate; the first of equal ones."""
    return _votes(spark, sf_dir).orderBy(F.desc("good"), "config").limit(1).select("axis", "direction", "good")


@query("log_stats", f"with {_MATCHES} select count(*) pairs, coalesce(sum(num_inliers), 0)::bigint inliers, min(num_inliers) fewest, max(num_inliers) most from verified")
def log_stats(spark, sf_dir):
    """What the matching of all pairs logs, observed while its table is written: no job of its own."""
    made, stats = matching.observed(verified(spark, sf_dir))
    storage.drop(storage.materialize(made, "verified-pairs"))
    seen = stats.get
    return spark.createDataFrame([(seen["pairs"], seen["inliers"] or 0, seen["fewest"], seen["most"])], "pairs long, inliers long, fewest long, most long")


@query("untracked_scan")
def untracked_scan(spark, sf_dir):
    """Matches of each order's consecutive lines that make new points when they are scanned in order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_suppkey", "l_partkey", "l_quantity")).alias("s"))
    own = lines.select("l_orderkey", "l_linenumber", F.col("s.l_suppkey").alias("image_i"), F.col("s.l_partkey").alias("kp_i"))
    other = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("s.l_suppkey").alias("image_j"), F.col("s.l_partkey").alias("kp_j"))
    matches = own.join(other, ["l_orderkey", "l_linenumber"]).select("image_i", "kp_i", "image_j", "kp_j", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    tracked = lines.filter("s.l_quantity >= 48").select(F.col("s.l_suppkey").alias("image_id"), F.col("s.l_partkey").alias("kp_id"))
    return views.grown(matches, tracked)


@query("scan_pfm", f"with {scene.RASTER} select 'depth-' || image_id || '.pfm' file, count_if(v <> 0)::bigint n, round(sum(v), 3) total, round(sum(v * (x + 100 * y)), 3) placed from rast group by 1")
def scan_pfm(spark, sf_dir):
    """Each supplier's image, written as a PFM file by the executors and read back."""
    own = scene.raster(spark, sf_dir).withColumn("file", F.concat(F.lit("depth-"), F.col("image_id").cast("string"), F.lit(".pfm")))
    folder = storage.scratch(spark, "pfm")
    pfm.write(own.select("file", F.lit(scene.WIDTH).alias("width"), F.lit(scene.HEIGHT).alias("height"), "y", "x", F.col("v").alias("depth")), folder)
    depth = F.coalesce("depth", F.lit(0.0)).cast("double")
    read = pfm.read(spark, folder)
    return read.groupBy("file").agg(F.count("depth").alias("n"), F.round(F.sum(depth), 3).alias("total"), F.round(F.sum(depth * (F.col("x") + 100 * F.col("y"))), 3).alias("placed"))


@query("pred_parallax", "select count(*) n from orders where degrees(acos(greatest(-1.0, least(1.0, o_totalprice / 500000 - 0.2)))) >= 60")
def pred_parallax(spark, sf_dir):
    angle = F.degrees(V.clamped_acos(F.col("o_totalprice") / 500000 - 0.2))
    return table(spark, sf_dir, "orders").filter(angle >= 60).agg(F.count(F.lit(1)).alias("n"))
