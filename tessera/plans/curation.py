"""Queries on drops, builds, diagnoses, method comparisons, batches to label and rules of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import geometry as G
from tessera.operators import active, contract, curation, matching, metrics, splits
from tessera.plans.analogues import INSTANCES_SQL, frames, instances, sides
from tessera.plans.pool import seam_distances
from tessera.plans.rounds import LEDGER_SQL, ledger
from tessera.plans.specs import lost_sessions, range_table
from tessera.session import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- drops and builds
TOKENS = ("3", "17", "99999999", "60-40", "900-950", "9990-")
DROPPED_SQL = "f AS (SELECT event_id, event_id % 7 = 0 AS old, event_id IN (3, 17) OR event_id BETWEEN 40 AND 60 OR event_id BETWEEN 900 AND 950 OR event_id >= 9990 AS named FROM events)"


def pool_with_drops(spark, sf):
    old = F.col("event_id") % 7 == 0
    return table(spark, sf, "events").select("event_id", old.alias("dropped"), F.when(old, "redundant").alias("drop_reason"))


@query(f"WITH {DROPPED_SQL} SELECT event_id, old OR named AS dropped, CASE WHEN old THEN 'redundant' WHEN named THEN 'manual' END AS drop_reason FROM f")
def manual_drops(spark, sf):
    return curation.manual_drops(pool_with_drops(spark, sf), range_table(spark, TOKENS), "event_id", "manual")[0]


@query("SELECT 99999999::BIGINT AS event_id")
def unmatched_drops(spark, sf):
    return curation.manual_drops(pool_with_drops(spark, sf), range_table(spark, TOKENS), "event_id", "manual")[1]


@query("SELECT event_id, event_id % 7 = 0 AS restored, false AS dropped, NULL::VARCHAR AS drop_reason FROM events")
def restored_frames(spark, sf):
    return curation.restore_all(pool_with_drops(spark, sf))


CLASS_SQL = "CASE cls WHEN 'A' THEN 'onion_plant' WHEN 'R' THEN 'weed_cluster' ELSE 'grass_weed' END"


def classed(spark, sf):
    c = F.col("cls")
    return instances(spark, sf).withColumn("class_name", F.when(c == "A", "onion_plant").when(c == "R", "weed_cluster").otherwise("grass_weed"))


@query(f"WITH {INSTANCES_SQL}, c AS (SELECT {CLASS_SQL} AS class_name FROM instances) SELECT class_name, count(*) AS n FROM c WHERE class_name = 'weed_cluster' GROUP BY 1")
def build_classes(spark, sf):
    """Classes of a build that keeps two and drops one of them."""
    gone = curation.classes_left_out(drop=("grass_weed",), keep=("grass_weed", "weed_cluster"))
    return curation.drop_classes(classed(spark, sf), "class_name", gone).groupBy("class_name").agg(F.count("*").alias("n"))


@query(f"WITH {INSTANCES_SQL} SELECT o_orderkey AS frame FROM orders WHERE o_orderkey IN (SELECT frame FROM instances WHERE cls <> 'A' AND cls <> 'N')")
def build_frames(spark, sf):
    """Frames left without an instance go."""
    all_ = table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame"))
    return curation.with_instances(all_, curation.drop_classes(classed(spark, sf), "class_name", ("onion_plant", "grass_weed")), "frame")


@query("""WITH p AS (SELECT user_id AS session_id, CASE WHEN user_id % 4 = 0 THEN '' WHEN event_id % 3 = 0 THEN ' OK' ELSE 'LOST' END AS state, user_id % 5 <> 0 AS recorded, user_id % 4 = 1 OR (user_id % 4 = 2 AND event_id % 3 = 0) AS usable FROM events),
n AS (SELECT session_id, count(*) AS n, count(*) FILTER (recorded) AS n_recorded, count(*) FILTER (recorded AND usable) AS n_usable, coalesce(string_agg(DISTINCT trim(state), ',' ORDER BY trim(state)) FILTER (trim(state) <> ''), '') AS states FROM p GROUP BY 1)
SELECT *, CASE WHEN n_recorded = 0 THEN 'not_recorded' WHEN n_usable = 0 THEN 'never_trusted' WHEN n_usable < n THEN 'partly_usable' ELSE 'usable' END AS diagnosis FROM n""")
def pose_diagnoses(spark, sf):
    s, k = F.col("session_id"), F.col("idx")
    rows = frames(spark, sf).withColumn("state", F.when(s % 4 == 0, "").when(k % 3 == 0, " OK").otherwise("LOST"))
    recorded = s % 5 != 0
    return curation.pose_diagnosis(rows, "session_id", recorded, recorded & ((s % 4 == 1) | ((s % 4 == 2) & (k % 3 == 0))), "state")


@query("""WITH f AS (SELECT user_id AS video, user_id % 6 = 0 AS wide, CASE WHEN user_id % 6 <> 1 THEN CASE user_id % 6 WHEN 2 THEN 246 + event_id % 5 ELSE event_id % 256 END END AS top, (event_id % 10) / 1000.0::DOUBLE AS saturated,
  CASE user_id % 6 WHEN 4 THEN 40.0 WHEN 5 THEN 40.0 ELSE 2.0 END::DOUBLE AS chroma, CASE user_id % 6 WHEN 4 THEN 30.0 ELSE 3.0 END::DOUBLE AS residual FROM events),
v AS (SELECT video, bool_or(wide) AS wide, count(top) AS n_frames, min(top) AS lo, max(top) AS hi, max(saturated) FILTER (top IS NOT NULL) AS sat, max(chroma) FILTER (top IS NOT NULL) AS chroma, min(residual) FILTER (top IS NOT NULL) AS residual FROM f GROUP BY 1),
d AS (SELECT video, n_frames, CASE WHEN wide THEN 'true_16bit' WHEN n_frames = 0 THEN 'undecodable' WHEN chroma > 12 AND residual > 18 THEN 'unknown_8bit' WHEN n_frames >= 3 AND lo >= 245 AND hi - lo <= 12 AND sat < 0.02 THEN 'per_frame_normalised_8bit' WHEN chroma <= 12 THEN 'grayscale_8bit' ELSE 'colormapped_8bit' END AS verdict FROM v)
SELECT *, verdict IN ('true_16bit', 'grayscale_8bit', 'colormapped_8bit') AS recoverable, verdict = 'true_16bit' AS exact FROM d""")
def depth_videos(spark, sf):
    k, i = F.col("session_id") % 6, F.col("idx")
    rows = frames(spark, sf).select(
        F.col("session_id").alias("video"),
        (k == 0).alias("wide"),
        F.when(k != 1, F.when(k == 2, 246 + i % 5).otherwise(i % 256)).alias("top"),
        ((i % 10) / 1000.0).alias("saturated"),
        F.when(k.isin(4, 5), 40.0).otherwise(2.0).alias("chroma"),
        F.when(k == 4, 30.0).otherwise(3.0).alias("residual"),
    )
    return curation.depth_videos(rows, "video", "wide", "top", "saturated", "chroma", "residual")


@query("""WITH f AS (SELECT user_id, event_id, CASE WHEN event_id % 50 < 30 THEN 'train' WHEN event_id % 50 < 40 THEN 'val' ELSE 'test' END AS split FROM events),
s AS (SELECT a.user_id AS session_id, a.split, min(abs(a.event_id - b.event_id)) AS separation FROM f a JOIN f b ON a.user_id = b.user_id AND b.split = 'train' WHERE a.split <> 'train' GROUP BY ALL)
SELECT * FROM s WHERE separation < 30""")
def seam_problems(spark, sf):
    """Sessions whose held-out frames lie too near to train frames."""
    return matching.seam_problems(seam_distances(spark, sf), "separation", 30)


@query("""WITH s AS (SELECT DISTINCT user_id FROM events), a AS (SELECT DISTINCT user_id FROM events WHERE event_id % 200 < 30 AND user_id % 9 <> 0) SELECT user_id FROM s WHERE user_id NOT IN (SELECT user_id FROM a) AND user_id <> 18""")
def lost_users(spark, sf):
    before = table(spark, sf, "events").select("user_id", "event_id")
    return lost_sessions(before, before.filter("event_id % 200 < 30 AND user_id % 9 <> 0"), "user_id", ["18"])


@query("SELECT event_id, user_id, CASE WHEN user_id % 10 = 9 THEN 'unassigned' WHEN user_id % 10 < 7 THEN 'train' ELSE 'val' END AS split FROM events")
def assigned_frames(spark, sf):
    """Frames with the split of a plan; sessions that the plan lacks are unassigned."""
    rows, u = table(spark, sf, "events").select("event_id", "user_id"), F.col("user_id")
    plan = rows.select(u.alias("session_id")).distinct().filter("session_id % 10 <> 9").withColumn("split", F.when(F.col("session_id") % 10 < 7, "train").otherwise("val"))
    out = splits.assign(rows, plan, "user_id")
    splits.assert_no_leaks(out, "user_id", "split")
    return out.select("event_id", "user_id", "split")


# ---------------------------------------------------------------- metrics
@query("""WITH c AS (SELECT l_returnflag AS cls, count(*) FILTER (l_linenumber = 1 AND l_partkey % 3 = 0) AS tp, count(*) FILTER (l_linenumber = 1) AS n_gt, count(*) FILTER (l_partkey % 3 = 0) AS n_pred FROM lineitem GROUP BY 1)
SELECT sum(tp)::BIGINT AS tp, sum(n_gt)::BIGINT AS n_gt, sum(n_pred)::BIGINT AS n_pred, round(sum(tp) / sum(n_gt), 6) AS recall, round(sum(tp) / sum(n_pred), 6) AS precision FROM c WHERE cls <> 'A'""")
def pooled_weeds(spark, sf):
    first, hit = F.col("l_linenumber") == 1, F.col("l_partkey") % 3 == 0
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("cls")).agg(F.count_if(first & hit).alias("tp"), F.count_if(first).alias("n_gt"), F.count_if(hit).alias("n_pred"))
    return metrics.class_pool(counts, "cls", "A")


@query("""WITH l AS (SELECT l_suppkey % 3 AS m, (l_partkey % 40)::DOUBLE AS u, (l_suppkey % 30)::DOUBLE AS v, 5 + l_linenumber AS r, (l_partkey % 40) + l_quantity / 10 * (1 + l_suppkey % 3) AS pu, (l_suppkey % 30) - l_tax * 20 AS pv FROM lineitem),
e AS (SELECT m, r, sqrt(pow(pu - u, 2) + pow(pv - v, 2)) AS e FROM l)
SELECT ['bbox_centre', 'centroid', 'fused'][m + 1] AS method, count(*) AS n, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.95), 6) AS p95, round(avg((e <= 2)::INT), 6) AS within_2, round(avg((e <= 5)::INT), 6) AS within_5,
  round(avg((e <= 10)::INT), 6) AS within_10, round(avg((e <= 15)::INT), 6) AS within_15, round(avg((e <= 0.1::DOUBLE * r)::INT), 6) AS within_10pct, round(avg((e <= 0.25::DOUBLE * r)::INT), 6) AS within_25pct, round(avg((e <= 0.5::DOUBLE * r)::INT), 6) AS within_50pct FROM e GROUP BY m""")
def point_methods(spark, sf):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    m = supp % 3
    rows = table(spark, sf, "lineitem").select(
        F.when(m == 0, "bbox_centre").when(m == 1, "centroid").otherwise("fused").alias("method"),
        (part % 40).cast("double").alias("u"),
        (supp % 30).cast("double").alias("v"),
        (5 + F.col("l_linenumber")).alias("r"),
        (part % 40 + F.col("l_quantity") / 10 * (1 + m)).alias("pu"),
        (supp % 30 - F.col("l_tax") * 20).alias("pv"),
    )
    return metrics.compare_methods(rows, "method", ("pu", "pv"), ("u", "v"), "r")


@query(f"""WITH {INSTANCES_SQL}, p AS (SELECT cls, CASE WHEN l_partkey % 6 <> 0 THEN l_suppkey % 30 + 0.25 < w END AS inside FROM instances WHERE is_truth) SELECT cls, count(inside) AS n, round(avg(inside::INT), 6) AS inside_rate FROM p GROUP BY cls""")
def inside_rates(spark, sf):
    """Points that lie inside their own box; those without a box don't count."""
    rows = instances(spark, sf).filter("is_truth")
    inside = G.point_in_polygon(F.col("x") + F.col("l_suppkey") % 30 + 0.25, F.col("y") + F.col("h") / 2 + 0.25, G.box_polygon(*[F.col(c) for c in "xywh"]))
    return metrics.inside_rate(rows, ["cls"], F.when(F.col("l_partkey") % 6 != 0, inside))


@query("""WITH p AS (SELECT l_returnflag AS cls, l_quantity AS dx, l_linenumber * 2 AS dy, l_tax * 100 AS dz FROM lineitem WHERE l_partkey % 4 <> 0), d AS (SELECT cls, sqrt(dx * dx + dy * dy + dz * dz) AS d, sqrt(dx * dx + dy * dy) AS xy, abs(dz) AS z FROM p)
SELECT cls, count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(xy, 0.5), 6) AS xy_median, round(quantile_cont(z, 0.5), 6) AS z_median FROM d GROUP BY cls""")
def point_errors_3d(spark, sf):
    known = F.col("l_partkey") % 4 != 0
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cls"), F.col("l_quantity").alias("x"), (F.col("l_linenumber") * 2).alias("y"), (F.col("l_tax") * 100).alias("z"), *[F.when(known, 0.0).alias(f"t{c}") for c in "xyz"])
    return metrics.errors_3d(rows, ["cls"], ("x", "y", "z"), ("tx", "ty", "tz"))


@query(f"""WITH {INSTANCES_SQL}, a AS (SELECT cls, w * h AS a FROM instances), s AS (SELECT cls, list_sort(list(a)) AS v, count(*) AS n, count(*) FILTER (a < 200) AS tiny FROM a GROUP BY cls)
SELECT cls, n, v[n] AS most, tiny, tiny > 0.5 * n AS suspect, v[floor(0.1::DOUBLE * (n - 1))::INT + 1] AS p10, v[floor(0.5::DOUBLE * (n - 1))::INT + 1] AS p50, v[floor(0.9::DOUBLE * (n - 1))::INT + 1] AS p90 FROM s""")
def area_summaries(spark, sf):
    return metrics.area_summary(instances(spark, sf).withColumn("area", F.col("w") * F.col("h")), ["cls"], "area", 50.0)


@query(f"""WITH {INSTANCES_SQL}, c AS (SELECT a.frame, a.n AS i, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) / (b.w * b.h) AS covered
  FROM instances a JOIN instances b ON a.frame = b.frame AND NOT a.is_truth AND b.is_truth AND a.cls = 'R' AND b.cls <> 'R'),
o AS (SELECT frame, i FROM c WHERE covered >= 0.5 GROUP BY ALL HAVING count(*) >= 2), n AS (SELECT count(*) AS clusters FROM instances WHERE NOT is_truth AND cls = 'R')
SELECT clusters, (SELECT count(*) FROM o) AS "over", round((SELECT count(*) FROM o) / clusters, 6) AS rate FROM n""")
def clusters_over(spark, sf):
    pred, truth = sides(spark, sf)
    p, t = pred.filter("cls = 'R'").alias("p"), truth.filter("cls <> 'R'").alias("t")
    side = lambda a, b: F.greatest(F.least(F.col(f"p.{a}") + F.col(f"p.{b}"), F.col(f"t.{a}") + F.col(f"t.{b}")) - F.greatest(f"p.{a}", f"t.{a}"), F.lit(0.0))
    covered = side("x", "w") * side("y", "h") / (F.col("t.w") * F.col("t.h"))
    both = p.join(t, F.col("p.frame") == F.col("t.frame")).select("p.frame", "i", covered.alias("covered"))
    return metrics.cluster_over_prediction(both, pred.filter("cls = 'R'").select("frame", "i"), "frame", "covered")


@query("""WITH f AS (SELECT l_returnflag AS cls, sum(l_partkey % 50)::BIGINT AS crop_px, sum(l_partkey % 7)::BIGINT AS crop_as_weed, sum(l_suppkey % 40)::BIGINT AS weed_px, sum(l_suppkey % 3)::BIGINT AS weed_as_crop FROM lineitem GROUP BY 1)
SELECT *, round(crop_as_weed / crop_px, 6) AS crop_error, round(weed_as_crop / weed_px, 6) AS weed_error FROM f""")
def contact_confusions(spark, sf):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cls"), (part % 50).alias("crop_px"), (part % 7).alias("crop_as_weed"), (supp % 40).alias("weed_px"), (supp % 3).alias("weed_as_crop"))
    return metrics.contact_confusion(rows, ["cls"])


# ---------------------------------------------------------------- batches and rounds
@query()
def next_batch(spark, sf):
    """Greedy picks over all vectors; rows without one are left out."""
    e = table(spark, sf, "embeddings")
    scored = e.select("vec_id", (F.col("vec_id") % 10).cast("double").alias("score"))
    return active.next_batch(scored, e.filter("vec_id % 11 <> 0").select("vec_id", "embedding"), "vec_id", "score", "embedding", 6)


@query("SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id)::INT AS place, 'top' AS how FROM events QUALIFY place <= 25")
def next_batch_by_score(spark, sf):
    """Without descriptors the highest scores: a top-k report."""
    return active.next_batch(table(spark, sf, "events").select("event_id", "value"), None, "event_id", "value", "embedding", 25)


@query()
def cold_start(spark, sf):
    return active.cold_start(table(spark, sf, "embeddings"), "vec_id", "embedding", 5)


@query(f"WITH {LEDGER_SQL} SELECT round, state, n_frames FROM s UNION ALL SELECT 20, 'exported', (SELECT count(*) FROM customer WHERE c_custkey % 10 = 1)")
def round_exported(spark, sf):
    items = table(spark, sf, "customer").filter("c_custkey % 10 = 1")
    return active.record_export(ledger(spark, sf), items, "c_custkey").select("round", "state", "n_frames")


@query(f"WITH {LEDGER_SQL} SELECT round, CASE WHEN round = 6 THEN 0.25 ELSE 0.5 END::DOUBLE AS before, CASE WHEN round = 6 THEN 0.75::DOUBLE ELSE round(n_frames / 7, 4) END AS after FROM s")
def round_measured(spark, sf):
    rounds = active.attach_metrics(ledger(spark, sf), 6, before={"map": 0.25}, after={"map": 0.75, "recall": 0.5})
    cell = lambda c: F.try_element_at(c, F.lit("map"))
    return rounds.select("round", cell("metrics_before").alias("before"), F.round(cell("metrics_after"), 4).alias("after"))


# ---------------------------------------------------------------- rules of rows
@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE l_linenumber END AS n, l_discount * 10 AS coverage, l_quantity / 5 AS growth, l_tax * 10 AS largest FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, array_to_string(list_filter([CASE WHEN n = 0 THEN 'empty' END, CASE WHEN coverage < 0.3::DOUBLE THEN 'low_coverage' END, CASE WHEN growth > 8 THEN 'seed_growth' END, CASE WHEN largest > 0.6::DOUBLE THEN 'large_instance' END], lambda x: x IS NOT NULL), ',') AS codes FROM r""")
def review_codes(spark, sf):
    n = F.when(F.col("l_partkey") % 13 == 0, 0).otherwise(F.col("l_linenumber"))
    reasons = C.review_reasons(n, F.lit(1), F.col("l_discount") * 10, F.col("l_quantity") / 5, F.col("l_tax") * 10, 0.3, 8.0, 0.6)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.array_join(F.transform(reasons, lambda r: r.code), ",").alias("codes"))


@query("""WITH f AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Gray16LE' WHEN 1 THEN 'yuv420p' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'gray16be' END AS fmt, CASE event_id % 3 WHEN 0 THEN NULL ELSE 'FFV1' END AS codec FROM events)
SELECT event_id, CASE WHEN coalesce(fmt, '') = '' THEN 'no pixel format from codec ' || coalesce(lower(codec), '?') WHEN fmt = 'yuv420p' THEN 'not 16-bit: yuv420p' END AS problem FROM f""")
def depth_precision(spark, sf):
    k = F.col("event_id")
    fmt = F.when(k % 5 == 0, "Gray16LE").when(k % 5 == 1, "yuv420p").when(k % 5 == 2, "").when(k % 5 == 4, "gray16be")
    return table(spark, sf, "events").select(k, C.depth_precision_problem(fmt, F.when(k % 3 != 0, "FFV1")).alias("problem"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 256 <> 255 AND event_id % 256 >= 40 WHEN 1 THEN event_id % 256 <> 255 AND event_id % 256 <= 40 END AS valid,
  CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight, CASE event_id % 3 WHEN 0 THEN 'prelabel_unreviewed' WHEN 1 THEN 'hand_corrected' ELSE 'unknown' END AS caveat,
  CASE WHEN event_id % 256 > 0 THEN round(300 + event_id % 256 / 255 * 2700, 6) ELSE 0 END::DOUBLE AS mm FROM events""")
def pixel_rules(spark, sf):
    """Validity, weight, provenance and millimetres of values, column by column."""
    k, v = F.col("event_id"), F.col("event_id") % 256
    polarity = F.when(k % 3 == 0, "high_is_good").when(k % 3 == 1, "low_is_good")
    seen = F.when(k % 4 == 0, "not_visible").when(k % 4 == 1, "partially_occluded_inferable").when(k % 4 == 2, "visible")
    said = F.when(k % 3 == 0, "Prelabel of a model").when(k % 3 == 1, "hand-CORRECTED")
    return table(spark, sf, "events").select(k, C.confidence_valid(v, polarity, F.lit(0.4)).alias("valid"), C.supervision_weight(seen).alias("weight"), C.provenance_caveat(said).alias("caveat"), F.round(C.preview_millimetres(v, 300.0, 3000.0), 6).alias("mm"))


@query("""WITH a AS (SELECT event_id::VARCHAR AS frame, event_id % 7 AS k, event_id % 5 AS n FROM events),
r AS (SELECT *, CASE k WHEN 0 THEN 'wild_radish' WHEN 1 THEN 'weed_LEP' WHEN 2 THEN 'tomato' WHEN 3 THEN 'grass_weed' WHEN 4 THEN 'ignore_region' WHEN 5 THEN 'other_weed' END AS label, CASE k WHEN 0 THEN 'polygon' WHEN 1 THEN 'points' WHEN 3 THEN 'bbox' WHEN 5 THEN 'polyline' ELSE 'polygon' END AS type FROM a)
SELECT frame, 'error' AS severity, 'bad_label_id' AS kind, k::VARCHAR AS detail FROM r WHERE label IS NULL UNION ALL SELECT frame, 'error', 'empty_lep', 'weed_LEP:points' FROM r WHERE k = 1 AND n * 2 < 2
UNION ALL SELECT frame, 'error', 'unknown_label', 'tomato' FROM r WHERE k = 2 UNION ALL SELECT frame, 'warning', 'bbox_only_instance', 'grass_weed:bbox' FROM r WHERE k = 3
UNION ALL SELECT frame, 'error', 'unsupported_shape', 'other_weed:polyline' FROM r WHERE k = 5 UNION ALL SELECT frame, 'error', 'empty_shape', 'wild_radish:polygon' FROM r WHERE k = 0 AND n * 2 < 6
UNION ALL SELECT frame, 'error', 'unresolvable_session', frame FROM r WHERE event_id_is_session(frame)""".replace("event_id_is_session(frame)", "frame::BIGINT % 11 = 0"))
def annotation_parse_findings(spark, sf):
    """What can't be read of annotations of many kinds."""
    k, n = F.col("event_id") % 7, (F.col("event_id") % 5).cast("int")
    item = F.col("event_id").cast("string")
    label = F.when(k == 0, "wild_radish").when(k == 1, "weed_LEP").when(k == 2, "tomato").when(k == 3, "grass_weed").when(k == 4, "ignore_region").when(k == 5, "other_weed")
    shape = F.when(k == 1, "points").when(k == 3, "bbox").when(k == 5, "polyline").otherwise("polygon")
    session = F.when(F.col("event_id") % 11 == 0, item).otherwise("s")
    notes = table(spark, sf, "events").select(item.alias("item_id"), session.alias("session_id"), label.alias("label"), shape.alias("type"), k.alias("label_id"), F.array_repeat(F.lit(1.0), n * 2).alias("points"))
    return contract.parse_findings(notes)


# ---------------------------------------------------------------- pictures
@query()
def measured_pictures(spark, sf):
    """Every vector drawn as a PNG file of 8 x 8 pixels, read back and measured."""
    from tessera.sources.images import measure_pictures, write_png

    def draw(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            grey = [np.resize(np.clip(np.asarray(v, float) * 64 + 128, 0, 255).astype(np.uint8), (8, 8)) for v in batch["embedding"]]
            yield pd.DataFrame({"path": batch["vec_id"].astype(str), "content": [write_png(g) for g in grey]})

    files = table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(draw, "path string, content binary")
    return measure_pictures(files)


@query()
def drawn_growth_points(spark, sf):
    """A growth point for every supplier, drawn as a disc with a bright middle."""
    from tessera.operators.growth import evidence_rows, growth_points

    def draw(batches):
        import numpy as np
        import pandas as pd

        y, x = np.mgrid[:24, :24]
        for batch in batches:
            out = []
            for k in batch["s_suppkey"]:
                u, v = 8 + k % 8, 8 + k // 8 % 8
                far = np.hypot(x - u, y - v)
                rgb = np.where((far < 7)[:, :, None], [40, 140, 40], [120, 100, 80]).astype(np.uint8)
                rgb[far < 2] = (150, 210, 70)
                out.append((k, 24, 24, (far < 7).astype(np.uint8).tobytes(), rgb.tobytes(), None, "wild_radish"))
            yield pd.DataFrame(out, columns=["plant", "height", "width", "mask", "rgb", "depth", "class_name"])

    plants = table(spark, sf, "supplier").select("s_suppkey").mapInPandas(draw, "plant long, height int, width int, mask binary, rgb binary, depth binary, class_name string")
    return growth_points(evidence_rows(plants)).withColumns({c: F.round(c, 3) for c in ("u", "v", "sigma", "agreement", "confidence")})
