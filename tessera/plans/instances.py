"""Queries on boxes, matches, metrics, safety and annotation findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import geometry as G
from tessera.operators import active, contract, folds, matching, metrics, windows
from tessera.plans.analogues import INSTANCES_SQL, IOU_SQL, instances, pairs, pairs_sql, sides
from tessera.session import materialise, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: One greedy pass over a frame's numbered pairs: a pair is taken if both sides are free.
GREEDY = """
o AS (SELECT frame{extra}, i, j, iou, row_number() OVER (PARTITION BY frame{extra} ORDER BY {order}) AS k FROM {source}),
t AS (SELECT frame{extra}, k, [i] AS us, [j] AS vs, true AS ok FROM o WHERE k = 1
  UNION ALL SELECT o.frame{oextra}, o.k, CASE WHEN list_contains(us, o.i) OR list_contains(vs, o.j) THEN us ELSE list_append(us, o.i) END,
    CASE WHEN list_contains(us, o.i) OR list_contains(vs, o.j) THEN vs ELSE list_append(vs, o.j) END, NOT (list_contains(us, o.i) OR list_contains(vs, o.j))
  FROM t JOIN o ON o.frame = t.frame{on} AND o.k = t.k + 1)"""
MATCHED = GREEDY.format(extra="", oextra="", on="", source="pairs", order="iou DESC, i DESC, j DESC")
BY_SCORE = GREEDY.format(extra=", cls", oextra=", o.cls", on=" AND o.cls = t.cls", source="pairs", order="score DESC, i, iou DESC, j DESC")


@query(f"WITH RECURSIVE {pairs_sql(0.5, True)}, {MATCHED} SELECT o.frame, o.i, o.j FROM t JOIN o ON o.frame = t.frame AND o.k = t.k WHERE t.ok")
def matched_instances(spark, sf):
    m = folds.greedy_match(pairs(spark, sf, 0.5, True), "frame")
    return m.select("frame", F.inline("matched"))


@query(f"WITH RECURSIVE {pairs_sql(0.5, True)}, {BY_SCORE} SELECT o.frame, o.cls, o.i, o.j FROM t JOIN o ON o.frame = t.frame AND o.cls = t.cls AND o.k = t.k WHERE t.ok")
def score_matched(spark, sf):
    m = folds.match_by_score(pairs(spark, sf, 0.5, True), ["frame", "cls"])
    return m.select("frame", "cls", F.inline("matched"))


@query(f"""WITH RECURSIVE {pairs_sql(0.5, True)}, {BY_SCORE},
hit AS (SELECT o.frame, o.i FROM t JOIN o ON o.frame = t.frame AND o.cls = t.cls AND o.k = t.k WHERE t.ok),
d AS (SELECT p.cls, p.frame, p.n AS i, p.score, h.i IS NOT NULL AS tp FROM instances p LEFT JOIN hit h ON h.frame = p.frame AND h.i = p.n WHERE NOT p.is_truth),
g AS (SELECT cls, count(*) AS n_gt FROM instances WHERE is_truth GROUP BY cls),
c AS (SELECT d.cls, n_gt, sum(tp::INT) OVER w AS tp, count(*) OVER w AS seen, row_number() OVER w AS k FROM d JOIN g USING (cls) WINDOW w AS (PARTITION BY cls ORDER BY score DESC, frame, i ROWS UNBOUNDED PRECEDING)),
p AS (SELECT cls, n_gt, tp / n_gt AS recall, max(tp / seen) OVER (PARTITION BY cls ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS precision FROM c),
q AS (SELECT cls, q.q, max(precision) AS best FROM p JOIN (SELECT i * 0.01::DOUBLE AS q FROM range(101) r(i)) q ON recall >= q.q GROUP BY ALL)
SELECT g.cls, g.n_gt, round(coalesce(sum(best), 0) / 101, 6) AS ap FROM g LEFT JOIN q ON q.cls = g.cls GROUP BY ALL""")
def average_precision(spark, sf):
    rows = materialise(instances(spark, sf), "instances")
    pred, truth = sides(spark, sf, rows)
    hits = folds.match_by_score(pairs(spark, sf, 0.5, True, rows), ["frame", "cls"]).select("frame", F.explode("matched.i").alias("i"), F.lit(True).alias("tp"))
    dets = pred.join(hits, ["frame", "i"], "left").select("cls", "frame", "i", "score", F.coalesce("tp", F.lit(False)).alias("tp"))
    n = truth.groupBy("cls").agg(F.count("*").alias("n_gt"))
    return windows.average_precision(dets, n, ["cls"], "score", "tp", ["frame", "i"]).withColumn("ap", F.round("ap", 6))


def confidence_counts(spark, sf, cuts, keys):
    """tp, fp and fn by keys and confidence. A frame is matched once, as pairs below a cut come
    after all above it; every row is counted for all cuts at once."""
    rows = materialise(instances(spark, sf), "instances")
    pred, truth = sides(spark, sf, rows)
    m = folds.match_by_score(pairs(spark, sf, 0.5, True, rows), ["frame", "cls"], carry="score").select("frame", "cls", F.explode("matched.score").alias("score"))
    sides_ = {"tp": m.select("frame", "cls", "score"), "np": pred.select("frame", "cls", "score"), "nt": truth.select("frame", "cls", F.lit(float("inf")).alias("score"))}
    every = contract.union_named(sides_, "what")
    n = lambda what, c: F.count_if((F.col("what") == what) & (F.col("score") >= c))
    counts = every.groupBy(*keys).agg(F.array(*[F.struct(F.lit(float(c)).alias("conf"), *[n(w, c).alias(w) for w in sides_]) for c in cuts]).alias("s")).select(*keys, F.inline("s"))
    return counts.select(*keys, "conf", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"))


SWEEP = GREEDY.format(extra=", cls, conf", oextra=", o.cls, o.conf", on=" AND o.cls = t.cls AND o.conf = t.conf", source="pc", order="score DESC, i, iou DESC, j DESC")


@query(f"""WITH RECURSIVE {pairs_sql(0.5, True)}, cuts AS (SELECT unnest([0.0, 0.03, 0.06, 0.09])::DOUBLE AS conf), pc AS (SELECT * FROM pairs JOIN cuts ON score >= conf), {SWEEP},
m AS (SELECT cls, conf, count(*) AS tp FROM t WHERE ok GROUP BY ALL),
p AS (SELECT cls, conf, count(*) AS np FROM instances JOIN cuts ON score >= conf WHERE NOT is_truth GROUP BY ALL), g AS (SELECT cls, conf, count(*) AS nt FROM instances CROSS JOIN cuts WHERE is_truth GROUP BY ALL)
SELECT cls, conf, tp, np - tp AS fp, nt - tp AS fn, round(tp / np, 6) AS precision, round(tp / nt, 6) AS recall, round(2 * tp / (np + nt), 6) AS f1 FROM m JOIN p USING (cls, conf) JOIN g USING (cls, conf)""")
def confidence_sweep(spark, sf):
    return metrics.operating_point(confidence_counts(spark, sf, (0.0, 0.03, 0.06, 0.09), ["cls"]), ["cls", "conf"])


@query(f"""WITH RECURSIVE {pairs_sql(0.5, True)}, {MATCHED}, hit AS (SELECT o.frame, o.iou FROM t JOIN o ON o.frame = t.frame AND o.k = t.k WHERE t.ok),
c AS (SELECT unnest([0.5, 0.6, 0.75, 0.9])::DOUBLE AS threshold), n AS (SELECT count(*) FILTER (NOT is_truth) AS n_pred, count(*) FILTER (is_truth) AS n_gt FROM instances), z AS (SELECT threshold, count(iou) AS tp FROM c LEFT JOIN hit ON iou >= threshold GROUP BY threshold)
SELECT threshold, tp, n_pred - tp AS fp, n_gt - tp AS fn, round(tp / (n_pred + n_gt - tp), 6) AS jaccard FROM z CROSS JOIN n""")
def jaccard_by_threshold(spark, sf):
    rows = materialise(instances(spark, sf), "instances")
    m = folds.match_pairs(pairs(spark, sf, 0.5, True, rows), "frame", [-F.col("iou"), -F.col("i"), -F.col("j")], carry="iou").select(F.explode("matched.iou").alias("iou"))
    n = rows.agg(F.count_if(~F.col("is_truth")).alias("n_pred"), F.count_if("is_truth").alias("n_gt"))
    out = metrics.counts_at_thresholds(m.crossJoin(F.broadcast(n)).withColumn("all", F.lit(1)), (0.5, 0.6, 0.75, 0.9), ["all"])
    return out.select("threshold", "tp", "fp", "fn", F.round("jaccard", 6).alias("jaccard"))


def nms_sql(order, test):
    return f"""WITH RECURSIVE {INSTANCES_SQL}, b AS (SELECT frame, (2 * n + is_truth::INT)::BIGINT AS key, x, y, w, h, row_number() OVER (PARTITION BY frame ORDER BY {order}, 2 * n + is_truth::INT) AS k FROM instances),
t AS (SELECT frame, k, [{{'x': x, 'y': y, 'w': w, 'h': h, 'key': key}}] AS kept FROM b WHERE k = 1
  UNION ALL SELECT a.frame, a.k, CASE WHEN len(list_filter(kept, lambda b: {IOU_SQL} {test})) > 0 THEN kept ELSE list_append(kept, {{'x': a.x, 'y': a.y, 'w': a.w, 'h': a.h, 'key': a.key}}) END FROM t JOIN b a ON a.frame = t.frame AND a.k = t.k + 1)
SELECT frame, unnest(list_transform(kept, lambda v: v.key)) AS key FROM t WHERE (frame, k) IN (SELECT frame, max(k) FROM t GROUP BY frame)"""


def keyed(spark, sf):
    return instances(spark, sf).withColumn("key", 2 * F.col("n") + F.col("is_truth").cast("long"))


@query(nms_sql("score DESC", ">= 0.85"))
def duplicates_suppressed(spark, sf):
    kept = folds.suppress(keyed(spark, sf), "frame", "key", [-F.col("score"), F.col("key")], 0.85)
    return kept.select("frame", F.explode("kept").alias("key"))


@query(nms_sql("w * h DESC", "> 0.6"))
def largest_first(spark, sf):
    kept = folds.suppress(keyed(spark, sf), "frame", "key", [-(F.col("w") * F.col("h")), F.col("key")], 0.6, strict=True)
    return kept.select("frame", F.explode("kept").alias("key"))


@query(f"""WITH {INSTANCES_SQL}, c AS (SELECT a.frame, a.n AS i, b.n AS j,
  greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS inter, a.w * a.h AS pa, b.w * b.h AS ta
  FROM instances a JOIN instances b ON a.frame = b.frame AND NOT a.is_truth AND b.is_truth)
SELECT frame, 'merge' AS kind, i AS instance, count(*) AS n FROM c WHERE inter >= 0.5 * ta AND inter > 0 GROUP BY ALL HAVING count(*) >= 2
UNION ALL SELECT frame, 'fragment', j, count(*) FROM c WHERE inter >= 0.5 * pa AND inter > 0 GROUP BY ALL HAVING count(*) >= 2""")
def identity_errors(spark, sf):
    pred, truth = sides(spark, sf)
    p, t = pred.alias("p"), truth.alias("t")
    box = lambda a: [F.col(f"{a}.{c}") for c in "xywh"]
    both = p.join(t, (F.col("p.frame") == F.col("t.frame")) & G.boxes_overlap(*box("p"), *box("t")))
    px, py, pw, ph, tx, ty, tw, th = *box("p"), *box("t")
    inter = (F.least(px + pw, tx + tw) - F.greatest(px, tx)) * (F.least(py + ph, ty + th) - F.greatest(py, ty))
    rows = both.select(F.col("p.frame").alias("frame"), "i", "j", (inter / (tw * th)).alias("of_truth"), (inter / (pw * ph)).alias("of_pred"))
    return metrics.identity_errors(rows, "frame")


@query(f"""WITH {INSTANCES_SQL}, e AS (SELECT frame, n, cls, score * 100 + 1 AS sigma, l_tax * 50 + score AS error FROM instances),
r AS (SELECT *, ntile(5) OVER (ORDER BY sigma, frame, n, error) AS bin FROM e) SELECT bin, count(*) AS n, round(avg(sigma), 3) AS mean_sigma, round(avg(error), 3) AS mean_error FROM r GROUP BY bin""")
def calibration_bins(spark, sf):
    binned = metrics.calibration_bins(errors(spark, sf), "sigma", "error", "tie")
    return binned.select(F.col("bin").cast("long").alias("bin"), "n", F.round("mean_sigma", 3).alias("mean_sigma"), F.round("mean_error", 3).alias("mean_error"))


def errors(spark, sf):
    rows = instances(spark, sf).withColumn("sigma", F.col("score") * 100 + 1).withColumn("error", F.col("l_tax") * 50 + F.col("score"))
    return rows.withColumn("tie", F.struct("frame", "n", "error")).withColumn("radius", 2.0 + F.col("w") / 10)


@query(f"""WITH {INSTANCES_SQL}, e AS (SELECT frame, n, score * 100 + 1 AS sigma, l_tax * 50 + score AS error FROM instances), r AS (SELECT row_number() OVER (ORDER BY sigma, frame, n, error) AS a, row_number() OVER (ORDER BY error, frame, n) AS b FROM e)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def calibration_rank(spark, sf):
    return metrics.calibration_rank(errors(spark, sf), "sigma", "error", "tie")


@query(f"""WITH {INSTANCES_SQL}, e AS (SELECT cls, l_tax * 50 + score AS error, 2.0::DOUBLE + w / 10 AS radius FROM instances)
SELECT cls, count(*) AS n, round(avg(error), 6) AS mean, round(quantile_cont(error, 0.5), 6) AS median, round(quantile_cont(error, 0.95), 6) AS p95, round(avg((error <= 1)::INT), 6) AS within_1, round(avg((error <= 3)::INT), 6) AS within_3,
  round(avg((error <= 0.1::DOUBLE * radius)::INT), 6) AS within_10pct, round(avg((error <= 0.25::DOUBLE * radius)::INT), 6) AS within_25pct, round(avg((error <= 0.5::DOUBLE * radius)::INT), 6) AS within_50pct FROM e GROUP BY cls""")
def point_errors(spark, sf):
    return metrics.error_summary(errors(spark, sf), ["cls"], "error", "radius", within=(1, 3))


@query("""WITH l AS (SELECT unnest(['load', 'infer', 'post']) AS stage, unnest([value, CASE WHEN event_id % 4 <> 0 THEN value * 2 END, CASE WHEN event_id % 3 = 0 THEN value / 2 END]) AS ms FROM events)
SELECT stage, count(ms) AS n, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95 FROM l WHERE ms IS NOT NULL GROUP BY stage""")
def stage_latency(spark, sf):
    v, k = F.col("value"), F.col("event_id")
    entries = F.array_compact(F.array(F.struct(F.lit("load").alias("k"), v.alias("v")), F.when(k % 4 != 0, F.struct(F.lit("infer").alias("k"), (v * 2).alias("v"))), F.when(k % 3 == 0, F.struct(F.lit("post").alias("k"), (v / 2).alias("v")))))
    return metrics.stage_latency(table(spark, sf, "events").select(F.map_from_entries(entries).alias("m")), "m")


@query(f"""WITH {INSTANCES_SQL}, b AS (SELECT * FROM (VALUES (0, 0.0, 150.0), (1, 150.0, 300.0), (2, 300.0, 500.0), (3, 500.0, 5000.0), (4, 5000.0, 9000.0)) v(bucket, lo, hi)),
g AS (SELECT bucket, count(*) AS n, count(*) FILTER (l_partkey % 3 <> 0) AS f FROM instances JOIN b ON w * h >= lo AND w * h < hi WHERE is_truth GROUP BY bucket)
SELECT bucket, lo::DOUBLE AS lo, hi::DOUBLE AS hi, coalesce(n, 0) AS n, round(f / n, 6) AS recall FROM b LEFT JOIN g USING (bucket)""")
def recall_by_size(spark, sf):
    rows = instances(spark, sf).filter("is_truth").withColumn("area", F.col("w") * F.col("h")).withColumn("found", F.col("l_partkey") % 3 != 0)
    return metrics.recall_by_size(rows, "area", "found", (0, 150, 300, 500, 5000, 9000))


@query("""WITH q AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS pred, (sum(l_quantity) + count(*) * (l_orderkey % 9) * 3)::BIGINT AS veg, count(*) AS n, avg(l_discount * 10) AS conf, l_orderkey % 3 AS suppressed FROM lineitem GROUP BY l_orderkey),
p AS (SELECT *, least(pred, veg) - l_orderkey % 7 AS shared FROM q),
f AS (SELECT *, coalesce(shared / nullif(pred, 0), 0) AS pr, CASE WHEN veg > 0 THEN shared / veg WHEN pred > 0 THEN 0 ELSE 1 END AS re, n / (n + suppressed) AS st FROM p),
s AS (SELECT *, 0.35::DOUBLE * pr + 0.35::DOUBLE * re + 0.2::DOUBLE * st + 0.1::DOUBLE * conf AS raw FROM f),
v AS (SELECT round(raw, 4) AS score, CASE WHEN veg = 0 THEN 'skip' WHEN pr < 0.55 OR re < 0.8 OR round(raw, 4) < 0.45 THEN 'review' WHEN round(raw, 4) >= 0.75 THEN 'accept' ELSE 'skip' END AS verdict FROM s)
SELECT verdict, count(*) AS n, list_sort(list(score))[least(count(*) - 1, floor(0.1::DOUBLE * count(*)))::INT + 1] AS p10, list_sort(list(score))[least(count(*) - 1, floor(0.5::DOUBLE * count(*)))::INT + 1] AS median,
  list_sort(list(score))[least(count(*) - 1, floor(0.9::DOUBLE * count(*)))::INT + 1] AS p90 FROM v GROUP BY verdict""")
def pseudo_verdicts(spark, sf):
    rows = pseudo_quality(spark, sf)
    return metrics.verdict_summary(rows.withColumn("verdict", C.pseudo_verdict(F.col("q.empty"), F.col("q.gates_failed"), F.col("q.score"))).withColumn("score", F.col("q.score")), "verdict", "score")


def pseudo_quality(spark, sf):
    k = F.col("l_orderkey")
    g = table(spark, sf, "lineitem").groupBy(k).agg(F.sum("l_quantity").cast("long").alias("pred"), F.count("*").alias("n"), F.avg(F.col("l_discount") * 10).alias("conf"))
    g = g.withColumn("veg", F.col("pred") + F.col("n") * (k % 9) * 3).withColumn("both", F.least("pred", "veg") - k % 7)
    return g.withColumn("q", C.frame_quality(F.col("both"), F.col("pred"), F.col("veg"), F.col("n"), k % 3, F.col("conf")))


@query("""WITH q AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS pred, (sum(l_quantity) + count(*) * (l_orderkey % 9) * 3)::BIGINT AS veg, count(*) AS n, avg(l_discount * 10) AS conf, l_orderkey % 3 AS suppressed FROM lineitem GROUP BY l_orderkey),
f AS (SELECT *, (least(pred, veg) - l_orderkey % 7) / pred AS pr, (least(pred, veg) - l_orderkey % 7) / veg AS re, n / (n + suppressed) AS st FROM q),
s AS (SELECT pr >= 0.55 AND re >= 0.8 AS ok, round(0.35::DOUBLE * pr + 0.35::DOUBLE * re + 0.2::DOUBLE * st + 0.1::DOUBLE * conf, 4) AS score FROM f)
SELECT cut, count(*) FILTER (ok AND score >= cut) AS accepted, greatest(0, 2 * 100 - count(*) FILTER (NOT ok))::INT AS budget FROM s CROSS JOIN (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS cut) GROUP BY cut""")
def accept_cuts(spark, sf):
    rows = pseudo_quality(spark, sf).withColumn("ok", F.size("q.gates_failed") == 0).withColumn("score", F.col("q.score"))
    budget = rows.agg(C.pseudo_budget(F.lit(100), F.count_if(~F.col("ok"))).cast("int").alias("budget"))
    return metrics.accept_sweep(rows, "score", F.col("ok")).crossJoin(F.broadcast(budget))


@query(f"""WITH {INSTANCES_SQL} SELECT CASE WHEN l_partkey % 50 = 0 THEN 'other_weed' WHEN l_suppkey % 6 >= 3 AND w * h >= 300 THEN 'weed_cluster' WHEN w / h >= 1.5 THEN 'grass_weed' ELSE 'other_weed' END AS class_name,
  CASE WHEN w * h <= 200 THEN 'cotyledon' WHEN w * h <= 400 THEN '2-leaf' ELSE '3-5-leaf' END AS stage, count(*) AS n, round(avg(CASE WHEN l_partkey % 50 = 0 THEN 0.0 WHEN l_suppkey % 6 >= 3 AND w * h >= 300 THEN round(least(1, 0.5::DOUBLE + 0.5::DOUBLE * ((l_suppkey % 6) / 3 - 1)), 3)
  WHEN w / h >= 1.5 THEN round(0.5::DOUBLE + 0.5::DOUBLE * least(1, (w / h) / 1.5::DOUBLE - 1), 3) ELSE 0.0 END), 4) AS confidence FROM instances GROUP BY ALL""")
def morphology(spark, sf):
    rows = instances(spark, sf)
    aspect = F.when(F.col("l_partkey") % 50 != 0, F.col("w") / F.col("h"))
    m = C.morphology_class(aspect, F.col("w") * F.col("h"), F.col("l_suppkey") % 6, 3, 300.0, 1.5)
    rows = rows.withColumn("m", m).withColumn("stage", C.growth_stage(F.col("w") * F.col("h"), 200, 400))
    return rows.groupBy(F.col("m.class_name").alias("class_name"), "stage").agg(F.count("*").alias("n"), F.round(F.avg("m.confidence"), 4).alias("confidence"))


LIMITS = {"class_confidence": 0.02, "peak": 0.03, "sigma": 6.0, "snap": 2.0, "crop_margin": 12.0, "valid_fraction": 0.3, "spread": 25.0, "sigma_3d": 4.0}
SAFETY = f"""{INSTANCES_SQL}, c AS (SELECT *, CASE cls WHEN 'A' THEN 'onion_plant' WHEN 'R' THEN 'weed_cluster' ELSE 'grass_weed' END AS class_name, l_partkey % 11 <> 0 AS has_lep, l_partkey % 9 AS sigma, l_suppkey % 8 - 3 AS signed,
  l_partkey % 13 <> 0 AS crop_mask, l_partkey % 40 AS crop_distance, l_suppkey % 5 <> 0 AS depth_ok, l_partkey % 4 AS why, (l_suppkey % 10) / 10.0::DOUBLE AS valid, l_quantity AS spread, l_tax * 60 AS s3 FROM instances),
e AS (SELECT *, [CASE WHEN class_name = 'onion_plant' THEN 'onion_plant' END, CASE WHEN class_name = 'weed_cluster' THEN 'weed_cluster' END, CASE WHEN score < 0.02 THEN 'class_uncertain' END, CASE WHEN l_partkey % 17 = 0 THEN 'lep_not_visible' END,
  CASE WHEN l_partkey % 19 IN (0, 1) THEN 'not_targetable' END] AS early, [CASE WHEN l_tax < 0.03 THEN 'low_lep_confidence' END, CASE WHEN sigma > 6 THEN 'high_heatmap_uncertainty' END, CASE WHEN signed < -2 THEN 'outside_owning_mask' END,
  CASE WHEN NOT crop_mask THEN 'crop_protection_unavailable' END, CASE WHEN crop_mask AND crop_distance <= 12 THEN 'onion_safety_conflict' END, CASE WHEN NOT depth_ok THEN CASE WHEN why = 0 THEN 'depth_discontinuity' ELSE 'insufficient_valid_depth' END END,
  CASE WHEN depth_ok AND valid < 0.3 THEN 'insufficient_valid_depth' END, CASE WHEN depth_ok AND spread > 25 THEN 'depth_discontinuity' END, CASE WHEN depth_ok AND s3 > 4 THEN 'high_3d_uncertainty' END] AS late FROM c),
r AS (SELECT frame, n, is_truth, l_partkey, list_filter(CASE WHEN has_lep THEN list_concat(early, late) ELSE list_append(early, 'no_lep_predicted') END, lambda x: x IS NOT NULL) AS reasons FROM e)"""


def decided(spark, sf):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    rows = instances(spark, sf).withColumn("class_name", F.when(F.col("cls") == "A", "onion_plant").when(F.col("cls") == "R", "weed_cluster").otherwise("grass_weed"))
    lep = F.when(part % 11 != 0, F.struct(F.col("l_tax").alias("peak"), (part % 9).cast("double").alias("sigma")))
    depth = F.struct((supp % 5 != 0).alias("ok"), F.when(part % 4 == 0, "depth_discontinuity").otherwise("few").alias("reason"), ((supp % 10) / 10.0).alias("valid_fraction"), F.col("l_quantity").alias("spread"), (F.col("l_tax") * 60).alias("sigma"))
    reasons = contract.safety_reasons(F.col("class_name"), F.col("score"), lep, (supp % 8 - 3).cast("double"), part % 13 != 0, (part % 40).cast("double"), depth, LIMITS, F.when(part % 17 == 0, "not_visible").otherwise("visible"), F.when(part % 19 == 0, "no").when(part % 19 == 1, "uncertain").otherwise("yes"))
    return rows.withColumn("reasons", reasons).withColumn("candidate", F.size("reasons") == 0)


@query(f"WITH {SAFETY} SELECT frame, n, is_truth, array_to_string(list_filter(reasons, lambda x, i: list_position(reasons, x) = i), ',') AS reasons FROM r")
def safety_decisions(spark, sf):
    return decided(spark, sf).select("frame", "n", "is_truth", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {SAFETY} SELECT reason, count(*) AS n FROM (SELECT unnest(list_distinct(reasons)) AS reason FROM r) GROUP BY reason")
def rejection_reasons(spark, sf):
    return metrics.reason_counts(decided(spark, sf), "reasons")


@query(f"""WITH {SAFETY}, s AS (SELECT len(reasons) = 0 AS c, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey % 3 <> 0 END AS safe FROM r)
SELECT count(*) AS n, count(*) FILTER (c) AS candidates, round(count(*) FILTER (c) / greatest(1, count(*)), 6) AS candidate_rate, round(count(*) FILTER (c AND safe = false) / greatest(1, count(*) FILTER (c)), 6) AS unsafe_rate,
  round(count(*) FILTER (c AND safe = false) / nullif(count(*) FILTER (c AND safe IS NOT NULL), 0), 6) AS unsafe_of_known FROM s""")
def safety_rates(spark, sf):
    part = F.col("l_partkey")
    return metrics.safety_summary(decided(spark, sf).withColumn("safe", F.when(part % 5 != 0, part % 3 != 0)), "candidate", "reasons", "safe")


@query(f"""WITH {INSTANCES_SQL}, m AS (SELECT cls, w * h AS a, w * h - l_partkey % 30 AS b, greatest(0, w * h - l_partkey % 90) AS shared FROM instances WHERE l_suppkey % 7 <> 0 UNION ALL SELECT cls, 0, 0, 0 FROM instances WHERE l_suppkey % 7 = 0),
i AS (SELECT cls, CASE WHEN a + b - shared = 0 THEN 1 ELSE shared / (a + b - shared) END AS iou FROM m)
SELECT cls, count(*) AS n, round(avg(iou), 6) AS mean_iou, round(quantile_cont(iou, 0.5), 6) AS median_iou, round(avg((iou >= 0.9)::INT), 6) AS share_90 FROM i GROUP BY cls""")
def mask_agreement(spark, sf):
    full = F.col("l_suppkey") % 7 != 0
    area = F.col("w") * F.col("h")
    rows = instances(spark, sf).select("cls", F.when(full, area).otherwise(0.0).alias("a"), F.when(full, area - F.col("l_partkey") % 30).otherwise(0.0).alias("b"), F.when(full, F.greatest(F.lit(0.0), area - F.col("l_partkey") % 90)).otherwise(0.0).alias("both"))
    return metrics.agreement(rows, ["cls"], "both", "a", "b")


@query(f"""WITH {INSTANCES_SQL}, v AS (SELECT *, CASE cls WHEN 'A' THEN 'onion_plant' WHEN 'R' THEN 'weed_cluster' ELSE 'grass_weed' END AS class_name, l_partkey % 3 <> 0 AS has, x + l_suppkey % 30 AS px, y + h / 2 + 0.25::DOUBLE AS py, l_partkey % 7 AS edge FROM instances WHERE is_truth),
o AS (SELECT *, has AND NOT (px >= x AND px < x + w) AS outside FROM v)
SELECT frame, 'warning' AS severity, 'tiny_instance' AS kind, n || ':' || class_name AS detail FROM o WHERE w * h < 150 UNION ALL SELECT frame, 'error', 'lep_on_onion', n || ':' || class_name FROM o WHERE has AND class_name = 'onion_plant'
UNION ALL SELECT frame, 'error', 'lep_on_cluster', n || ':' || class_name FROM o WHERE has AND class_name = 'weed_cluster' UNION ALL SELECT frame, 'error', 'lep_outside_owning_mask', n || ':' || class_name FROM o WHERE outside
UNION ALL SELECT frame, 'warning', 'lep_near_mask_edge', n || ':' || class_name FROM o WHERE has AND NOT outside AND edge < 3
UNION ALL SELECT frame, 'error', 'missing_lep', n || ':' || class_name FROM o WHERE NOT has AND class_name = 'grass_weed' AND l_suppkey % 4 <> 0 AND l_suppkey % 9 <> 0""")
def annotation_findings(spark, sf):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    has = part % 3 != 0
    rows = instances(spark, sf).filter("is_truth").withColumn("class_name", F.when(F.col("cls") == "A", "onion_plant").when(F.col("cls") == "R", "weed_cluster").otherwise("grass_weed"))
    rows = rows.select("frame", F.col("n").alias("k"), "class_name", (F.col("w") * F.col("h")).alias("area"), G.box_polygon(*[F.col(c) for c in "xywh"]).alias("polygon"), F.when(has, F.col("x") + supp % 30).alias("px"), F.when(has, F.col("y") + F.col("h") / 2 + 0.25).alias("py"), (part % 7).alias("edge_distance"), F.when(supp % 4 == 0, "not_visible").otherwise("visible").alias("visibility"), F.when(supp % 9 == 0, "no").otherwise("yes").alias("targetable"))
    return contract.instance_findings(rows, least_area=150.0)


@query(f"""WITH {INSTANCES_SQL}, r AS (SELECT frame, (row_number() OVER (PARTITION BY frame ORDER BY n))::INT - 1 AS instance_index, cls, x + w / 2 AS u, y + h / 2 AS v, l_partkey FROM instances WHERE is_truth)
SELECT frame, instance_index, cls, u, v FROM r WHERE cls <> 'A' AND l_partkey % 3 <> 0""")
def point_manifest(spark, sf):
    """Rows of growth points; the index counts all instances of the frame."""
    rows = instances(spark, sf).filter("is_truth").withColumn("item", F.struct("n", "cls", (F.col("x") + F.col("w") / 2).alias("u"), (F.col("y") + F.col("h") / 2).alias("v"), "l_partkey"))
    g = rows.groupBy("frame").agg(F.array_sort(F.collect_list("item")).alias("items")).select("frame", F.posexplode("items").alias("instance_index", "a"))
    return g.filter("a.cls <> 'A' AND a.l_partkey % 3 <> 0").select("frame", "instance_index", "a.cls", "a.u", "a.v")


@query("""WITH s AS (SELECT l_orderkey AS item, l_suppkey % 4 AS grp, l_linenumber AS k FROM lineitem WHERE l_linenumber % 2 = 1), p AS (SELECT l_orderkey AS item, l_suppkey % 4 AS grp, l_linenumber AS k FROM lineitem WHERE l_linenumber % 2 = 0),
a AS (SELECT item, grp, count(*) AS ns FROM s WHERE grp <> 0 GROUP BY ALL), b AS (SELECT item, grp, count(*) AS np FROM p GROUP BY ALL)
SELECT coalesce(a.item, b.item) AS item, coalesce(a.grp, b.grp) AS grp, CASE WHEN coalesce(a.grp, b.grp) = 0 THEN 'ungrouped_point' WHEN ns IS NULL THEN 'point_without_plant' WHEN np > 1 THEN 'several_points' ELSE 'several_plants' END AS kind
FROM a FULL JOIN b ON a.item = b.item AND a.grp = b.grp WHERE coalesce(a.grp, b.grp) = 0 OR ns IS NULL OR np > 1 OR (ns > 1 AND np IS NOT NULL)""")
def grouping_findings(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_suppkey") % 4).alias("grp"), F.col("l_linenumber").alias("k"))
    return matching.group_points(li.filter("k % 2 = 1"), li.filter("k % 2 = 0"), "item", "grp")[1]


@query(f"""WITH {INSTANCES_SQL}, d AS (SELECT a.frame, a.n AS k, b.n AS j, sqrt(pow(a.x - (b.x + b.w / 2), 2) + pow(a.y - (b.y + b.h / 2), 2)) AS d FROM instances a LEFT JOIN instances b ON a.frame = b.frame AND b.is_truth WHERE NOT a.is_truth)
SELECT frame, k, coalesce(arg_min(j, {{'d': d, 'j': j}}), -1) AS owner, coalesce(round(min(d), 6), -1) AS distance FROM d GROUP BY ALL""")
def nearest_owners(spark, sf):
    pred, truth = sides(spark, sf)
    out = matching.nearest_owner(pred.select("frame", F.col("i").alias("k"), F.col("x").alias("px"), F.col("y").alias("py")), truth.select("frame", "j", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy")), "frame")
    return out.select("frame", "k", F.coalesce("owner", F.lit(-1)).alias("owner"), F.coalesce(F.round("distance", 6), F.lit(-1.0)).alias("distance"))


@query(f"""WITH {INSTANCES_SQL}, f AS (SELECT frame, bool_or(NOT is_truth) AS p, bool_or(is_truth) AS t FROM instances GROUP BY frame) SELECT count(*) FILTER (p AND t) AS "both", count(*) FILTER (p AND NOT t) AS only_pred, count(*) FILTER (t AND NOT p) AS only_truth FROM f""")
def frames_by_side(spark, sf):
    return matching.sided_frames(*sides(spark, sf), "frame")


@query(f"""WITH {INSTANCES_SQL}, g AS (SELECT frame, count(*) AS n FROM instances a WHERE cls = 'N' AND EXISTS (SELECT 1 FROM instances b WHERE b.frame = a.frame AND b.cls = 'A' AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h) GROUP BY frame) SELECT frame, n FROM g""")
def touching_crop(spark, sf):
    rows = instances(spark, sf)
    a, b = rows.filter("cls = 'N'").alias("a"), rows.filter("cls = 'A'").alias("b")
    box = lambda t: [F.col(f"{t}.{c}") for c in "xywh"]
    hit = a.join(b, (F.col("a.frame") == F.col("b.frame")) & G.boxes_overlap(*box("a"), *box("b")), "left_semi")
    return hit.groupBy("frame").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT ps_session AS session_id, frame, px, row_number() OVER (PARTITION BY ps_session ORDER BY px DESC, frame) AS k FROM (SELECT o_custkey % 40 AS ps_session, o_orderkey AS frame, (o_totalprice::BIGINT % 5000) - 500 AS px FROM orders) WHERE px > 0)
SELECT session_id, frame, px FROM p WHERE k <= 8 ORDER BY px DESC, frame LIMIT 100""")
def contact_ranking(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("session_id"), F.col("o_orderkey").alias("frame"), (F.bround("o_totalprice", 0).cast("long") % 5000 - 500).alias("px"))
    return active.contact_rank(rows, "session_id", "px", "frame", 8, 100)


@query("""WITH c AS (SELECT o_orderkey, o_orderpriority AS label FROM orders), n AS (SELECT greatest(1, floor(count(*) * 0.15::DOUBLE)) AS cap FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o_orderkey) AS k FROM c) SELECT o_orderkey, label FROM r, n WHERE k <= cap""")
def class_capped(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    return windows.class_share_cap(rows, "label", "o_orderkey", 0.15)


@query(f"""WITH {INSTANCES_SQL}, r AS (SELECT frame, n, score, row_number() OVER (PARTITION BY frame ORDER BY score DESC, n, w) AS k FROM instances WHERE NOT is_truth) SELECT frame, n, score FROM r WHERE k <= 2""")
def best_detections(spark, sf):
    rows = instances(spark, sf).filter("NOT is_truth")
    return windows.capped_top(rows, "frame", [F.desc("score"), F.col("n"), F.col("w")], 2).select("frame", "n", "score")


@query(f"""WITH {INSTANCES_SQL}, a AS (SELECT frame, n, (w * h) AS area, list_value(x, y, x + w, y, x + w, y + h, x, y + h) AS p FROM instances WHERE is_truth)
SELECT frame, n, area, p[1] AS bx, p[2] AS b_y, p[3] - p[1] AS bw, p[6] - p[2] AS bh, true AS centre_inside, false AS far_inside FROM a""")
def polygon_measures(spark, sf):
    rows = instances(spark, sf).filter("is_truth").withColumn("p", G.box_polygon(*[F.col(c) for c in "xywh"]))
    b = G.polygon_box(F.col("p"))
    inside = G.point_in_polygon(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("p"))
    return rows.select("frame", "n", G.polygon_area(F.col("p")).alias("area"), b.x.alias("bx"), b.y.alias("b_y"), b.w.alias("bw"), b.h.alias("bh"), inside.alias("centre_inside"), G.point_in_polygon(F.lit(1e6), F.lit(1.5), F.col("p")).alias("far_inside"))


@query(f"""WITH {INSTANCES_SQL}, l AS (SELECT frame, n, list_transform([x, y, x + w, y, x + w, y + h, x, y + h], lambda v, i: printf('%.6f', least(greatest(v / CASE WHEN i % 2 = 1 THEN 64.0 ELSE 32.0 END, 0), 1))) AS p, CASE cls WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c FROM instances WHERE is_truth)
SELECT frame, string_agg(c || ' ' || array_to_string(p, ' '), chr(10) ORDER BY n) AS text FROM l GROUP BY frame""")
def label_text(spark, sf):
    from tessera.sources.sinks import yolo_labels

    rows = instances(spark, sf).filter("is_truth").select("frame", "n", F.when(F.col("cls") == "A", 0).when(F.col("cls") == "N", 1).otherwise(2).alias("c"), F.array(G.box_polygon(*[F.col(c) for c in "xywh"])).alias("polygons"), F.lit(64).alias("width"), F.lit(32).alias("height"))
    return yolo_labels(rows, "frame", "n", "c", "polygons", "width", "height")


@query(f"""WITH {INSTANCES_SQL} SELECT row_number() OVER (ORDER BY frame, n) AS id, frame, cls, w * h AS area, x, y, w, h FROM instances WHERE is_truth AND l_suppkey % 8 <> 0""")
def coco_rows(spark, sf):
    """Instances without area take no id."""
    from tessera.sources.sinks import coco_annotations

    wide = F.when(F.col("l_suppkey") % 8 == 0, 0.0).otherwise(F.col("w"))
    rows = instances(spark, sf).filter("is_truth").select("frame", "n", "cls", F.array(G.box_polygon(F.col("x"), F.col("y"), wide, F.col("h"))).alias("polygons"))
    out = coco_annotations(rows, "frame", "n", "cls", "polygons")
    return out.select("id", "frame", "cls", "area", *[F.get("bbox", F.lit(k)).alias(c) for k, c in enumerate("xywh")])


@query("""WITH d AS (SELECT l_orderkey AS frame, l_extendedprice % 500 + 500 AS v, l_quantity AS w FROM lineitem), s AS (SELECT frame, list_sort(list({'v': v, 'w': w})) AS p, count(*) AS n, sum(w) AS total FROM d GROUP BY frame),
u AS (SELECT frame, n, total, p, unnest(range(1, n + 1)) AS k FROM s), r AS (SELECT frame, k, n, total, p[k].v AS v, list_sum(list_transform(p[1:k], lambda x: x.w)) AS run, p[k].v - p[k - 1].v AS gap FROM u),
m AS (SELECT frame, min(v) FILTER (run >= total / 2) AS median, coalesce(bool_or(k > 1 AND gap > 25 AND least(k - 1, n - k + 1) >= 0.15::DOUBLE * n), false) AS discontinuous FROM r GROUP BY frame)
SELECT m.frame, round(median, 6) AS median, round(1.4826::DOUBLE * (SELECT quantile_cont(abs(d.v - m.median), 0.5) FROM d WHERE d.frame = m.frame), 6) AS spread, discontinuous FROM m""")
def depth_at_point(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.collect_list(F.struct((F.col("l_extendedprice") % 500 + 500).alias("v"), F.col("l_quantity").alias("w"))).alias("a"))
    d = folds.largest_gap(F.transform("a", lambda x: x.v), F.transform("a", lambda x: x.w), 25.0, 0.15)
    return g.select("frame", d.alias("d")).select("frame", F.round("d.median", 6).alias("median"), F.round("d.spread", 6).alias("spread"), F.col("d.discontinuous").alias("discontinuous"))


@query(f"""WITH {INSTANCES_SQL}, r AS (SELECT frame, n, w, h, greatest(least(3 + w, 5 + h) - 5, 0) AS inter FROM instances WHERE is_truth) SELECT frame, n, inter / (w + h - inter) AS iou, w::BIGINT AS area FROM r""")
def run_length_overlap(spark, sf):
    """Overlap of decoded run-length masks, in Arrow batches."""
    from tessera.operators.kernels import rle_iou

    rows = instances(spark, sf).filter("is_truth").select("frame", "n", F.array(F.lit(3), F.col("w").cast("int"), F.lit(200) - F.col("w").cast("int")).alias("a"), F.array(F.lit(5), F.col("h").cast("int"), F.lit(200) - F.col("h").cast("int")).alias("b"))
    return rows.select("frame", "n", rle_iou("a", "b", F.lit(20), F.lit(20)).alias("iou"), G.rle_area(F.col("a")).alias("area"))


