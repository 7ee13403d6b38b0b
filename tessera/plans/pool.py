"""Queries on pools of frames: gates, curation, thinning, counts, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import folds, matching, metrics, splits, windows
from tessera.plans.analogues import LINE_KEY, POOL_SQL, frames, pool
from tessera.session import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def gated(spark, sf, **limits):
    gates = C.QC_GATES | limits
    cols = [F.col(c) for c in ("sharpness", "veg_frac", "clip_frac", "dark_frac", "depth")]
    return pool(spark, sf).withColumn("failures", C.gate_failures(*cols, gates))


FAIL = """[CASE WHEN sharpness < 60 THEN 'min_sharpness' END, CASE WHEN veg_frac < {veg} THEN 'min_veg_frac' END, CASE WHEN clip_frac > {clip} THEN 'max_clip_frac' END,
  CASE WHEN dark_frac > {dark} THEN 'max_dark_frac' END, CASE WHEN depth < 0.3 THEN 'min_depth_valid_frac_veg' END]"""
LOOSE, TIGHT = {"veg": 0.02, "clip": 0.15, "dark": 0.35}, {"veg": 0.2, "clip": 0.08, "dark": 0.06}
DIFFICULTY = """greatest(0, 1 - sharpness / 300) + 0.8::DOUBLE * least(1, clip_frac / 0.1::DOUBLE) + 0.6::DOUBLE * least(1, dark_frac / 0.3::DOUBLE) + coalesce(1.2::DOUBLE * (1 - depth), 0)"""


@query(f"""WITH {POOL_SQL}, g AS (SELECT session_id, len(list_filter({FAIL.format(**LOOSE)}, lambda f: f IS NOT NULL)) = 0 AS ok, {DIFFICULTY} AS d FROM pool)
SELECT session_id, count(*) AS pool, count(*) FILTER (ok) AS passed_gates, round(avg(ok::INT), 6) AS pass_rate, round(avg(d), 6) AS mean_difficulty FROM g GROUP BY session_id""")
def pool_stats(spark, sf):
    rows = gated(spark, sf).withColumn("difficulty", C.difficulty(F.col("sharpness"), F.col("clip_frac"), F.col("dark_frac"), F.col("depth")))
    return metrics.session_stats(rows, "session_id", F.size("failures") == 0, "difficulty")


@query(f"""WITH {POOL_SQL}, g AS (SELECT *, list_filter({FAIL.format(**TIGHT)}, lambda f: f IS NOT NULL) AS failures FROM pool),
n AS (SELECT gate, count(*) AS rejected FROM (SELECT unnest(failures) AS gate FROM g) GROUP BY gate),
v AS (SELECT 'min_sharpness' AS gate, sharpness AS v FROM g UNION ALL SELECT 'min_veg_frac', veg_frac FROM g UNION ALL SELECT 'max_clip_frac', clip_frac FROM g
  UNION ALL SELECT 'max_dark_frac', dark_frac FROM g UNION ALL SELECT 'min_depth_valid_frac_veg', depth FROM g WHERE depth IS NOT NULL),
h AS (SELECT gate, list_sort(list(v))[floor(0.9::DOUBLE * (count(*) - 1))::INT + 1] AS hint FROM v GROUP BY gate)
SELECT gate, rejected, hint FROM n LEFT JOIN h USING (gate)""")
def gate_rejections(spark, sf):
    rows = gated(spark, sf, min_veg_frac=0.2, max_clip_frac=0.08, max_dark_frac=0.06)
    measure = {"min_sharpness": "sharpness", "min_veg_frac": "veg_frac", "max_clip_frac": "clip_frac", "max_dark_frac": "dark_frac", "min_depth_valid_frac_veg": "depth"}
    return metrics.gate_histogram(rows, "failures", measure)


@query(f"""WITH {POOL_SQL}, g AS (SELECT *, {DIFFICULTY} AS d FROM pool WHERE len(list_filter({FAIL.format(**LOOSE)}, lambda f: f IS NOT NULL)) = 0 AND session_id % 5 <> 0)
SELECT session_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(d, 6) AS difficulty, row_number() OVER (ORDER BY round(d, 9) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place
FROM g QUALIFY place <= 240""")
def stress_cut(spark, sf):
    """The hardest frames outside held-out sessions: a top-k report."""
    rows = gated(spark, sf).filter((F.size("failures") == 0) & (F.col("session_id") % 5 != 0))
    rows = rows.withColumn("d", C.difficulty(F.col("sharpness"), F.col("clip_frac"), F.col("dark_frac"), F.col("depth")))
    top = rows.orderBy(F.desc(F.round("d", 9)), *LINE_KEY).limit(240)
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc(F.round("d", 9)), *LINE_KEY)).cast("long")
    return top.select("session_id", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round("d", 6).alias("difficulty"), place.alias("place"))


@query("""WITH f AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN 'x' ELSE event_id || '.9' END AS idx_text,
  'u_' || user_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE '_' || lpad(event_id::VARCHAR, 6, '0') END || '.png' AS name,
  CASE event_id % 4 WHEN 0 THEN ' true ' WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE 'True' END AS flag FROM events)
SELECT event_id, name, coalesce(floor(TRY_CAST(idx_text AS DOUBLE))::INT, TRY_CAST(nullif(regexp_extract(name, '(?:^|_)(\\d+)\\.png$', 1), '') AS INT), -1) AS idx,
  coalesce(TRY_CAST(nullif(regexp_extract(name, '(?:^|_)(\\d+)\\.png$', 1), '') AS INT), -1) AS name_idx, coalesce(trim(flag) IN ('1', 'true', 'True'), false) AS dropped FROM f""")
def frame_indices(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    text = F.when(k % 5 == 0, "").when(k % 5 == 1, "x").otherwise(F.concat(k.cast("string"), F.lit(".9")))
    tail = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("_"), F.lpad(k.cast("string"), 6, "0")))
    name = F.concat(F.lit("u_"), F.col("user_id").cast("string"), tail, F.lit(".png"))
    flag = F.when(k % 4 == 0, " true ").when(k % 4 == 1, "0").when(k % 4 == 3, "True")
    rows = e.select(k, text.alias("t"), name.alias("name"), flag.alias("flag"))
    return rows.select("event_id", "name", C.frame_index(F.col("t"), F.col("name")).alias("idx"), C.index_of(F.col("name")).alias("name_idx"), C.is_dropped(F.col("flag")).alias("dropped"))


@query("""WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN '' WHEN 2 THEN 'LOST' ELSE 'SEARCHING_FLOOR_PLANE ' END AS state,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS x, (event_id % 100)::DOUBLE AS y, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE 1.0::DOUBLE END AS z FROM events)
SELECT event_id, CASE WHEN (trim(state) IN ('', 'OK', 'SEARCHING_FLOOR_PLANE')) AND x IS NOT NULL AND NOT isnan(z) THEN x END AS px FROM p""")
def usable_poses(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select(k, F.when(k % 4 == 0, "OK").when(k % 4 == 1, "").when(k % 4 == 2, "LOST").otherwise("SEARCHING_FLOOR_PLANE ").alias("state"), F.when(k % 7 != 0, F.col("value")).alias("x"), (k % 100).cast("double").alias("y"), F.when(k % 11 == 0, float("nan")).otherwise(1.0).alias("z"))
    return e.select("event_id", C.usable_pose(F.col("state"), F.col("x"), F.col("y"), F.col("z")).x.alias("px"))


@query("SELECT event_id FROM events WHERE event_id IN (3, 17, 123) OR event_id BETWEEN 40 AND 60 OR event_id BETWEEN 900 AND 950 OR event_id >= 9990 OR event_id <= 2")
def frames_in_spec(spark, sf):
    from tessera.plans.specs import range_table

    e = table(spark, sf, "events").select("event_id")
    return matching.in_ranges(e, range_table(spark, ["3", "17", "s_000123.png", "60-40", "900-950", "9990-", "-2"]), "event_id")


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events)
SELECT event_id, user_id FROM r WHERE (user_id % 10 = 3 AND pos BETWEEN 1 AND 26) OR (user_id % 10 = 4 AND pos IN (2, 5))""")
def frames_by_position(spark, sf):
    """Places of many sessions, as a table of tokens."""
    from tessera.plans.specs import select_in_tables

    e, u = table(spark, sf, "events").select("event_id", "user_id"), F.col("user_id")
    place = lambda lo, hi: F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
    spec = e.select(u).distinct().filter(u % 10 == 3).select(u, F.explode(F.array(place(1, 26))).alias("p"))
    spec = spec.unionByName(e.select(u).distinct().filter(u % 10 == 4).select(u, F.explode(F.array(place(2, 2), place(5, 5))).alias("p")))
    spec = spec.select(u.cast("string").alias("s"), "p.lo", "p.hi", F.lit(None).cast("string").alias("g"))
    return select_in_tables(e, spec, None, "user_id", "event_id")


@query("""SELECT event_type, CASE event_type WHEN 'view' THEN ' Wild Radish' WHEN 'click' THEN 'GRASS-weed' WHEN 'purchase' THEN 'other weed' ELSE event_type END AS raw,
  CASE event_type WHEN 'view' THEN 'wild_radish' WHEN 'click' THEN 'grass_weed' WHEN 'purchase' THEN 'other_weed' ELSE event_type END AS label,
  CASE event_type WHEN 'view' THEN 'wild_radish' WHEN 'purchase' THEN 'other_weed' WHEN 'signup' THEN 'weed_cluster' END AS repaired, count(*) AS n FROM events GROUP BY event_type""")
def label_repair(spark, sf):
    t = F.col("event_type")
    raw = F.when(t == "view", " Wild Radish").when(t == "click", "GRASS-weed").when(t == "purchase", "other weed").otherwise(t)
    repaired = C.repaired_category(F.lower(raw), {"signup": "weed_cluster"})
    return table(spark, sf, "events").groupBy(t).agg(F.count("*").alias("n")).select(t, raw.alias("raw"), C.canonical_label(raw).alias("label"), repaired.alias("repaired"), "n")


@query("""WITH s AS (SELECT o_orderkey, 'cam' || o_custkey || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS sid, o_orderpriority, o_orderdate FROM orders)
SELECT o_orderkey, 'cam' || regexp_extract(sid, '^cam(\\d+)_', 1) AS camera, strftime(o_orderdate, '%Y-%m-%d') AS date, sid AS session_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'onion_only' WHEN 1 THEN 'weed_only' WHEN 2 THEN 'mixed' ELSE 'unknown' END AS scene,
  'trip_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS made FROM s""")
def session_ids(spark, sf):
    o = table(spark, sf, "orders")
    stamp = F.date_format("o_orderdate", "yyyyMMdd_HHmmss")
    sid = F.concat(F.lit("cam"), F.col("o_custkey").cast("string"), F.lit("_"), stamp)
    k = F.col("o_orderkey")
    scene = F.when(k % 5 == 0, "Only Onions").when(k % 5 == 1, " weeds").when(k % 5 == 2, "MIX").when(k % 5 == 3, "").otherwise("tomato")
    scene = F.when(k % 5 == 0, "onlyonions").otherwise(scene)
    parsed = C.parse_session_id(sid)
    folder = F.when(k % 2 == 0, F.concat(F.lit("HD_"), stamp)).otherwise("folder")
    return o.select("o_orderkey", parsed.camera.alias("camera"), parsed.date.alias("date"), C.session_of_frame(F.concat(sid, F.lit("_000012"))).alias("session_id"), C.normalise_scene(scene).alias("scene"), C.make_session_id(folder, F.lit("trip"), F.col("o_orderdate")).alias("made"))


THIN = """WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
t AS (SELECT user_id, k, value AS anchor, true AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, CASE WHEN abs(o.value - t.anchor) >= {t} THEN o.value ELSE t.anchor END, abs(o.value - t.anchor) >= {t} FROM t JOIN o ON o.user_id = t.user_id AND o.k = t.k + 1)
"""


@query(THIN.format(t=20) + "SELECT o.user_id AS session_id, o.event_id AS idx, NOT kept AS dropped, CASE WHEN NOT kept THEN 'redundant' END AS drop_reason FROM t JOIN o ON o.user_id = t.user_id AND o.k = t.k")
def thinned_frames(spark, sf):
    rows = frames(spark, sf).select("session_id", "idx", "value").withColumn("dropped", F.lit(False)).withColumn("drop_reason", F.lit(None).cast("string"))
    return folds.mark_redundant(rows, "session_id", "idx", "value", 20.0).select("session_id", "idx", "dropped", "drop_reason")


@query("WITH RECURSIVE c AS (SELECT unnest([5.0, 20.0, 60.0, 150.0])::DOUBLE AS threshold), o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),\nt AS (SELECT user_id, threshold, k, value AS anchor, true AS kept FROM o CROSS JOIN c WHERE k = 1 UNION ALL SELECT o.user_id, t.threshold, o.k, CASE WHEN abs(o.value - t.anchor) >= t.threshold THEN o.value ELSE t.anchor END, abs(o.value - t.anchor) >= t.threshold FROM t JOIN o ON o.user_id = t.user_id AND o.k = t.k + 1)\nSELECT user_id AS session_id, threshold, count(*) FILTER (kept) AS kept FROM t GROUP BY ALL")
def thinning_sweep(spark, sf):
    """Positions are measured once and thresholds replayed on them."""
    rows = frames(spark, sf).select("session_id", "idx", "value").withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (5.0, 20.0, 60.0, 150.0)])))
    return folds.keep_by_travel(rows, ["session_id", "threshold"], "idx", "value", F.col("threshold")).groupBy("session_id", "threshold").agg(F.count_if("kept").alias("kept"))


@query("""WITH w AS (SELECT user_id, count(*) AS before FROM events GROUP BY user_id),
k AS (SELECT user_id, before, (user_id % 13)::BIGINT AS after, before // 8 AS k1, before // 3 AS k2, before // 2 AS k3 FROM w)
SELECT user_id AS session_id, before, after, CASE WHEN k1 >= greatest(12, 0.25 * before) THEN 0.4 WHEN k2 >= greatest(12, 0.25 * before) THEN 0.25 WHEN k3 >= greatest(12, 0.25 * before) THEN 0.1 END::DOUBLE AS suggested
FROM k WHERE after / before < 0.15 OR after < 12""")
def over_curated(spark, sf):
    n = frames(spark, sf).groupBy("session_id").agg(F.count("*").alias("before")).withColumn("after", (F.col("session_id") % 13).cast("long"))
    kept = lambda d: F.floor(F.col("before") / d)
    sweep = F.array(*[F.struct(F.lit(t).alias("threshold"), kept(d).alias("kept")) for t, d in ((0.4, 8), (0.25, 3), (0.1, 2))])
    return metrics.over_curation(n.withColumn("sweep", sweep), ["session_id"], "before", "sweep")


@query("""WITH p AS (SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 THEN value END AS pose, CASE WHEN event_id % 9 = 0 THEN NULL ELSE round(value / 7, 3) END AS shift, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT user_id AS session_id, event_id AS idx, round(CASE WHEN user_id % 3 = 0 THEN pose ELSE sum(CASE WHEN k = 1 THEN 0 ELSE coalesce(shift, 0) END) OVER (PARTITION BY user_id ORDER BY event_id) END, 6) + 0.0 AS position,
  user_id % 3 <> 0 AND k > 1 AND shift IS NULL AS forced FROM p""")
def travelled_positions(spark, sf):
    s = F.col("session_id")
    rows = frames(spark, sf).select(s, "idx", F.when(s % 3 == 0, F.col("value")).alias("pose"), F.when(F.col("idx") % 9 != 0, F.round(F.col("value") / 7, 3)).alias("shift"))
    return windows.cumulative_position(rows, "session_id", "idx", "pose", "shift").select("session_id", "idx", (F.round("position", 6) + 0.0).alias("position"), "forced")


@query("""WITH b AS (SELECT user_id, event_id % 3 = 0 AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id AS session_id, (k // greatest(1, (n + 9) // 10))::INT AS bucket, count(*) AS n, count(*) FILTER (d) AS n_dropped FROM b GROUP BY ALL""")
def drop_buckets(spark, sf):
    return metrics.drop_histogram(frames(spark, sf), "session_id", "idx", F.col("idx") % 3 == 0)


@query("""SELECT user_id AS session_id, CASE event_type WHEN 'view' THEN 'unspecified' WHEN 'click' THEN 'unspecified' ELSE event_type END AS reason, count(*) AS n FROM events GROUP BY ALL""")
def reasons_by_session(spark, sf):
    t = F.col("event_type")
    return metrics.drop_reasons(frames(spark, sf), "session_id", F.when(t == "view", "  ").when(t != "click", t))


@query("SELECT CASE WHEN grouping(user_id) = 1 THEN -1 ELSE user_id END AS session_id, coalesce(event_type, 'all') AS event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id)")
def class_counts(spark, sf):
    return metrics.class_counts(frames(spark, sf), "session_id", "event_type").withColumn("session_id", F.coalesce("session_id", F.lit(-1))).withColumn("event_type", F.coalesce("event_type", F.lit("all")))


@query("SELECT n_name AS class_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def zero_filled_counts(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return metrics.counts_with_zeros(c, "n_name", table(spark, sf, "nation").withColumnRenamed("n_name", "class_name"), "class_name")


SPLIT_SQL = "CASE WHEN user_id % 10 < 7 THEN 'train' WHEN user_id % 10 < 9 THEN 'val' ELSE 'test' END"


def split_frames(spark, sf):
    s = F.col("session_id") % 10
    return frames(spark, sf).withColumn("split", F.when(s < 7, "train").when(s < 9, "val").otherwise("test"))


@query(f"""WITH n AS (SELECT {SPLIT_SQL} AS split, event_type, count(*) AS n FROM events GROUP BY ALL),
b AS (SELECT *, n / sum(n) OVER (PARTITION BY event_type) AS share, sum(n) OVER (PARTITION BY split) / sum(n) OVER () AS want, (sum(n) OVER (PARTITION BY event_type))::BIGINT AS total FROM n)
SELECT split, event_type, n, round(share, 6) AS share, round(want, 6) AS want, total, total >= 20 AND (share >= want * 1.1 OR share <= want / 1.1) AS drifts FROM b""")
def split_balance(spark, sf):
    out = metrics.class_balance(split_frames(spark, sf), "split", "event_type", ratio=1.1)
    return out.withColumns({c: F.round(c, 6) for c in ("share", "want")})


@query(f"""WITH n AS (SELECT {SPLIT_SQL} AS split, event_type, count(*) AS n FROM events GROUP BY ALL),
b AS (SELECT *, n / sum(n) OVER (PARTITION BY event_type) - sum(n) OVER (PARTITION BY split) / sum(n) OVER () AS d FROM n)
SELECT round(max(CASE WHEN d > 0 THEN 2 * d ELSE -d END), 6) AS worst FROM b WHERE split IN ('val', 'test')""")
def worst_class_skew(spark, sf):
    return metrics.worst_skew(metrics.class_balance(split_frames(spark, sf), "split", "event_type"), "split").select(F.round("worst", 6).alias("worst"))


SCENE_SQL = "CASE user_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'mixed' WHEN 2 THEN 'weed_only' ELSE 'onion_only' END"


def scenes(spark, sf):
    s = F.col("session_id")
    rows = split_frames(spark, sf).select("session_id", "split").distinct()
    return rows.withColumn("scene", F.when(s % 4 == 0, "unknown").when(s % 4 == 1, "mixed").when(s % 4 == 2, "weed_only").otherwise("onion_only")).withColumn("group_id", F.floor(s / 5).cast("string"))


@query(f"""WITH s AS (SELECT DISTINCT user_id, {SPLIT_SQL} AS split, {SCENE_SQL} AS scene FROM events), n AS (SELECT split, scene, count(*) AS n FROM s GROUP BY ALL)
SELECT split, scene, n, array_to_string(list_sort(list_filter(['mixed', 'onion_only', 'weed_only'], lambda x: NOT list_contains(has, x))), ',') AS missing
FROM n JOIN (SELECT split, list(DISTINCT scene) AS has FROM s GROUP BY split) USING (split)""")
def split_scenes(spark, sf):
    return metrics.scene_representation(scenes(spark, sf), "split", "scene").withColumn("missing", F.array_join("missing", ","))


@query(f"""WITH s AS (SELECT DISTINCT user_id, (user_id // 5)::VARCHAR AS group_id, {SCENE_SQL} AS scene FROM events)
SELECT group_id, CASE count(DISTINCT nullif(scene, 'unknown')) WHEN 0 THEN 'unknown' WHEN 1 THEN max(nullif(scene, 'unknown')) ELSE 'mixed' END AS scene FROM s GROUP BY group_id""")
def group_scenes(spark, sf):
    return metrics.group_scene(scenes(spark, sf), "group_id", "scene")


SEAM_SQL = "CASE WHEN event_id % 50 < 30 THEN 'train' WHEN event_id % 50 < 40 THEN 'val' ELSE 'test' END"


@query(f"""WITH f AS (SELECT user_id, event_id, {SEAM_SQL} AS split FROM events)
SELECT a.user_id AS session_id, a.split, min(abs(a.event_id - b.event_id)) AS separation FROM f a JOIN f b ON a.user_id = b.user_id AND b.split = 'train' WHERE a.split <> 'train' GROUP BY ALL""")
def seam_distances(spark, sf):
    k = F.col("idx") % 50
    rows = frames(spark, sf).withColumn("split", F.when(k < 30, "train").when(k < 40, "val").otherwise("test"))
    return matching.seam_separation(rows, "session_id", "idx", "split")


@query(f"""WITH f AS (SELECT user_id, event_type, {SPLIT_SQL} AS split FROM events WHERE NOT ({SPLIT_SQL} = 'train' AND event_type = 'view'))
SELECT DISTINCT event_type FROM f EXCEPT SELECT event_type FROM f WHERE split = 'train'""")
def classes_missing_from_train(spark, sf):
    rows = split_frames(spark, sf).filter(~((F.col("split") == "train") & (F.col("event_type") == "view")))
    return metrics.missing_from_train(rows, "split", "event_type")


@query(f"""WITH f AS (SELECT event_type, {SPLIT_SQL} AS split FROM events WHERE NOT ({SPLIT_SQL} = 'train' AND event_type = 'view') AND NOT ({SPLIT_SQL} = 'val' AND event_type = 'click')),
c AS (SELECT event_type, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'val') AS va FROM f GROUP BY event_type)
SELECT event_type, 'error' AS level, 'class_missing_from_train' AS kind FROM c WHERE tr = 0 AND va > 0
UNION ALL SELECT event_type, 'warn', 'class_missing_from_val' FROM c WHERE tr > 0 AND va = 0 UNION ALL SELECT event_type, 'warn', 'class_too_rare' FROM c WHERE tr > 0 AND tr < 2000""")
def preflight_classes(spark, sf):
    rows = split_frames(spark, sf).filter(~((F.col("split") == "train") & (F.col("event_type") == "view")) & ~((F.col("split") == "val") & (F.col("event_type") == "click")))
    n = rows.groupBy("event_type").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    return metrics.preflight(n, "event_type", rare=2000)


@query("SELECT 'warn' AS level, 'no_test_split' AS kind UNION ALL SELECT 'error', 'no_val_frames'")
def preflight_splits(spark, sf):
    return metrics.split_findings(frames(spark, sf).withColumn("split", F.lit("train")), "split")


@query()
def split_plan(spark, sf):
    """Group-wise plan by stable hash ranks (the hash is not in the oracle's SQL)."""
    s = frames(spark, sf).groupBy("session_id").agg(F.count("*").alias("n_frames")).withColumn("session_id", F.col("session_id").cast("string"))
    k = F.col("session_id").cast("int")
    s = s.withColumn("group_id", F.floor(k / 3).cast("string")).withColumn("scene", F.when(k % 4 == 0, "unknown").when(k % 4 == 1, "mixed").otherwise("weed_only"))
    return splits.plan_splits(s, 0.15, 0.15).join(s, "session_id")


@query("SELECT 'train' AS split, user_id AS session_id FROM events WHERE false")
def split_leaks(spark, sf):
    """Sessions in several splits of the plan: none."""
    plan = split_plan(spark, sf).select(F.col("session_id").cast("long").alias("session_id"), "split")
    rows = frames(spark, sf).join(plan, "session_id", "left")
    return splits.leaks(rows, "session_id", "split").select("splits", "session_id").withColumnRenamed("splits", "split")


@query("""WITH b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT *, n - round_even(n * 0.2::DOUBLE, 0)::INT - round_even(n * 0.1::DOUBLE, 0)::INT AS v, n - round_even(n * 0.1::DOUBLE, 0)::INT AS t, round_even(n * 0.2::DOUBLE, 0)::INT AS nv, round_even(n * 0.1::DOUBLE, 0)::INT AS nt FROM b)
SELECT user_id AS session_id, event_id AS idx, CASE WHEN n < 5 OR i < v - CASE WHEN nv + nt > 0 THEN 2 ELSE 0 END THEN 'train' WHEN i >= v AND i < t - CASE WHEN nv > 0 AND nt > 0 THEN 2 ELSE 0 END THEN 'val' WHEN i >= t THEN 'test' END AS split FROM c""")
def frame_blocks(spark, sf):
    rows = frames(spark, sf).select("session_id", "idx")
    return windows.within_session_blocks(rows, "session_id", "idx", 0.2, 0.1, gap=2)


@query("""WITH g AS (SELECT c_nationkey % 4 AS stratum, c_custkey AS key, 1 + c_custkey % 3 AS size FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key % 97, key) AS turn, sum(size) OVER (PARTITION BY stratum) AS total FROM g)
SELECT stratum, key, row_number() OVER (ORDER BY turn, total DESC, stratum, key) AS place FROM r""")
def interleaved_strata(spark, sf):
    g = table(spark, sf, "customer").select((F.col("c_nationkey") % 4).alias("stratum"), F.col("c_custkey").alias("key"), (1 + F.col("c_custkey") % 3).alias("size"))
    return windows.interleave(g, "stratum", "key", "size", F.col("key") % 97).select("stratum", "key", F.col("place").cast("long").alias("place"))


@query()
def shuffled_pool(spark, sf):
    """A seeded order by stable hash in place of a generator's shuffle."""
    e = table(spark, sf, "events").select("event_id")
    return e.select("event_id", C.stable_rank(1337, F.col("event_id")).alias("rank")).orderBy("rank", "event_id")


@query("SELECT event_type, count(DISTINCT user_id) AS n_sessions, count(DISTINCT user_id) > 100 AS many FROM events GROUP BY event_type")
def distinct_sessions(spark, sf):
    return frames(spark, sf).groupBy("event_type").agg(F.count_distinct("session_id").alias("n_sessions")).withColumn("many", F.col("n_sessions") > 100)


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events), s AS (SELECT * FROM r WHERE k % 4 = 0 AND event_id % 3 <> 0)
SELECT user_id AS session_id, event_id AS idx FROM s QUALIFY row_number() OVER (ORDER BY user_id, event_id) <= 500""")
def strided_pool(spark, sf):
    """Stride first, then exclusions, then a limit over all sessions."""
    rows = windows.every_nth(frames(spark, sf).select("session_id", "idx"), "session_id", "idx", 4)
    done = frames(spark, sf).filter("idx % 3 = 0").select("idx")
    return rows.join(done, "idx", "left_anti").orderBy("session_id", "idx").limit(500).select("session_id", "idx")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id AS session_id, event_id AS idx FROM r WHERE k % greatest(1, n // 8) = 0 AND k < greatest(1, n // 8) * 8""")
def evenly_sampled(spark, sf):
    return windows.sample_evenly(frames(spark, sf).select("session_id", "idx"), "session_id", "idx", 8)


@query("""WITH g AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n_dropped, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events)
SELECT user_id AS session_id, after, event_id AS idx, n_dropped FROM g WHERE n_dropped > 0""")
def dropped_captures(spark, sf):
    return windows.capture_gaps(frames(spark, sf).select("session_id", "idx"), "session_id", "idx")


@query("""SELECT user_id AS session_id, round(quantile_cont(value, 0.5), 6) AS median_value, round(quantile_cont(value, 0.5) FILTER (event_id % 3 = 0), 6) AS median_depth FROM events GROUP BY user_id""")
def session_medians(spark, sf):
    rows = frames(spark, sf).withColumn("depth", F.when(F.col("idx") % 3 == 0, F.col("value")))
    out = rows.select("session_id").distinct()
    out = windows.with_quantiles(out, rows, ["session_id"], "value", {"median_value": 0.5})
    out = windows.with_quantiles(out, rows, ["session_id"], "depth", {"median_depth": 0.5})
    return out.withColumns({c: F.round(c, 6) for c in ("median_value", "median_depth")})
