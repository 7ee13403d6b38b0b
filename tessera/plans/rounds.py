"""Queries on rounds of labelling, diagnosis, training histories, set operations and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import active, contract, kernels, matching, metrics, windows
from tessera.plans.analogues import INSTANCES_SQL, frames, sides
from tessera.session import new_folder, table
from tessera.streaming import queries as streams

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- scores and rounds
LABELLED_SQL = "f AS (SELECT l_returnflag AS class_name, count(*) AS labelled FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'R' GROUP BY 1)"


def labelled(spark, sf):
    return table(spark, sf, "lineitem").filter("l_linenumber = 1 AND l_returnflag <> 'R'").groupBy(F.col("l_returnflag").alias("class_name")).agg(F.count("*").alias("n"))


@query(f"""WITH {LABELLED_SQL}, t AS (SELECT l_orderkey AS frame, l_discount * 10 AS conf, CASE WHEN l_partkey % 7 <> 0 THEN (l_partkey % 15)::DOUBLE END AS sigma, l_suppkey % 5 = 0 AS abst,
  l_partkey % 100 <= 40 OR l_suppkey % 11 = 0 AS near, coalesce(labelled, 0) AS k FROM lineitem LEFT JOIN f ON class_name = l_returnflag),
g AS (SELECT frame, count(*) AS n_instances, count(*) FILTER (abst) AS n_abstained, round(avg((conf BETWEEN 0.25::DOUBLE AND 0.7::DOUBLE)::INT), 6) AS uncertainty,
  round(0.5::DOUBLE * coalesce(avg(least(1, sigma / 12)), 0) + 0.5::DOUBLE * avg(abst::INT), 6) AS lep_quality, round(max(1 / sqrt(1 + k)), 6) AS rarity, round(avg(near::INT), 6) AS crop_risk FROM t GROUP BY frame)
SELECT *, round(uncertainty + 0.8::DOUBLE * lep_quality + 1.2::DOUBLE * rarity + 0.6::DOUBLE * crop_risk, 6) AS total,
  array_to_string(list_filter([CASE WHEN uncertainty > 0.5 THEN 'uncertainty' END, CASE WHEN lep_quality > 0.5 THEN 'lep_quality' END, CASE WHEN rarity > 0.5 THEN 'rarity' END, CASE WHEN crop_risk > 0.5 THEN 'crop_risk' END], lambda r: r IS NOT NULL), ',') AS reasons FROM g""")
def frame_scores(spark, sf):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    targets = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("frame"),
        F.col("l_returnflag").alias("class_name"),
        (F.col("l_discount") * 10).alias("confidence"),
        F.when(part % 7 != 0, (part % 15).cast("double")).alias("sigma"),
        (supp % 5 == 0).alias("abstained"),
        (part % 100).alias("crop_distance"),
        (supp % 11 == 0).alias("conflict"),
    )
    return active.frame_scores(targets, labelled(spark, sf), "frame").withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {LABELLED_SQL}, c AS (SELECT DISTINCT l_returnflag AS class_name FROM lineitem), z AS (SELECT class_name, coalesce(labelled, 0) AS n FROM c LEFT JOIN f USING (class_name))
SELECT coalesce(string_agg(class_name, ',' ORDER BY class_name) FILTER (n = 0), '') AS missing, coalesce(string_agg(class_name, ',' ORDER BY class_name) FILTER (n > 0 AND n < 4000), '') AS scarce FROM z""")
def labelling_guidance(spark, sf):
    classes = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("class_name")).distinct()
    return active.guidance(classes.join(labelled(spark, sf), "class_name", "left").fillna(0, ["n"]), 4000)


@query()
def diverse_batch(spark, sf):
    """Eight far-apart and high-scoring vectors per label, over all of the table."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding", (F.col("vec_id") % 10).cast("double").alias("score"))
    return active.farthest_point(rows, "label", "vec_id", "embedding", "score", 8)


@query()
def hash_diverse_batch(spark, sf):
    """Five frames per session whose hashes differ."""
    rows = frames(spark, sf).select("session_id", "idx", "value", F.xxhash64(F.floor(F.col("value") / 5)).alias("code"))
    return active.hash_diverse(rows, "session_id", "idx", "code", [-F.col("value"), F.col("idx")], 5, 24)


def ledger(spark, sf):
    """Customers modulo 20 as rounds."""
    k = F.col("o_custkey") % 20
    g = table(spark, sf, "orders").groupBy(k.alias("round")).agg(F.count("*").alias("n_frames"), F.collect_list("o_orderkey").alias("item_ids"), F.round(F.avg("o_totalprice"), 2).alias("m"))
    r = F.col("round")
    state = F.when(r % 3 == 0, "exported").when(r % 3 == 1, "merged").otherwise("abandoned")
    after = F.when(r % 4 != 0, F.map_from_arrays(F.array(F.lit("map"), F.lit("recall")), F.array(F.col("n_frames") / 7, (r * 2).cast("double")))).otherwise(F.map_from_arrays(F.array(F.lit("map")), F.array(F.col("n_frames") / 7)))
    return g.withColumn("state", state).withColumn("metrics_before", F.map_from_arrays(F.array(F.lit("map"), F.lit("recall")), F.array(F.lit(0.5), r / 3))).withColumn("metrics_after", after)


LEDGER_SQL = """l AS (SELECT o_custkey % 20 AS round, count(*) AS n_frames FROM orders GROUP BY 1), s AS (SELECT *, CASE round % 3 WHEN 0 THEN 'exported' WHEN 1 THEN 'merged' ELSE 'abandoned' END AS state FROM l)"""


@query(f"WITH {LEDGER_SQL} SELECT round, state, n_frames, round(n_frames / 7 - 0.5::DOUBLE, 4) AS d_map, CASE WHEN round % 4 <> 0 THEN round(round * 2 - round / 3, 4) END AS d_recall FROM s")
def round_history(spark, sf):
    return active.round_history(ledger(spark, sf), ("map", "recall"))


@query("SELECT DISTINCT o_orderkey AS item_id FROM orders WHERE (o_custkey % 20) % 3 = 0")
def frames_in_flight(spark, sf):
    return active.in_flight(ledger(spark, sf))


@query("SELECT 20 AS next_round, 18 AS latest_exported")
def round_numbers(spark, sf):
    rounds = ledger(spark, sf)
    return active.next_round(rounds).crossJoin(active.latest_exported(rounds).withColumnRenamed("round", "latest_exported"))


@query(f"WITH {LEDGER_SQL} SELECT round, CASE WHEN round = 6 THEN 'merged' ELSE state END AS state FROM s")
def round_merged(spark, sf):
    """An exported round becomes merged; one that isn't exported stays as it is."""
    return active.transition(active.transition(ledger(spark, sf), 6, "merged"), 7, "abandoned").select("round", "state")


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 1 AND user_id % 7 <> 0")
def unlabelled_pool(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    holdout = e.filter("user_id % 7 = 0").select("user_id").distinct()
    return active.unlabelled(e, e.filter("event_id % 3 = 0").select("event_id"), e.filter("event_id % 5 = 1").select("event_id"), holdout, "event_id", "user_id")


# ---------------------------------------------------------------- logs, sets and checks
@query("""SELECT user_id AS session_id, event_id AS idx, event_id % 3 = 0 AS synthetic, CASE WHEN event_id % 3 = 0 THEN floor(event_id / 15.0::DOUBLE * 1e9::DOUBLE)::BIGINT ELSE event_id * 1000 END AS timestamp_ns FROM events""")
def logged_frames(spark, sf):
    f = frames(spark, sf).select("session_id", "idx")
    log = f.filter("idx % 3 <> 0").withColumn("timestamp_ns", F.col("idx") * 1000)
    return matching.log_rows(f, log, "session_id", "idx", F.lit(15.0)).select("session_id", "idx", "synthetic", "timestamp_ns")


@query("""WITH m AS (SELECT o_custkey, o_orderpriority AS site, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O')
SELECT c_custkey, coalesce(site, 'none') AS site FROM customer LEFT JOIN m ON o_custkey = c_custkey AND k = 1""")
def session_metadata(spark, sf):
    s = table(spark, sf, "customer").select("c_custkey")
    m = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderpriority").alias("site"))
    return matching.first_with_metadata(s, m, "c_custkey", "o_orderkey").select("c_custkey", F.coalesce("site", F.lit("none")).alias("site"))


@query(f"""WITH {INSTANCES_SQL}, p AS (SELECT DISTINCT frame FROM instances WHERE NOT is_truth), t AS (SELECT DISTINCT frame FROM instances WHERE is_truth)
SELECT frame, 'both' AS side FROM (SELECT frame FROM p INTERSECT SELECT frame FROM t) UNION ALL SELECT frame, 'only_pred' FROM (SELECT frame FROM p EXCEPT SELECT frame FROM t) UNION ALL SELECT frame, 'only_truth' FROM (SELECT frame FROM t EXCEPT SELECT frame FROM p)""")
def frame_sets(spark, sf):
    pred, truth = (x.select("frame").distinct() for x in sides(spark, sf))
    parts = {"both": pred.intersect(truth), "only_pred": pred.exceptAll(truth), "only_truth": truth.exceptAll(pred)}
    return contract.union_named(parts, "side")


@query("SELECT o_custkey AS item, count(*) AS n, count(DISTINCT o_orderpriority) AS n_sources FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_items(spark, sf):
    return contract.duplicate_items(table(spark, sf, "orders").select(F.col("o_custkey").alias("item"), "o_orderpriority"), "item", "o_orderpriority")


@query("""WITH a AS (SELECT user_id, count(*) AS n_a FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) AS n_b FROM events WHERE event_id % 2 = 1 AND user_id % 9 <> 0 GROUP BY 1)
SELECT user_id, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b USING (user_id) WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)""")
def source_cross_check(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id")
    return contract.cross_check(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1 AND user_id % 9 <> 0"), "user_id")


@query("""SELECT l_orderkey AS frame, count(*) FILTER (l_linenumber % 2 = 1) AS missed, count(*) FILTER (l_linenumber % 2 = 0) AS false_positives FROM lineitem GROUP BY 1 ORDER BY missed DESC, false_positives DESC, frame LIMIT 50""")
def worst_frames(spark, sf):
    """A top-k report."""
    n = F.col("l_linenumber") % 2
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.count_if(n == 1).alias("missed"), F.count_if(n == 0).alias("false_positives"))
    return g.orderBy(F.desc("missed"), F.desc("false_positives"), "frame").limit(50)


# ---------------------------------------------------------------- diagnosis and histories
@query("""WITH q AS (SELECT unnest([10, 50, 90]) AS code, unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9])) AS mm FROM lineitem), s AS (SELECT mm * 255 / code AS s FROM q),
m AS (SELECT quantile_cont(s, 0.5) AS scale, (max(s) - min(s)) / quantile_cont(s, 0.5) AS spread FROM s) SELECT round(scale, 6) AS scale, round(spread, 6) AS spread, spread <= 0.1 AS linear FROM m""")
def preview_scale(spark, sf):
    p = metrics.percentile_map(table(spark, sf, "lineitem"), [], "l_extendedprice", (0.1, 0.5, 0.9))
    return metrics.scale_fit(p.withColumn("code", F.round(F.col("share") * 100).cast("int")), "code", "value")


@query("""WITH v AS (SELECT l_suppkey % 20 AS stream, CASE WHEN l_partkey % 6 = 0 THEN 0 ELSE l_extendedprice END AS mm FROM lineitem)
SELECT stream, count(*) AS n, count(*) FILTER (mm = 0) AS invalid, min(nullif(mm, 0)) AS least, max(nullif(mm, 0)) AS most, round(avg(CASE WHEN mm > 0 THEN (mm BETWEEN 250 AND 3000)::INT END), 6) AS in_range FROM v GROUP BY stream""")
def depth_ranges(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("stream"), F.when(F.col("l_partkey") % 6 == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("mm"))
    return metrics.range_statistics(rows, ["stream"], "mm", 250.0, 3000.0).drop("total")


@query("""WITH v AS (SELECT l_suppkey AS session, CASE WHEN l_suppkey % 3 = 0 THEN 65000.0 + l_linenumber ELSE 4000.0 + l_partkey % 9000 END AS top, l_extendedprice / (1 + l_suppkey % 4) AS mid, CASE WHEN l_suppkey % 6 = 0 THEN 0.5 ELSE 0.001 END AS sat FROM lineitem),
s AS (SELECT session, min(top) AS lo, max(top) AS hi, max(sat) AS sat, quantile_cont(mid, 0.5) AS med FROM v GROUP BY 1)
SELECT session, CASE WHEN lo >= 0.97 * 65535 AND hi - lo <= 0.02 * 65535 AND sat < 0.02 THEN 'preview' WHEN med BETWEEN 250 AND 3000 THEN 'metric' ELSE 'uncertain' END AS kind, round(med, 1) AS median_value FROM s""")
def depth_kinds(spark, sf):
    k = F.col("l_suppkey")
    rows = table(spark, sf, "lineitem").select(k.alias("session"), F.when(k % 3 == 0, 65000.0 + F.col("l_linenumber")).otherwise(4000.0 + F.col("l_partkey") % 9000).alias("top"), (F.col("l_extendedprice") / (1 + k % 4)).alias("mid"), F.when(k % 6 == 0, 0.5).otherwise(0.001).alias("sat"))
    return metrics.depth_kind(rows, "session", "top", "mid", "sat")


@query("""WITH e AS (SELECT user_id % 10 AS grp, value, event_id, (event_id * 37) % 1000 AS a, (value * value) AS b FROM events),
r AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY value, event_id) AS x, row_number() OVER (PARTITION BY grp ORDER BY a, event_id) AS ra, row_number() OVER (PARTITION BY grp ORDER BY b, event_id) AS rb FROM e)
SELECT grp, round(corr(x, ra), 6) AS rho_a, round(corr(x, rb), 6) AS rho_b FROM r GROUP BY grp""")
def blur_correlations(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 10).alias("grp"), "value", "event_id", (F.col("event_id") * 37 % 1000).alias("a"), (F.col("value") * F.col("value")).alias("b"))
    return metrics.rank_correlations(e, ["grp"], "value", ["a", "b"], "event_id")


@query("""WITH e AS (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS an, (event_id % 7) / 7.0::DOUBLE AS ag, 0.25::DOUBLE AS ch, event_id % 12 AS n, (event_id % 20) / 10.0::DOUBLE - 1 AS rho FROM events),
v AS (SELECT event_id, CASE WHEN an >= 0.5 THEN 1 ELSE 0 END + CASE WHEN n >= 5 AND ag >= greatest(0.6::DOUBLE, ch * 2) THEN 2 ELSE 0 END + CASE WHEN rho <= -0.3::DOUBLE THEN 1 ELSE 0 END AS m,
  CASE WHEN an <= 0.25 THEN 1 ELSE 0 END + CASE WHEN n >= 5 AND ag <= ch THEN 1 ELSE 0 END AS o FROM e)
SELECT CASE WHEN m >= 2 AND m > o THEN 'motion' WHEN o >= 1 AND o >= m THEN 'optics' ELSE 'inconclusive' END AS label, count(*) AS n FROM v GROUP BY 1""")
def blur_verdicts(spark, sf):
    k = F.col("event_id")
    label = metrics.blur_votes((k % 100) / 100.0, (k % 7) / 7.0, F.lit(0.25), k % 12, (k % 20) / 10.0 - 1)["label"]
    return table(spark, sf, "events").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT event_id % 50 AS epoch, arg_max(value, event_id) FILTER (event_id % 3 = 0) AS loss, arg_max(value, event_id) FILTER (event_id % 4 = 1) AS recall FROM events GROUP BY 1""")
def epoch_history(spark, sf):
    k = F.col("event_id")
    rows = table(spark, sf, "events").select((k % 50).alias("epoch"), k, F.when(k % 3 == 0, F.col("value")).alias("loss"), F.when(k % 4 == 1, F.col("value")).alias("recall"))
    return windows.history_by_epoch(rows, "epoch", "event_id", ("loss", "recall"))


@query("""WITH h AS (SELECT user_id AS run, event_id AS epoch, value AS m FROM events WHERE event_id % 2 = 0),
b AS (SELECT *, m > coalesce(max(m) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e308) AS is_best FROM h),
i AS (SELECT *, max(m) OVER w AS best, sum(is_best::INT) OVER w AS island FROM b WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY epoch) - 1 AS stale FROM i)
SELECT run, epoch, best, is_best, stale, bool_or(stale >= 8) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS stopped FROM s""")
def early_stops(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("m"))
    out = windows.early_stopping(rows, "run", "epoch", "m", 8)
    return out.select("run", "epoch", "best", "is_best", F.col("stale").cast("long").alias("stale"), "stopped")


# ---------------------------------------------------------------- array kernels
@query("""WITH c AS (SELECT vec_id, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS h FROM embeddings),
s AS (SELECT vec_id, list_sum(h) AS total, list_sum(list_transform(h, lambda v, i: v * ((i - 1) % 8))) AS x, list_sum(list_transform(h, lambda v, i: v * ((i - 1) // 8))) AS y, list_max(h) AS peak FROM c)
SELECT vec_id, round(x / total, 6) AS u, round(y / total, 6) AS v, round(peak, 6) AS peak FROM s""")
def heat_map_points(spark, sf):
    """Vectors as 8 x 8 heat maps: their expected position and peak, in Arrow batches."""
    p = kernels.heat_point(F.transform("embedding", lambda v: F.abs(v.cast("double"))), F.lit(8), F.lit(8))
    return table(spark, sf, "embeddings").select("vec_id", p.alias("p")).select("vec_id", *[F.round(f"p.{c}", 6).alias(c) for c in ("u", "v", "peak")])


@query()
def heat_map_hashes(spark, sf):
    """Perceptual hashes of vectors as 8 x 8 pictures."""
    return table(spark, sf, "embeddings").select("vec_id", kernels.picture_hash("embedding", F.lit(8), F.lit(8)).alias("phash"))


# ---------------------------------------------------------------- streams
def stream(spark, sf):
    """The table events as a stream of files; the pattern lets one file be a folder."""
    return streams.read_events(spark, f"{sf}/events.parque[t]", table(spark, sf, "events").schema)


def landed(spark, rows, name):
    """All that the stream gives now, as a table in the shared folder."""
    return streams.run_to_table(rows, new_folder(spark, name))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
t AS (SELECT user_id, k, value AS anchor, true AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, CASE WHEN abs(o.value - t.anchor) >= 20 THEN o.value ELSE t.anchor END, abs(o.value - t.anchor) >= 20 FROM t JOIN o ON o.user_id = t.user_id AND o.k = t.k + 1)
SELECT o.user_id, o.event_id FROM t JOIN o ON o.user_id = t.user_id AND o.k = t.k WHERE kept""")
def stream_thinning(spark, sf):
    return landed(spark, streams.thin_stream(stream(spark, sf), "user_id", "event_id", "value", 20.0), "thin")


@query("""WITH g AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events)
SELECT user_id, after, event_id, event_id - after - 1 AS n_dropped FROM g WHERE event_id - after > 1""")
def stream_gaps(spark, sf):
    return landed(spark, streams.gap_stream(stream(spark, sf), "user_id", "event_id"), "gaps")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_counts(spark, sf):
    """Closed windows only: those that end before the watermark."""
    return landed(spark, streams.windowed_counts(stream(spark, sf), "ts", "event_type"), "counts").withColumn("total", F.round("total", 4))
