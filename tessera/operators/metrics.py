"""Evaluation, pool and report aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.windows import numbered, quantiles, with_quantiles


def gate_histogram(rows: DataFrame, failures: str, limits: Mapping[str, str]) -> DataFrame:
    """gate, rejected, and the value nine tenths into its column (by rank), for a looser limit.
    limits: gate -> column of its measure."""
    n = rows.select(F.explode(failures).alias("gate")).groupBy("gate").agg(F.count("*").alias("rejected"))
    measures = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(c).cast("double").alias("v")) for g, c in limits.items()])
    long = rows.select(F.inline(measures))
    return with_quantiles(n, long, ["gate"], "v", {"hint": 0.9}, "floor")


def session_stats(rows: DataFrame, session: str, passed: Column, score: str) -> DataFrame:
    """Pool size, frames that pass all gates, their share and mean difficulty per session."""
    return rows.groupBy(session).agg(F.count("*").alias("pool"), F.count_if(passed).alias("passed_gates"), F.round(F.avg(passed.cast("double")), 6).alias("pass_rate"), F.round(F.avg(score), 6).alias("mean_difficulty"))


def counts_with_zeros(rows: DataFrame, label: str, dimension: DataFrame, name: str) -> DataFrame:
    """A count for every member of a dimension, 0 where there is none."""
    n = rows.groupBy(F.col(label).alias(name)).agg(F.count("*").alias("n"))
    return dimension.select(name).join(n, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def class_counts(rows: DataFrame, session: str, label: str) -> DataFrame:
    """Counts per session and class, per class, and in all (null marks what is summed over)."""
    return rows.rollup(label, session).agg(F.count("*").alias("n")).select(session, label, "n")


def drop_reasons(rows: DataFrame, session: str, reason: Column) -> DataFrame:
    name = F.when(F.trim(F.coalesce(reason, F.lit(""))) == "", "unspecified").otherwise(F.trim(reason))
    return rows.groupBy(session, name.alias("reason")).agg(F.count("*").alias("n"))


def drop_histogram(rows: DataFrame, session: str, order: str, dropped: Column, buckets: int = 10) -> DataFrame:
    """Where drops fall along a session: buckets of ceil(n / buckets) frames, the last short."""
    w = Window.partitionBy(session)
    size = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) / buckets))
    bucket = F.floor((F.row_number().over(w.orderBy(order)) - 1) / size).cast("int")
    return rows.withColumn("bucket", bucket).withColumn("d", dropped).groupBy(session, "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("d")).alias("n_dropped"))


def class_balance(rows: DataFrame, split: str, label: str, least: int = 20, ratio: float = 1.5) -> DataFrame:
    """Per split and class: count, share of the class's instances, the split's share of all,
    and whether the class drifts from it (with at least ``least`` instances)."""
    n = rows.groupBy(split, label).agg(F.count("*").alias("n"))
    total, own, of_split = (F.sum("n").over(Window.partitionBy(*by)) for by in ((), (label,), (split,)))
    out = n.withColumn("share", F.col("n") / own).withColumn("want", of_split / total).withColumn("total", own)
    drift = (F.col("total") >= least) & ((F.col("share") >= F.col("want") * ratio) | (F.col("share") <= F.col("want") / ratio))
    return out.withColumn("drifts", drift)


def worst_skew(balance: DataFrame, split: str, least: int = 20) -> DataFrame:
    """The largest drift of a held-out split's class, over-representation counting twice."""
    drift = F.col("share") - F.col("want")
    return balance.filter(F.col(split).isin("val", "test") & (F.col("total") >= least)).agg(F.max(F.when(drift > 0, 2 * drift).otherwise(-drift)).alias("worst"))


def group_scene(rows: DataFrame, group: str, scene: str) -> DataFrame:
    """One scene for a group: unknown ones are ignored, several are mixed."""
    seen = F.array_remove(F.collect_set(F.coalesce(scene, F.lit("unknown"))), "unknown")
    return rows.groupBy(group).agg(seen.alias("s")).select(group, F.when(F.size("s") == 0, "unknown").when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise("mixed").alias("scene"))


def scene_representation(rows: DataFrame, split: str, scene: str) -> DataFrame:
    """Sessions per split and scene, with the scenes that occur but not in the split."""
    n = rows.groupBy(split).agg(F.collect_set(scene).alias("has"))
    all_ = rows.filter(F.col(scene) != "unknown").agg(F.collect_set(scene).alias("present"))
    missing = n.crossJoin(F.broadcast(all_)).select(split, F.array_sort(F.array_except("present", "has")).alias("missing"))
    return rows.groupBy(split, scene).agg(F.count("*").alias("n")).join(missing, split)


def missing_from_train(rows: DataFrame, split: str, label: str) -> DataFrame:
    return rows.select(label).distinct().exceptAll(rows.filter(F.col(split) == "train").select(label).distinct())


def counts_at_thresholds(matched: DataFrame, thresholds: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """matched: keys, n_pred, n_gt, iou of each matched pair (null: none). True and false
    positives, misses and their Jaccard per overlap threshold."""
    cut = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    per = matched.select("*", cut).groupBy(*keys, "threshold").agg(F.count_if(F.col("iou") >= F.col("threshold")).alias("tp"), F.first("n_pred").alias("n_pred"), F.first("n_gt").alias("n_gt"))
    per = per.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))
    return per.withColumn("jaccard", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp") + F.col("fn")))


def operating_point(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled precision, recall and f1 from per-frame tp, fp, fn; null where undefined."""
    s = frames.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    d = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 6)
    return s.select(*keys, "tp", "fp", "fn", d(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), d(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), d(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def with_both(rows: DataFrame, sigma: str, error: str) -> DataFrame:
    return rows.filter(~F.isnan(sigma) & ~F.isnan(error) & F.col(sigma).isNotNull() & F.col(error).isNotNull())


def calibration_bins(rows: DataFrame, sigma: str, error: str, tie: str, bins: int = 5) -> DataFrame:
    """Bins of equal counts by sigma (the first take what is left over) with their means."""
    ranked = numbered(with_both(rows, sigma, error).select(sigma, error, tie), [sigma, tie], "_k")
    size = F.floor(F.col("_all") / bins)
    head = (F.col("_all") % bins) * (size + 1)
    k = F.col("_k") - 1
    place = F.when(k < head, F.floor(k / (size + 1))).otherwise(F.col("_all") % bins + F.floor((k - head) / F.greatest(size, F.lit(1)))) + 1
    ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("_all")))).withColumn("bin", place.cast("int"))
    return ranked.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(sigma), 6).alias("mean_sigma"), F.round(F.avg(error), 6).alias("mean_error"))


def calibration_rank(rows: DataFrame, sigma: str, error: str, tie: str) -> DataFrame:
    """The ordinal rank correlation of sigma and error (ties by ``tie``; null below five rows)."""
    ranked = numbered(with_both(rows, sigma, error).select(sigma, error, tie), [sigma, tie], "_s")
    ranked = numbered(ranked.select("_s", error, tie), [error, tie], "_e")
    r = ranked.agg(F.count("*").alias("n"), F.round(F.corr("_s", "_e"), 6).alias("r"))
    return r.select("n", F.when(F.col("n") >= 5, F.col("r")).alias("rho"))


def error_summary(rows: DataFrame, keys: Sequence[str], error: str, radius: str | None = None, within: Sequence[float] = (2, 5, 10, 15), shares: Sequence[float] = (0.1, 0.25, 0.5)) -> DataFrame:
    """Mean, median, 95th percentile and shares of errors within limits, per keys."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    e = F.col(error)
    more = [share(e <= w).alias(f"within_{w:g}") for w in within]
    if radius:
        more += [share(e <= s * F.col(radius)).alias(f"within_{int(s * 100)}pct") for s in shares]
    out = rows.groupBy(*keys).agg(F.count(error).alias("n"), F.round(F.avg(e), 6).alias("mean"), *more)
    return with_quantiles(out, rows, keys, error, {"median": 0.5, "p95": 0.95}).withColumns({c: F.round(c, 6) for c in ("median", "p95")})


def stage_latency(rows: DataFrame, stages: str) -> DataFrame:
    """Per stage of a map stage -> ms, ragged keys allowed: n, mean, p50, p95."""
    long = rows.select(F.explode(stages).alias("stage", "ms"))
    out = long.groupBy("stage").agg(F.count("ms").alias("n"), F.round(F.avg("ms"), 6).alias("mean"))
    return with_quantiles(out, long, ["stage"], "ms", {"p50": 0.5, "p95": 0.95}).withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


def recall_by_size(truths: DataFrame, area: str, found: str, edges: Sequence[float]) -> DataFrame:
    """Recall per half-open size bucket; empty buckets stay, with null recall."""
    spark = truths.sparkSession
    buckets = spark.createDataFrame([(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))], "bucket int, lo double, hi double")
    on = (F.col(area) >= F.col("lo")) & (F.col(area) < F.col("hi"))
    n = truths.join(F.broadcast(buckets), on).groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col(found)).alias("found"))
    return buckets.join(n, "bucket", "left").select("bucket", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.col("found").cast("double") / F.col("n"), 6).alias("recall"))


def verdict_summary(rows: DataFrame, verdict: str, score: str) -> DataFrame:
    """Counts per verdict with scores at a tenth, half and nine tenths by rank."""
    shares = {"p10": 0.1, "median": 0.5, "p90": 0.9}
    out = with_quantiles(rows.groupBy(verdict).agg(F.count("*").alias("n")), rows, [verdict], score, shares, "rank")
    return out.withColumns({c: F.round(c, 6) for c in shares})


def accept_sweep(rows: DataFrame, score: str, eligible: Column, cuts: Sequence[float] = (0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """How many eligible rows each cut would accept, in one pass."""
    one = rows.agg(F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.count_if(eligible & (F.col(score) >= c)).alias("accepted")) for c in cuts]).alias("s"))
    return one.select(F.inline("s"))


def safety_summary(targets: DataFrame, candidate: str, reasons: str, truth: str) -> DataFrame:
    """Rates of candidates and of unsafe ones (truth false); denominators are floored at one."""
    c, n = F.count_if(F.col(candidate)), F.count("*")
    unsafe = F.count_if(F.col(candidate) & (F.col(truth) == F.lit(False)))
    known = F.count_if(F.col(candidate) & F.col(truth).isNotNull())
    return targets.agg(n.alias("n"), c.alias("candidates"), F.round(c / F.greatest(F.lit(1), n), 6).alias("candidate_rate"), F.round(unsafe / F.greatest(F.lit(1), c), 6).alias("unsafe_rate"), F.round(F.try_divide(unsafe.cast("double"), known), 6).alias("unsafe_of_known"))


def reason_counts(rows: DataFrame, reasons: str) -> DataFrame:
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def agreement(rows: DataFrame, keys: Sequence[str], both: str, a: str, b: str) -> DataFrame:
    """Per keys: mean and median overlap of paired masks and the share of at least 0.9; two
    empty masks agree fully."""
    union = F.col(a) + F.col(b) - F.col(both)
    iou = F.when(union == 0, 1.0).otherwise(F.col(both) / union)
    rows = rows.withColumn("iou", iou)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.avg((F.col("iou") >= 0.9).cast("double")), 6).alias("share_90"))
    return with_quantiles(out, rows, keys, "iou", {"median_iou": 0.5}).withColumn("median_iou", F.round("median_iou", 6))


def identity_errors(pairs: DataFrame, frame: str, least: float = 0.5) -> DataFrame:
    """Merges (one prediction covers at least half of two truths) and fragments (the other
    way round). pairs: frame, i, j, of_truth, of_pred (shares of each box covered)."""
    merge = pairs.filter(F.col("of_truth") >= least).groupBy(frame, "i").agg(F.count("*").alias("n")).filter("n >= 2").select(frame, F.lit("merge").alias("kind"), F.col("i").alias("instance"), "n")
    split = pairs.filter(F.col("of_pred") >= least).groupBy(frame, "j").agg(F.count("*").alias("n")).filter("n >= 2").select(frame, F.lit("fragment").alias("kind"), F.col("j").alias("instance"), "n")
    return merge.unionByName(split)


def scale_fit(rows: DataFrame, code: str, mm: str, spread: float = 0.10) -> DataFrame:
    """From percentiles of codes and millimetres: the median scale mm * 255 / code, and
    whether the scales agree within ``spread`` of it."""
    r = rows.filter(F.col(code) > 0).withColumn("s", F.col(mm) * 255.0 / F.col(code))
    out = with_quantiles(r.agg((F.max("s") - F.min("s")).alias("spread")), r, [], "s", {"scale": 0.5}).withColumn("spread", F.col("spread") / F.col("scale"))
    return out.select(F.round("scale", 6).alias("scale"), F.round("spread", 6).alias("spread"), (F.col("spread") <= spread).alias("linear"))


def percentile_map(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Percentiles of the non-zero values, one row a share."""
    return quantiles(rows.filter(F.col(value) != 0), keys, value, shares, name="p").select(*keys, F.posexplode("p").alias("k", "value")).withColumn("share", F.get(F.array(*[F.lit(float(s)) for s in shares]), F.col("k"))).drop("k")


def range_statistics(rows: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float) -> DataFrame:
    """Count, invalid (0) count, range, sum and share in range of a depth stream."""
    valid = F.when(F.col(value) > 0, F.col(value))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(value) == 0).alias("invalid"), F.min(valid).alias("least"), F.max(valid).alias("most"), F.round(F.sum(valid), 4).alias("total"), F.round(F.avg(valid.between(lo, hi).cast("double")), 6).alias("in_range"))


def rank_correlations(rows: DataFrame, keys: Sequence[str], x: str, ys: Sequence[str], tie: str) -> DataFrame:
    """Ordinal rank correlation of x with each of ys, per keys."""
    r = numbered(rows.select(*keys, x, *ys, tie), [x, tie], "_x", by=keys)
    for y in ys:
        r = numbered(r, [y, tie], f"_{y}", by=keys)
    return r.groupBy(*keys).agg(*[F.round(F.corr("_x", f"_{y}"), 6).alias(f"rho_{y}") for y in ys])


def preflight(counts: DataFrame, label: str, rare: int = 20) -> DataFrame:
    """Findings on classes from their counts in train and val."""
    tr, va = F.col("n_train"), F.col("n_val")
    rules = F.array_compact(
        F.array(
            F.when((tr == 0) & (va > 0), F.struct(F.lit("error").alias("level"), F.lit("class_missing_from_train").alias("kind"))),
            F.when((tr > 0) & (va == 0), F.struct(F.lit("warn").alias("level"), F.lit("class_missing_from_val").alias("kind"))),
            F.when((tr > 0) & (tr < rare), F.struct(F.lit("warn").alias("level"), F.lit("class_too_rare").alias("kind"))),
        )
    )
    return counts.select(label, F.explode(rules).alias("r")).select(label, "r.level", "r.kind")


def split_findings(frames: DataFrame, split: str, least_val: int = 20) -> DataFrame:
    """Findings on empty or small splits, from one aggregate."""
    n = frames.agg(*[F.count_if(F.col(split) == s).alias(s) for s in ("train", "val", "test")])
    f = lambda level, kind: F.struct(F.lit(level).alias("level"), F.lit(kind).alias("kind"))
    rules = F.array_compact(F.array(F.when(F.col("train") == 0, f("error", "no_train_frames")), F.when(F.col("val") == 0, f("error", "no_val_frames")), F.when((F.col("val") > 0) & (F.col("val") < least_val), f("warn", "val_too_small")), F.when(F.col("test") == 0, f("warn", "no_test_split"))))
    return n.select(F.inline(rules))


def blur_votes(anisotropy: Column, agreeing: Column, chance: Column, n: Column, rho: Column, strong: float = 0.5, weak: float = 0.25) -> Column:
    """struct(motion, optics, label): votes on the cause of blur."""
    axis = n >= 5
    motion = F.when(anisotropy >= strong, 1).otherwise(0) + F.when(axis & (agreeing >= F.greatest(F.lit(0.6), chance * 2)), 2).otherwise(0) + F.when(rho <= -0.3, 1).otherwise(0)
    optics = F.when((anisotropy <= weak) & (anisotropy < strong), 1).otherwise(0) + F.when(axis & (agreeing <= chance) & ~(agreeing >= F.greatest(F.lit(0.6), chance * 2)), 1).otherwise(0)
    label = F.when((motion >= 2) & (motion > optics), "motion").when((optics >= 1) & (optics >= motion), "optics").otherwise("inconclusive")
    return F.struct(motion.alias("motion"), optics.alias("optics"), label.alias("label"))


def depth_kind(rows: DataFrame, session: str, top: str, median: str, saturated: str, plausible: tuple[float, float] = (250.0, 3000.0), pinned: float = 0.97, spread: float = 0.02, peak: float = 0.02) -> DataFrame:
    """What a session's depth frames are, from each frame's maximum, median and saturation."""
    full = 65535.0
    s = rows.groupBy(session).agg(F.max(top).alias("hi"), F.min(top).alias("lo"), F.max(saturated).alias("sat"))
    s = with_quantiles(s, rows, [session], median, {"med": 0.5})
    preview = (F.col("lo") >= pinned * full) & (F.col("hi") - F.col("lo") <= spread * full) & (F.col("sat") < peak)
    kind = F.when(F.col("hi").isNull(), "uncertain").when(preview, "preview").when(F.col("med").between(*plausible), "metric").otherwise("uncertain")
    return s.select(session, kind.alias("kind"), F.round("med", 1).alias("median_value"))


def over_curation(rows: DataFrame, keys: Sequence[str], before: str, sweep: str, kept_share: float = 0.15, least: int = 12) -> DataFrame:
    """Sessions of which too little is kept, with the largest swept threshold that would
    keep enough. rows: keys, before, after, sweep: array of struct(threshold, kept)."""
    few = (F.col("after") / F.col(before) < kept_share) | (F.col("after") < least)
    enough = F.greatest(F.lit(float(least)), 0.25 * F.col(before))
    best = F.array_max(F.transform(F.filter(sweep, lambda s: s.kept >= enough), lambda s: s.threshold))
    return rows.filter((F.col(before) > 0) & few).select(*keys, before, "after", best.alias("suggested"))


def class_pool(counts: DataFrame, label: str, crop: str) -> DataFrame:
    """Recall and precision of all classes but the crop, pooled; null where undefined.
    counts: label, tp, n_gt, n_pred."""
    s = counts.filter(F.col(label) != crop).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "n_gt", "n_pred")])
    rate = lambda n: F.round(F.try_divide(F.col("tp").cast("double"), F.col(n)), 6)
    return s.select("tp", "n_gt", "n_pred", rate("n_gt").alias("recall"), rate("n_pred").alias("precision"))


def inside_rate(points: DataFrame, keys: Sequence[str], inside: Column) -> DataFrame:
    """Share of points inside their own mask; points without a mask (null) don't count."""
    return points.withColumn("_in", inside).groupBy(*keys).agg(F.count("_in").alias("n"), F.round(F.avg(F.col("_in").cast("double")), 6).alias("inside_rate"))


def compare_methods(rows: DataFrame, method: str, uv: tuple[str, str], truth: tuple[str, str], radius: str) -> DataFrame:
    """``error_summary`` of several methods' points against the same truths, a row a method."""
    error = F.sqrt((F.col(uv[0]) - F.col(truth[0])) ** 2 + (F.col(uv[1]) - F.col(truth[1])) ** 2)
    return error_summary(rows.withColumn("_error", error), [method], "_error", radius)


def errors_3d(rows: DataFrame, keys: Sequence[str], predicted: Sequence[str], truth: Sequence[str]) -> DataFrame:
    """Per keys: n, mean, median and 95th percentile of the distance, and the medians in the
    plane and in depth. Rows without a reference don't count."""
    part = [F.col(p) - F.col(t) for p, t in zip(predicted, truth, strict=True)]
    known = rows.select(*keys, F.sqrt(part[0] ** 2 + part[1] ** 2 + part[2] ** 2).alias("_d"), F.sqrt(part[0] ** 2 + part[1] ** 2).alias("_xy"), F.abs(part[2]).alias("_z")).filter("_d is not null")
    out = known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_d").alias("mean"))
    out = with_quantiles(out, known, keys, "_d", {"median": 0.5, "p95": 0.95})
    out = with_quantiles(out, known, keys, "_xy", {"xy_median": 0.5})
    out = with_quantiles(out, known, keys, "_z", {"z_median": 0.5})
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "p95", "xy_median", "z_median")})


def area_summary(rows: DataFrame, keys: Sequence[str], area: str, floor: float) -> DataFrame:
    """Per keys: n, areas at a tenth, half and nine tenths by place, the largest, how many lie
    under four times the floor, and whether these are more than half."""
    tiny = F.count_if(F.col(area) < 4 * floor)
    out = rows.groupBy(*keys).agg(F.count(area).alias("n"), F.max(area).alias("most"), tiny.alias("tiny")).withColumn("suspect", F.col("tiny") > 0.5 * F.col("n"))
    return with_quantiles(out, rows, keys, area, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, "floor")


def cluster_over_prediction(pairs: DataFrame, clusters: DataFrame, frame: str, covered: str, least: float = 0.5) -> DataFrame:
    """How many predicted clusters there are, and how many cover at least two truths that
    aren't clusters. pairs: frame, i, and the share of a truth that i covers, for predicted
    clusters and other truths; clusters: frame, i."""
    bad = pairs.filter(F.col(covered) >= least).groupBy(frame, "i").agg(F.count("*").alias("n")).filter("n >= 2")
    n = clusters.agg(F.count("*").alias("clusters")).crossJoin(F.broadcast(bad.agg(F.count("*").alias("over"))))
    return n.select("clusters", "over", F.round(F.try_divide(F.col("over").cast("double"), F.col("clusters")), 6).alias("rate"))


def contact_confusion(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rates of pixels confused near where crop and weed meet, both directions apart: crop read
    as weed among crop pixels, weed read as crop among weed pixels. frames: crop_px,
    crop_as_weed, weed_px, weed_as_crop."""
    s = frames.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("crop_px", "crop_as_weed", "weed_px", "weed_as_crop")])
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 6)
    return s.withColumn("crop_error", rate("crop_as_weed", "crop_px")).withColumn("weed_error", rate("weed_as_crop", "weed_px"))
