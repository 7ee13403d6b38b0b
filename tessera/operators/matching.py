"""Joins of predictions and truths, and other spatial, nearest and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import box_iou, boxes_overlap


def instance_pairs(pred: DataFrame, truth: DataFrame, frame: str, same_class: bool = False, least: float = 0.0) -> DataFrame:
    """Overlapping pairs of a frame's boxes with their iou; the join tests boxes before any
    overlap is computed. pred: frame, i, x, y, w, h, cls, score; truth: frame, j, ..., cls."""
    p, t = pred.alias("p"), truth.alias("t")
    box = lambda a: [F.col(f"{a}.{c}") for c in "xywh"]
    on = (F.col(f"p.{frame}") == F.col(f"t.{frame}")) & boxes_overlap(*box("p"), *box("t"))
    if same_class:
        on = on & (F.col("p.cls") == F.col("t.cls"))
    out = p.join(t, on).withColumn("iou", box_iou(*box("p"), *box("t"))).filter(F.col("iou") >= least)
    return out.select(F.col(f"p.{frame}").alias(frame), "i", "j", "iou", F.col("p.cls").alias("cls"), F.col("t.cls").alias("truth_cls"), F.col("p.score").alias("score"))


def nearest_owner(points: DataFrame, centres: DataFrame, frame: str) -> DataFrame:
    """Each point's nearest centre in its frame; of equal distances the first centre.
    points: frame, k, px, py; centres: frame, j, cx, cy."""
    both = points.join(centres, frame, "left")
    d = F.sqrt((F.col("px") - F.col("cx")) ** 2 + (F.col("py") - F.col("cy")) ** 2)
    best = F.min(F.when(F.col("j").isNotNull(), F.struct(d.alias("distance"), "j"))).alias("b")
    return both.groupBy(frame, "k").agg(best).select(frame, "k", F.col("b.j").alias("owner"), F.col("b.distance").alias("distance"))


def seam_separation(frames: DataFrame, session: str, index: str, split: str) -> DataFrame:
    """Per session and held-out split the least distance of its frames to a train frame, by
    one window pass each way; sessions without train frames are left out."""
    w = Window.partitionBy(session).orderBy(index)
    train = F.when(F.col(split) == "train", F.col(index))
    before = F.last(train, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(train, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = frames.withColumn("distance", F.least(F.col(index) - before, after - F.col(index)))
    return out.filter(F.col(split).isin("val", "test") & F.col("distance").isNotNull()).groupBy(session, split).agg(F.min("distance").alias("separation"))


def seam_problems(separations: DataFrame, separation: str, floor: int = 60) -> DataFrame:
    """Sessions and splits whose frames come nearer to train frames than the floor."""
    return separations.filter(F.col(separation) < floor)


def in_ranges(frames: DataFrame, ranges: DataFrame, index: str, keys: list[str] | None = None) -> DataFrame:
    """Frames whose index lies in a range (lo, hi; hi null: open), each frame once."""
    on = F.col(f"f.{index}").between(F.col("r.lo"), F.coalesce(F.col("r.hi"), F.lit(2**62)))
    for k in keys or []:
        on = on & (F.col(f"f.{k}") == F.col(f"r.{k}"))
    return frames.alias("f").join(F.broadcast(ranges.alias("r")), on, "left_semi")


def first_with_metadata(sessions: DataFrame, metadata: DataFrame, session: str, priority: str) -> DataFrame:
    """Each session with the metadata of the first root that has any."""
    first = metadata.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(priority))).filter("_n = 1").drop("_n")
    return sessions.join(first, session, "left")


def sided_frames(pred: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Counts of frames on both sides, only predicted and only in the truth."""
    both = pred.select(key, F.lit(1).alias("p")).distinct().join(truth.select(key, F.lit(1).alias("t")).distinct(), key, "full")
    return both.agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("both"), F.count_if(F.col("t").isNull()).alias("only_pred"), F.count_if(F.col("p").isNull()).alias("only_truth"))


def log_rows(frames: DataFrame, log: DataFrame, session: str, index: str, fps: Column) -> DataFrame:
    """Decoded frame i with row i of the capture log; a missing timestamp is made from the rate."""
    from tessera.functions.columns import synthetic_timestamp_ns

    out = frames.join(log, [session, index], "left")
    made = out["timestamp_ns"].isNull()
    return out.withColumn("synthetic", made).withColumn("timestamp_ns", F.coalesce("timestamp_ns", synthetic_timestamp_ns(F.col(index), fps)))


def group_points(shapes: DataFrame, points: DataFrame, item: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Growth points to plants by annotation group inside an item; group 0 is none. Returns
    (item, group, shape, point) and findings of groups that aren't one shape and one point.
    shapes and points have the columns item, group, k (order)."""
    s = shapes.filter(F.col(group) != 0).groupBy(item, group).agg(F.count("*").alias("n_shapes"), F.min("k").alias("shape"))
    p = points.groupBy(item, group).agg(F.count("*").alias("n_points"), F.min("k").alias("point"))
    both = s.join(p, [item, group], "full")
    kind = F.when(F.col(group) == 0, "ungrouped_point").when(F.col("n_shapes").isNull(), "point_without_plant").when(F.col("n_points") > 1, "several_points").when((F.col("n_shapes") > 1) & F.col("n_points").isNotNull(), "several_plants")
    findings = both.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(item, group, "kind")
    return both.filter((F.col(group) != 0) & F.col("shape").isNotNull() & F.col("point").isNotNull()).select(item, group, "shape", "point"), findings
