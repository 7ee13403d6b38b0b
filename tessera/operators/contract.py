"""Validation of annotations: rules are optional structs of a row; findings are those that hold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import needs_point
from tessera.functions.geometry import point_in_polygon
from tessera.schemas import CLASSES, CROP_CLASS


def rule(when: Column, severity: str, kind: str, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), detail.cast("string").alias("detail")))


def findings(rows: DataFrame, frame: str, rules: Sequence[Column]) -> DataFrame:
    """frame, severity, kind, detail of every rule that a row breaks, in one pass."""
    return rows.select(F.col(frame).alias("frame"), F.inline(F.array_compact(F.array(*rules))))


def parse_findings(notes: DataFrame, frame: str = "item_id") -> DataFrame:
    """What can't be read of annotations (as the annotation reader gives them)."""
    name, shape, n = F.col("label"), F.col("type"), F.coalesce(F.size("points"), F.lit(0))
    known = name.isin(*CLASSES)
    drawn = shape.isin("polygon", "mask", "bbox")
    at = F.concat_ws(":", "label", "type")
    return findings(
        notes,
        frame,
        [
            rule(F.coalesce(F.col("session_id"), F.lit("")) == F.coalesce(F.col(frame), F.lit("")), "error", "unresolvable_session", F.col(frame)),
            rule(shape.isNotNull() & name.isNull(), "error", "bad_label_id", F.col("label_id")),
            rule((name == "weed_LEP") & (n < 2), "error", "empty_lep", at),
            rule(name.isNotNull() & ~known & ~name.isin("weed_LEP", "ignore_region"), "error", "unknown_label", name),
            rule(known & (shape == "bbox"), "warning", "bbox_only_instance", at),
            rule(known & ~drawn, "error", "unsupported_shape", at),
            rule(known & (shape == "polygon") & (n < 6), "error", "empty_shape", at),
        ],
    )


def instance_findings(instances: DataFrame, least_area: float = 64.0, near: float = 3.0, require_point: bool = True) -> DataFrame:
    """instances: frame, k, class_name, area, polygon (flat), px, py (null: no point),
    edge_distance, visibility, targetable."""
    has, cls = F.col("px").isNotNull(), F.col("class_name")
    rows = instances.withColumn("_outside", has & F.col("polygon").isNotNull() & ~point_in_polygon(F.col("px"), F.col("py"), F.col("polygon")))
    at = F.concat_ws(":", F.col("k").cast("string"), "class_name")
    rules = [
        rule(F.col("area") < least_area, "warning", "tiny_instance", at),
        rule(has & (cls == CROP_CLASS), "error", "lep_on_onion", at),
        rule(has & (cls == "weed_cluster"), "error", "lep_on_cluster", at),
        rule(F.col("_outside"), "error", "lep_outside_owning_mask", at),
        rule(has & ~F.col("_outside") & (F.col("edge_distance") < near), "warning", "lep_near_mask_edge", at),
    ]
    if require_point:
        rules.append(rule(~has & needs_point(cls, F.col("visibility"), F.col("targetable")), "error", "missing_lep", at))
    return findings(rows, "frame", rules)


def duplicate_items(rows: DataFrame, key: str, source: str) -> DataFrame:
    """Keys that several sources hold."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(source).alias("n_sources")).filter("n > 1")


def union_named(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """The rows of all parts, with the part they come from."""
    return reduce(DataFrame.unionByName, [rows.withColumn(name, F.lit(part)) for part, rows in parts.items()])


def cross_check(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of which two sources hold different numbers of rows."""
    both = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    n = both.groupBy(key).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    return n.filter(F.col("n_a") != F.col("n_b"))


def safety_reasons(class_name: Column, confidence: Column, lep: Column, signed_distance: Column, crop_mask: Column, crop_distance: Column, depth: Column, limits: dict, visibility: Column, targetable: Column, allow_missing_crop: bool = False) -> Column:
    """All reasons against treating a target, in order and once each; none makes a
    candidate. lep: struct(peak, sigma) or null, which ends the list; signed_distance: to
    the owning mask, negative outside, null unknown; crop_mask: whether one exists; depth:
    struct(ok, reason, valid_fraction, spread, sigma) or null, which is allowed."""
    no = lambda c, r: F.when(F.coalesce(c, F.lit(False)), r)
    early = [
        no(class_name == CROP_CLASS, "onion_plant"),
        no(class_name == "weed_cluster", "weed_cluster"),
        F.when(F.coalesce(confidence, F.lit(-1.0)) < limits["class_confidence"], "class_uncertain"),
        no(visibility == "not_visible", "lep_not_visible"),
        no(targetable.isin("no", "uncertain"), "not_targetable"),
    ]
    late = [
        F.when(F.coalesce(lep["peak"], F.lit(0.0)) < limits["peak"], "low_lep_confidence"),
        no(lep["sigma"] > limits["sigma"], "high_heatmap_uncertainty"),
        no(signed_distance < -limits["snap"], "outside_owning_mask"),
        F.when(~crop_mask & F.lit(not allow_missing_crop), "crop_protection_unavailable"),
        no(crop_mask & (crop_distance <= limits["crop_margin"]), "onion_safety_conflict"),
        no(depth.isNotNull() & ~depth["ok"], F.when(depth["reason"] == "depth_discontinuity", "depth_discontinuity").otherwise("insufficient_valid_depth")),
        no(depth["ok"] & (depth["valid_fraction"] < limits["valid_fraction"]), "insufficient_valid_depth"),
        no(depth["ok"] & (depth["spread"] > limits["spread"]), "depth_discontinuity"),
        no(depth["ok"] & (depth["sigma"] > limits["sigma_3d"]), "high_3d_uncertainty"),
    ]
    first = F.array_compact(F.array(*early))
    every = F.array_compact(F.array(*early, *late))
    return F.array_distinct(F.when(lep.isNull(), F.concat(first, F.array(F.lit("no_lep_predicted")))).otherwise(every))
