"""Decisions on frames: manual drops, restores, classes of a build, diagnoses of sessions."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.matching import in_ranges
from tessera.schemas import CLASSES


def manual_drops(rows: DataFrame, ranges: DataFrame, index: str, reason: str, dropped: str = "dropped", why: str = "drop_reason") -> tuple[DataFrame, DataFrame]:
    """(rows with those in a range of lo..hi dropped, single indices that no row has). Rows
    without an index (negative) are left; rows already dropped keep their reason."""
    named = in_ranges(rows.filter(F.col(index) >= 0).select(index).distinct(), ranges, index).withColumn("_named", F.lit(True))
    out = rows.join(named, index, "left")
    new = F.coalesce("_named", F.lit(False)) & ~F.col(dropped)
    out = out.withColumn(why, F.when(new, reason).otherwise(F.col(why))).withColumn(dropped, F.col(dropped) | new).drop("_named")
    singles = ranges.filter("lo = hi").select(F.col("lo").alias(index)).distinct()
    return out.select(*rows.columns), singles.join(rows.select(F.col(index).cast("long").alias(index)), index, "left_anti")


def restore_all(rows: DataFrame, dropped: str = "dropped", why: str = "drop_reason") -> DataFrame:
    """rows with every drop taken back, and ``restored`` where there was one."""
    return rows.withColumn("restored", F.col(dropped)).withColumn(dropped, F.lit(False)).withColumn(why, F.lit(None).cast("string"))


def classes_left_out(drop: Collection[str] = (), keep: Collection[str] | None = None, known: Sequence[str] = CLASSES) -> set[str]:
    """The classes that a build leaves out: those dropped, and all that a list of kept ones
    doesn't name. Unknown names, an empty list to keep and nothing left are errors."""
    if unknown := sorted({*drop, *(keep or ())} - set(known)):
        raise ValueError(f"unknown classes: {unknown}")
    if keep is not None and not keep:
        raise ValueError("no class is to be kept")
    out = set(drop) | (set(known) - set(keep) if keep is not None else set())
    if out >= set(known):
        raise ValueError("every class is dropped")
    return out


def drop_classes(instances: DataFrame, label: str, gone: Collection[str]) -> DataFrame:
    """Instances of the classes that stay; frames are another table and stay."""
    return instances.filter(~F.coalesce(F.col(label).isin(*gone), F.lit(False))) if gone else instances


def with_instances(frames: DataFrame, instances: DataFrame, frame: str) -> DataFrame:
    """Frames that still have an instance."""
    return frames.join(instances.select(frame), frame, "left_semi")


def pose_diagnosis(rows: DataFrame, session: str, recorded: Column, usable: Column, state: str) -> DataFrame:
    """Per session: frames, with a recorded and with a usable pose, the states seen, and a code:
    not_recorded, never_trusted, partly_usable or usable."""
    n = rows.groupBy(session).agg(F.count("*").alias("n"), F.count_if(recorded).alias("n_recorded"), F.count_if(usable).alias("n_usable"), F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(state), F.lit("")))), ",").alias("states"))
    code = F.when(F.col("n_recorded") == 0, "not_recorded").when(F.col("n_usable") == 0, "never_trusted").when(F.col("n_usable") < F.col("n"), "partly_usable").otherwise("usable")
    return n.withColumn("diagnosis", code)


# What tells an 8-bit preview that each frame's own maximum scaled.
PREVIEW_FRAMES, PREVIEW_TOP, PREVIEW_SPREAD, PREVIEW_SATURATED = 3, 245, 12, 0.02


def scaled_by_own_maximum(frames: Column, least_top: Column, most_top: Column, saturated: Column) -> Column:
    """Whether frames of a video were each scaled by their own maximum; null for too few."""
    return F.when(frames >= PREVIEW_FRAMES, (least_top >= PREVIEW_TOP) & (most_top - least_top <= PREVIEW_SPREAD) & (saturated < PREVIEW_SATURATED))


def depth_videos(frames: DataFrame, video: str, wide: str, top: str, saturated: str, chroma: str, residual: str, gray: float = 12.0, colours: float = 18.0) -> DataFrame:
    """What each depth video holds, from its decoded frames (top: null for a frame that can't
    be decoded): verdict, whether depth can be recovered, and whether exactly. wide: whether
    its pixel format holds 16 bits; residual: distance to the nearest known colour map."""
    seen = F.col(top).isNotNull()
    v = frames.groupBy(video).agg(
        F.bool_or(wide).alias("wide"),
        F.count_if(seen).alias("n_frames"),
        F.min(top).alias("least_top"),
        F.max(top).alias("most_top"),
        F.max(F.when(seen, F.col(saturated))).alias("saturated"),
        F.max(F.when(seen, F.col(chroma))).alias("chroma"),
        F.min(F.when(seen, F.col(residual))).alias("residual"),
    )
    own = F.coalesce(scaled_by_own_maximum(F.col("n_frames"), F.col("least_top"), F.col("most_top"), F.col("saturated")), F.lit(False))
    grey = F.col("chroma") <= gray
    verdict = F.when(F.col("wide"), "true_16bit").when(F.col("n_frames") == 0, "undecodable").when(~grey & (F.col("residual") > colours), "unknown_8bit").when(own, "per_frame_normalised_8bit").when(grey, "grayscale_8bit").otherwise("colormapped_8bit")
    out = v.select(video, "n_frames", verdict.alias("verdict"))
    return out.withColumn("recoverable", F.col("verdict").isin("true_16bit", "grayscale_8bit", "colormapped_8bit")).withColumn("exact", F.col("verdict") == "true_16bit")
