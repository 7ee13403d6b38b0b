"""Column expressions: predicates, scores and scalar functions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schemas import CLASSES, CROP_CLASS

# Gates of a usable frame (name, column, default where missing, limit, side).
QC_GATES = {"min_sharpness": 60.0, "min_veg_frac": 0.02, "max_clip_frac": 0.15, "max_dark_frac": 0.35, "min_depth_valid_frac_veg": 0.30}
POSE_OK_STATES = ("OK", "SEARCHING_FLOOR_PLANE")
SCENE_ALIASES = {"onion": "onion_only", "onions": "onion_only", "onlyonions": "onion_only", "onion_only": "onion_only", "crop_only": "onion_only", "weed": "weed_only", "weeds": "weed_only", "weed_only": "weed_only", "mixed": "mixed", "mix": "mixed", "both": "mixed"}
SIXTEEN_BIT_HINTS = ("gray16", "gray14", "gray12", "gray10", "16le", "16be")
QUALITY_WEIGHTS = {"veg_precision": 0.35, "veg_recall": 0.35, "stability": 0.20, "confidence": 0.10}
QUALITY_GATES = {"veg_precision": 0.55, "veg_recall": 0.80}


def number(column: Column | str, default: float | None = None) -> Column:
    """A number from text; blank, missing or unreadable gives the default."""
    value = (F.col(column) if isinstance(column, str) else column).cast("string").try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def listed(*pairs: tuple[Column, Column | str]) -> Column:
    """The values whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(v) if isinstance(v, str) else v) for c, v in pairs]))


def gate_failures(sharpness: Column, veg: Column, clip: Column, dark: Column, depth: Column, gates: Mapping[str, float] = QC_GATES) -> Column:
    """All gates that a frame fails, in order. Missing sharpness and vegetation count as 0
    and missing clipping and darkness as 1, so they fail; missing depth passes."""
    return listed(
        (F.coalesce(sharpness, F.lit(0.0)) < gates["min_sharpness"], "min_sharpness"),
        (F.coalesce(veg, F.lit(0.0)) < gates["min_veg_frac"], "min_veg_frac"),
        (F.coalesce(clip, F.lit(1.0)) > gates["max_clip_frac"], "max_clip_frac"),
        (F.coalesce(dark, F.lit(1.0)) > gates["max_dark_frac"], "max_dark_frac"),
        (depth < gates["min_depth_valid_frac_veg"], "min_depth_valid_frac_veg"),
    )


def difficulty(sharpness: Column, clip: Column, dark: Column, depth: Column) -> Column:
    """How hard a frame is: blur, glare, darkness and, where known, missing depth."""
    blur = F.greatest(F.lit(0.0), 1.0 - F.coalesce(sharpness, F.lit(500.0)) / 300.0)
    glare = 0.8 * F.least(F.lit(1.0), F.coalesce(clip, F.lit(0.0)) / 0.1)
    dim = 0.6 * F.least(F.lit(1.0), F.coalesce(dark, F.lit(0.0)) / 0.3)
    return blur + glare + dim + F.coalesce(1.2 * (1.0 - depth), F.lit(0.0))


def is_dropped(flag: Column) -> Column:
    return F.coalesce(F.trim(flag.cast("string")).isin("1", "true", "True"), F.lit(False))


def index_of(filename: Column) -> Column:
    """The frame index that a file name ends in, -1 without one."""
    stem = F.regexp_replace(F.regexp_extract(filename, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.coalesce(F.regexp_extract(stem, r"(?:^|_)(\d+)$", 1).try_cast("int"), F.lit(-1))


def frame_index(index: Column, filename: Column) -> Column:
    """The index column, cut to an integer, else the file name's."""
    return F.coalesce(index.cast("string").try_cast("double").cast("int"), index_of(filename))


def usable_pose(state: Column, x: Column, y: Column, z: Column, ok: Sequence[str] = POSE_OK_STATES) -> Column:
    """struct(x, y, z) or null: a blank state passes, others must contain one of ``ok``."""
    state = F.trim(F.coalesce(state, F.lit("")))
    fine = (state == "") | F.exists(F.array(*[F.lit(s) for s in ok]), lambda s: F.contains(state, s)) if ok else F.lit(True)
    parts = [F.nanvl(number(c), F.lit(None).cast("double")) for c in (x, y, z)]
    known = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(fine & known, F.struct(parts[0].alias("x"), parts[1].alias("y"), parts[2].alias("z")))


def canonical_label(name: Column, classes: Sequence[str] = CLASSES) -> Column:
    """The class whose name this is but for case, blanks and dashes; else the name itself."""
    key = F.regexp_replace(F.lower(F.trim(name)), r"[\s\-]+", "_")
    return F.when(key.isin(*classes), key).otherwise(name)


def repaired_category(name: Column, renames: Mapping[str, str], classes: Sequence[str] = CLASSES) -> Column:
    """A known class, a renamed one, one with blanks for underscores, or null."""
    known = name.isin(*classes)
    renamed = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])[name] if renames else F.lit(None)
    spaced = F.regexp_replace(F.trim(name), " ", "_")
    return F.when(known, name).otherwise(F.coalesce(renamed, F.when(spaced.isin(*classes), spaced)))


def normalise_scene(value: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[ -]", "_")
    aliases = F.create_map(*[F.lit(x) for kv in SCENE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, key), F.lit("unknown"))


def parse_session_id(sid: Column) -> Column:
    """struct(camera, date) from camera_yyyymmdd_hhmmss; blanks if it has another form."""
    pattern = r"^([A-Za-z0-9]+)_(\d{8})_(\d{6})$"
    day = F.regexp_extract(sid, pattern, 2)
    iso = F.when(day == "", F.lit("")).otherwise(F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)))
    return F.struct(F.regexp_extract(sid, pattern, 1).alias("camera"), iso.alias("date"))


def make_session_id(folder: Column, trip: Column, modified: Column) -> Column:
    """trip_yyyymmdd_hhmmss from the folder's name, else from its time of change."""
    found = F.regexp_extract(folder, r"(\d{8}_\d{6})", 1)
    return F.concat_ws("_", trip, F.when(found != "", found).otherwise(F.date_format(modified, "yyyyMMdd_HHmmss")))


def session_of_frame(stem: Column, override: Column | None = None) -> Column:
    """What stands before a trailing number; an override by id wins."""
    found = F.regexp_extract(stem, r"^(.*)_(\d+)$", 1)
    found = F.when(found != "", found).otherwise(stem)
    return found if override is None else F.coalesce(override, found)


def stride_of(fps: Column, target: float) -> Column:
    """Every how many frames, to come near the target rate."""
    return F.greatest(F.lit(1), F.bround(fps / target, 0).cast("int"))


def pseudo_verdict(empty: Column, gates_failed: Column, score: Column, accept: float = 0.75, review: float = 0.45) -> Column:
    return F.when(empty, "skip").when((F.size(gates_failed) > 0) | (score < review), "review").when(score >= accept, "accept").otherwise("skip")


def frame_quality(both: Column, pred: Column, veg: Column, n: Column, suppressed: Column, confidence: Column) -> Column:
    """struct of precision, recall, stability, confidence, score and failed gates from pixel counts."""
    precision = F.coalesce(F.try_divide(both.cast("double"), pred), F.lit(0.0))
    recall = F.when(veg > 0, both.cast("double") / veg).when(pred > 0, 0.0).otherwise(1.0)
    stability = F.coalesce(F.try_divide(n.cast("double"), n + suppressed), F.lit(0.0))
    parts = {"veg_precision": precision, "veg_recall": recall, "stability": stability, "confidence": F.coalesce(confidence, F.lit(0.0))}
    score = sum((w * parts[k] for k, w in QUALITY_WEIGHTS.items()), F.lit(0.0))
    failed = listed(*[(parts[k] < floor, k) for k, floor in sorted(QUALITY_GATES.items())])
    return F.struct(*[v.alias(k) for k, v in parts.items()], F.round(score, 4).alias("score"), failed.alias("gates_failed"), (veg == 0).alias("empty"))


def pseudo_budget(n_hand: Column, n_existing: Column, ratio: float = 2.0) -> Column:
    return F.greatest(F.lit(0), F.floor(F.lit(ratio) * n_hand).cast("int") - n_existing)


def review_reasons(instances: Column, veg_px: Column, coverage: Column, growth: Column, largest: Column, min_coverage: float, max_growth: float, max_share: float) -> Column:
    """Why a frame should be looked at first: array of struct(code, value)."""
    said = lambda code, value: F.struct(F.lit(code).alias("code"), value.cast("double").alias("value"))
    return F.array_compact(
        F.array(
            F.when(instances == 0, said("empty", instances)),
            F.when((veg_px > 0) & (coverage < min_coverage), said("low_coverage", coverage)),
            F.when(growth > max_growth, said("seed_growth", growth)),
            F.when(largest > max_share, said("large_instance", largest)),
        )
    )


def morphology_class(aspect: Column, area: Column, peaks: Column, min_peaks: int = 3, min_area: float = 4000.0, min_aspect: float = 4.0, default: str = "other_weed") -> Column:
    """struct(class_name, confidence) from shape: clusters first, then long shapes."""
    over = peaks / F.lit(float(max(1, min_peaks))) - 1.0
    margin = F.least(F.lit(1.0), aspect / max(1e-6, min_aspect) - 1.0)
    pair = lambda name, value: F.struct(F.lit(name).alias("class_name"), value.alias("confidence"))
    cluster = (peaks >= min_peaks) & (area >= min_area)
    return F.when(aspect.isNull(), pair(default, F.lit(0.0))).when(cluster, pair("weed_cluster", F.round(F.least(F.lit(1.0), 0.5 + 0.5 * over), 3))).when(aspect >= min_aspect, pair("grass_weed", F.round(0.5 + 0.5 * margin, 3))).otherwise(pair(default, F.lit(0.0)))


def growth_stage(area: Column, small: float = 1200.0, early: float = 6000.0) -> Column:
    return F.when(area <= small, "cotyledon").when(area <= early, "2-leaf").otherwise("3-5-leaf")


def depth_precision_problem(pix_fmt: Column, codec: Column) -> Column:
    """Null if the pixel format holds 16 bits; else what is wrong."""
    fmt = F.lower(F.coalesce(pix_fmt, F.lit("")))
    wide = F.exists(F.array(*[F.lit(h) for h in SIXTEEN_BIT_HINTS]), lambda h: F.contains(fmt, h))
    return F.when(fmt == "", F.concat(F.lit("no pixel format from codec "), F.coalesce(F.lower(codec), F.lit("?")))).when(~wide, F.concat(F.lit("not 16-bit: "), fmt))


def preview_millimetres(code: Column, lo: float, hi: float, tv_range: bool = False) -> Column:
    """An 8-bit preview code as millimetres; 0 stays invalid."""
    c = F.least(F.greatest((code - 16) * 255 / 219, F.lit(0.0)), F.lit(255.0)) if tv_range else code.cast("double")
    return F.when(c > 0, lo + c / 255 * (hi - lo)).otherwise(0.0)


def confidence_valid(value: Column, polarity: Column, threshold: Column, top: float = 100.0, unmeasured: int = 255) -> Column:
    """Null where the polarity is unknown; the threshold is a share of the declared range."""
    known = (value != unmeasured) & F.when(polarity == "high_is_good", value >= threshold * top).when(polarity == "low_is_good", value <= threshold * top)
    return F.when(polarity.isin("high_is_good", "low_is_good"), known)


def supervision_weight(visibility: Column, partial: float = 0.5) -> Column:
    return F.when(visibility == "not_visible", 0.0).when(visibility == "partially_occluded_inferable", partial).otherwise(1.0)


def needs_point(class_name: Column, visibility: Column, targetable: Column) -> Column:
    """Whether an instance must carry a growth point."""
    return (class_name != CROP_CLASS) & (class_name != "weed_cluster") & ~F.coalesce(visibility == "not_visible", F.lit(False)) & ~F.coalesce(targetable == "no", F.lit(False))


def provenance_caveat(description: Column) -> Column:
    text = F.lower(F.coalesce(description, F.lit("")))
    return F.when(F.contains(text, F.lit("prelabel")), "prelabel_unreviewed").when(F.contains(text, F.lit("corrected")), "hand_corrected").otherwise("unknown")


# ---------------------------------------------------------------- hashes and bits
def stable_rank(seed: int | Column, key: Column) -> Column:
    """A reproducible place in [0, 1] for a key."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.crc32(F.concat(seed, F.lit(":"), key.cast("string")).cast("binary")) / F.lit(4294967295.0)


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hexadecimal."""
    bits = lambda x: F.conv(x, 16, -10).cast("bigint")
    return F.bit_count(bits(a).bitwiseXOR(bits(b)))


# ---------------------------------------------------------------- time and text
def synthetic_timestamp_ns(index: Column, fps: Column) -> Column:
    return F.floor(index / fps * F.lit(1e9)).cast("long")


def duration_text(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.when(s >= 3600, F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def glob_to_regex(glob: str) -> str:
    """An anchored regular expression for a shell pattern (*, ?, [..])."""
    out = ""
    for c in glob:
        out += {"*": ".*", "?": ".", "[": "[", "]": "]"}.get(c) or ("\\" + c if c in "\\.+^${}()|" else c)
    return f"^{out.replace('[!', '[^')}$"
