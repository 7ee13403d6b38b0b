"""Order-dependent greedy operators.

Thinning passes over a session's sorted rows in a stream. Suppression and matching are folds
over one frame's sorted array, inside the JVM; a frame holds what one picture shows, so such
a group is small however large the table is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tessera.functions.geometry import struct_iou


def sorted_rows(*columns: Column) -> Column:
    """A group's rows as an array of structs, in the order of the columns."""
    return F.array_sort(F.collect_list(F.struct(*columns)))


def keep_by_travel(rows: DataFrame, group: str | list[str], order: str, position: str, threshold: Column | float, forced: str | None = None, live: Column | None = None) -> DataFrame:
    """rows with ``kept``: of each group in its order the first live row stays; another stays
    if forced, or if it lies at least ``threshold`` from the last that stayed. Rows that aren't
    live have null. A task passes its sorted rows once and holds one anchor, no group."""
    keys, names = [group] if isinstance(group, str) else list(group), rows.columns
    limit = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold.cast("double")
    extra = {"_p": F.col(position).cast("double"), "_f": F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False), "_t": limit, "_l": F.lit(True) if live is None else F.coalesce(live, F.lit(False))}
    fields = list(extra)
    sorted_ = rows.withColumns(extra).repartition(*keys).sortWithinPartitions(*keys, order, "_p", "_f")

    def run(batches):
        import pyarrow as pa

        own, anchor, first = None, None, True
        for batch in batches:
            at = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            kept = []
            for key, p, f, t, live_ in zip(zip(*at, strict=True), *(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in fields), strict=True):
                if key != own:
                    own, anchor, first = key, None, True
                if not live_:
                    kept.append(None)
                    continue
                stays = first or f or anchor is None or (p is not None and abs(p - anchor) >= t)
                if stays:
                    anchor, first = p, False
                kept.append(stays)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.bool_())], names=[*names, "kept"])

    schema = StructType([*rows.schema.fields, StructField("kept", BooleanType())])
    return sorted_.mapInArrow(run, schema)


def mark_redundant(rows: DataFrame, group: str, order: str, position: str, threshold: float, dropped: str = "dropped", reason: str = "redundant") -> DataFrame:
    """rows with dropped and drop_reason set on live rows that thinning leaves out; rows
    already dropped keep their reason."""
    out = keep_by_travel(rows, group, order, position, threshold, live=~F.col(dropped))
    hit = F.coalesce(~F.col("kept"), F.lit(False))
    return out.withColumn("drop_reason", F.when(hit, reason).otherwise(F.col("drop_reason"))).withColumn(dropped, F.col(dropped) | hit).drop("kept")


def suppress(rows: DataFrame, group: str, key: str, rank: Sequence[Column], threshold: float, strict: bool = False) -> DataFrame:
    """One row a group with ``kept``: keys of boxes that no better kept box overlaps.
    ``rank``: sort columns, best first (use negated scores or areas). A box falls at an
    overlap of at least the threshold, or, if strict, above it."""
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in "xywh"], F.col(key).alias("key"))
    grouped = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], box.alias("b")))).alias("rows"))
    empty = F.filter(F.transform("rows", lambda r: r.b), lambda b: F.lit(False))
    over = (lambda v: v > threshold) if strict else (lambda v: v >= threshold)

    def step(kept, row):
        return F.when(F.exists(kept, lambda k: over(struct_iou(k, row.b))), kept).otherwise(F.concat(kept, F.array(row.b)))

    return grouped.select(group, F.array_sort(F.transform(F.aggregate("rows", empty, step), lambda b: b.key)).alias("kept"))


def match_pairs(pairs: DataFrame, group: str | list[str], order: Sequence[Column], left: str = "i", right: str = "j", carry: str | None = None) -> DataFrame:
    """One row a group with ``matched``: array of (i, j), one to one, taken greedily in the
    given order (ascending; negate for descending), with the column ``carry`` if given."""
    more = [F.col(carry).alias(carry)] if carry else []
    item = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.col(left).cast("long").alias("i"), F.col(right).cast("long").alias("j"), *more)
    grouped = pairs.groupBy(*([group] if isinstance(group, str) else group)).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    pick = lambda r: F.struct(r.i.alias("i"), r.j.alias("j"), *([r[carry].alias(carry)] if carry else []))
    none = F.filter(F.transform("rows", pick), lambda r: F.lit(False))

    def step(acc, row):
        taken = F.exists(acc, lambda m: (m.i == row.i) | (m.j == row.j))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(pick(row))))

    return grouped.withColumn("matched", F.aggregate("rows", none, step)).drop("rows")


def greedy_match(pairs: DataFrame, group: str | list[str], iou: str = "iou") -> DataFrame:
    """Pairs in descending (iou, i, j)."""
    return match_pairs(pairs, group, [-F.col(iou), -F.col("i"), -F.col("j")])


def match_by_score(pairs: DataFrame, group: str | list[str], iou: str = "iou", score: str = "score", carry: str | None = None) -> DataFrame:
    """For average precision: predictions in descending score (then index), each with its
    best truth still free; of equal overlaps the later truth wins. What is matched above a
    cut of the score is what would be matched if only scores above it were given."""
    return match_pairs(pairs, group, [-F.col(score), F.col("i"), -F.col(iou), -F.col("j")], carry=carry)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def largest_gap(values: Column, weights: Column, gap: float, minority: float) -> Column:
    """struct(median, spread, discontinuous) of a small array of depths with weights: a gap
    of more than ``gap`` between neighbours with at least a share ``minority`` on the
    smaller side marks a discontinuity; the median is weighted, the spread 1.4826 x MAD."""
    pairs = F.array_sort(F.zip_with(values, weights, lambda v, w: F.struct(v.alias("v"), w.cast("double").alias("w"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("m"))

    def median_of(pairs: Column, total: Column) -> Column:
        def step(acc, p):
            run = acc["sum"] + p.w
            return F.struct(run.alias("sum"), F.coalesce(acc.m, F.when(run >= total / 2, p.v.cast("double"))).alias("m"))

        return F.aggregate(pairs, start, step, lambda acc: acc.m)

    def gaps_of(pairs: Column) -> Column:
        n = F.size(pairs)
        gaps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct((F.get(pairs, i).v - F.get(pairs, i - 1).v).alias("g"), F.least(i, n - i).alias("side")))
        return F.exists(gaps, lambda g: F.coalesce((g.g > gap) & (g.side >= minority * n), F.lit(False)))

    def middle(off: Column) -> Column:
        n = F.size(off)
        return (F.get(off, F.floor((n - 1) / 2).cast("int")) + F.get(off, F.floor(n / 2).cast("int"))) / 2.0

    def whole(pairs: Column) -> Column:
        median = let(F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p.w), lambda total: median_of(pairs, total))
        spread = lambda m: let(F.array_sort(F.transform(pairs, lambda p: F.abs(p.v - m))), middle)
        return let(median, lambda m: F.struct(m.alias("median"), (1.4826 * spread(m)).alias("spread"), gaps_of(pairs).alias("discontinuous")))

    return let(pairs, lambda p: F.when(F.size(p) > 0, whole(p)))
