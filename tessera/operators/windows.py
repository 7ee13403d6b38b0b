"""Ordered operators as window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import discard, materialise


def cumulative_position(rows: DataFrame, group: str, order: str, pose: str, shift: str) -> DataFrame:
    """rows with position and forced: the pose where every row of the group has one, else
    the running sum of shifts, of which an unmeasurable one forces a keep and adds nothing."""
    whole = Window.partitionBy(group)
    running = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_pose = F.bool_and(F.col(pose).isNotNull()).over(whole)
    first = F.row_number().over(whole.orderBy(order)) == 1
    summed = F.sum(F.when(first, F.lit(0.0)).otherwise(F.coalesce(F.col(shift).cast("double"), F.lit(0.0)))).over(running)
    return rows.select("*", F.when(all_pose, F.col(pose).cast("double")).otherwise(summed).alias("position"), (~all_pose & ~first & F.col(shift).isNull()).alias("forced"))


def ranged(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """rows sorted by ranges and written to the shared folder, so that places stay however
    often they are read: with _place_range and, growing inside each range, _place_row. What
    lies before is written first, as finding the ranges reads it once more."""
    given = materialise(rows, "unordered")
    sorted_ = given.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place_row", F.monotonically_increasing_id())
    out = materialise(sorted_, "ordered")
    discard(given)
    return out.withColumn("_place_range", F.shiftright("_place_row", 33))


def before_range(keys: Sequence[str]):
    """Of a table with a row a range (and key): all rows of earlier ranges."""
    return Window.partitionBy(*keys).orderBy("_place_range").rowsBetween(Window.unboundedPreceding, -1)


def average_precision(dets: DataFrame, truths: DataFrame, keys: Sequence[str], score: str, hit: str, tie: Sequence[str]) -> DataFrame:
    """101-point interpolated average precision per keys. dets: one row a detection with its
    score and whether it is a true positive; truths: keys and n_gt. Null where there is no
    truth, 0 where there is no detection. Equal scores are ordered by ``tie``. A class's
    detections are counted range by range, so one class may hold most rows."""
    keys = list(keys)
    found = dets.join(truths, keys).filter("n_gt > 0").select(*keys, "n_gt", score, *tie, F.col(hit).cast("long").alias("_hit"))
    parts = ranged(found, [*keys, F.desc(score), *tie])
    sums = parts.groupBy("_place_range", *keys).agg(F.sum("_hit").alias("_t"), F.count("*").alias("_s"))
    earlier = [F.coalesce(F.sum(c).over(before_range(keys)), F.lit(0)).alias(f"{c}_before") for c in ("_t", "_s")]
    inside = Window.partitionBy("_place_range", *keys).orderBy("_place_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = parts.withColumn("_t", F.sum("_hit").over(inside)).withColumn("_s", F.count(F.lit(1)).over(inside))
    counted = counted.join(sums.select("_place_range", *keys, *earlier), ["_place_range", *keys])
    tp, seen = F.col("_t") + F.col("_t_before"), F.col("_s") + F.col("_s_before")
    counted = counted.select(*keys, (tp / F.col("n_gt")).alias("recall"), (tp / seen).alias("precision"))
    # recall grows with rank: a grid point takes the largest precision of all that reach it
    k = F.floor(F.col("recall") * 100).cast("int")
    reached = F.when(F.col("recall") >= (k + 1) * F.lit(0.01), k + 1).when(F.col("recall") >= k * F.lit(0.01), k).otherwise(k - 1)
    grid = counted.groupBy(*keys, F.least(reached, F.lit(100)).alias("_k")).agg(F.max("precision").alias("precision"))
    points = grid.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_k")))).groupBy(*keys, "_q").agg(F.max("precision").alias("p"))
    area = points.groupBy(*keys).agg((F.sum("p") / 101.0).alias("ap"))
    return truths.join(area, keys, "left").select(*keys, "n_gt", F.when(F.col("n_gt") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str, by: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """rows with ``name``: their place in the order, from 1, ties in any order, among all or
    among rows of equal ``by`` (null is a value too), and with ``total``, how many these are.
    No task sees a whole group: each range counts on from those before it, and the sizes are
    one row a range and group that meet."""
    by = list(by)
    parts = ranged(rows, [*by, *order])
    sizes = parts.groupBy("_place_range", *by).agg(F.min("_place_row").alias("_place_first"), F.count("*").alias("_place_n"))
    offsets = sizes.withColumn("_place_before", F.coalesce(F.sum("_place_n").over(before_range(by)), F.lit(0))).withColumn("_place_total", F.sum("_place_n").over(Window.partitionBy(*by)))
    offsets = offsets.drop("_place_n").withColumnsRenamed({k: f"_place_{k}" for k in by}).withColumnRenamed("_place_range", "_place_of")
    same = [parts._place_range == offsets._place_of, *(parts[k].eqNullSafe(offsets[f"_place_{k}"]) for k in by)]
    out = parts.join(offsets if by else F.broadcast(offsets), same)
    out = out.withColumn(name, F.col("_place_row") - F.col("_place_first") + F.col("_place_before") + 1)
    if total:
        out = out.withColumn(total, F.col("_place_total"))
    return out.drop("_place_range", "_place_row", "_place_of", "_place_first", "_place_before", "_place_total", *(f"_place_{k}" for k in by))


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], kind: str = "linear", name: str = "q") -> DataFrame:
    """keys and ``name``, an array of the exact quantiles of a group's non-null values: at
    place share * (n - 1), interpolated (linear) or cut to a whole place (floor), or at
    min(n - 1, int(share * n)) (rank). Groups without a value have no row. Equal values are
    counted first; then ranges of values, and only those that hold a wanted place."""
    keys = list(keys)
    counted = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    parts = ranged(counted, [*keys, "_v"])
    sizes = parts.groupBy("_place_range", *keys).agg(F.sum("_c").alias("_in"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_in").over(before_range(keys)), F.lit(0))).withColumn("_n", F.sum("_in").over(Window.partitionBy(*keys)))
    at = [F.least(F.col("_n") - 1, F.floor(F.lit(float(s)) * F.col("_n"))).cast("double") if kind == "rank" else F.lit(float(s)) * (F.col("_n") - 1) for s in shares]
    low = [F.floor(x) for x in at]
    places = [x for i in range(len(shares)) for x in (low[i], F.ceil(at[i]) if kind == "linear" else low[i])]
    # only ranges that hold a wanted place are looked into
    sizes = sizes.filter(F.exists(F.array(*places), lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_in"))))
    sizes = sizes.withColumnsRenamed({k: f"_place_{k}" for k in keys}).withColumnRenamed("_place_range", "_place_of")
    same = [parts._place_range == sizes._place_of, *(parts[k].eqNullSafe(sizes[f"_place_{k}"]) for k in keys)]
    inside = Window.partitionBy("_place_range", *keys).orderBy("_place_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = parts.join(sizes, same).withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    ends = [F.max(F.when((k < F.col("_upto")) & (k >= F.col("_upto") - F.col("_c")), F.col("_v"))).alias(f"_e{i}") for i, k in enumerate(places)]
    found = wanted.groupBy(*keys).agg(F.first("_n").alias("_n"), *ends)
    between = lambda i: F.col(f"_e{2 * i}") + (F.col(f"_e{2 * i + 1}") - F.col(f"_e{2 * i}")) * (at[i] - low[i])
    values = [between(i) if kind == "linear" else F.col(f"_e{2 * i}") for i in range(len(shares))]
    return found.select(*keys, F.array(*values).alias(name))


def with_quantiles(base: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], kind: str = "linear") -> DataFrame:
    """base (a row a group, or one row) with a column for each share."""
    q = quantiles(rows, keys, value, list(shares.values()), kind, "_q")
    out = base.join(q, list(keys), "left") if keys else base.crossJoin(F.broadcast(q.groupBy().agg(F.first("_q").alias("_q"))))
    return out.withColumns({n: F.get("_q", F.lit(i)) for i, n in enumerate(shares)}).drop("_q")


def interleave(groups: DataFrame, stratum: str, key: str, size: str, rank: Column) -> DataFrame:
    """groups with ``place``: the first of each stratum by rank, then the second of each;
    strata by falling size, then name."""
    total = F.sum(size).over(Window.partitionBy(stratum))
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(rank, key))
    out = groups.withColumn("_total", total).withColumn("_turn", turn)
    return numbered(out, ["_turn", F.desc("_total"), stratum, key], "place").drop("_total", "_turn")


def capped_top(rows: DataFrame, group: str, order: Sequence[Column], cap: int, top: int | None = None) -> DataFrame:
    """At most ``cap`` rows of a group, in the order, then at most ``top`` in all."""
    out = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")
    return out if top is None else out.orderBy(*order).limit(top)


def class_share_cap(rows: DataFrame, label: str, order: str, share: float = 0.6) -> DataFrame:
    """Of a selection in its order, at most a share of it of one class."""
    n = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("_cap"))
    return numbered(rows, [order], "_n", by=[label]).crossJoin(F.broadcast(n)).filter("_n <= _cap").drop("_n", "_cap")


def every_nth(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first and each n-th row after it of every group."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return rows.withColumn("_n", at).filter(F.col("_n") % n == 0).drop("_n")


def sample_evenly(rows: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """Every len//limit-th row of a group, the first ``limit`` of these."""
    w = Window.partitionBy(group)
    at = F.row_number().over(w.orderBy(order)) - 1
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / limit))
    return rows.withColumn("_n", at).withColumn("_s", step).filter((F.col("_n") % F.col("_s") == 0) & (F.col("_n") < F.col("_s") * limit)).drop("_n", "_s")


def early_stopping(history: DataFrame, run: str, epoch: str, metric: str, patience: int) -> DataFrame:
    """history with best so far, is_best (a strict improvement), stale (evaluated epochs
    since) and stopped (from the epoch on at which stale reaches patience)."""
    seen = Window.partitionBy(run).orderBy(epoch)
    before = seen.rowsBetween(Window.unboundedPreceding, -1)
    upto = seen.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = history.filter(F.col(metric).isNotNull()).withColumn("is_best", F.col(metric) > F.coalesce(F.max(metric).over(before), F.lit(float("-inf"))))
    out = out.withColumn("best", F.max(metric).over(upto)).withColumn("_island", F.sum(F.col("is_best").cast("int")).over(upto))
    out = out.withColumn("stale", F.row_number().over(Window.partitionBy(run, "_island").orderBy(epoch)) - 1)
    return out.withColumn("stopped", F.max((F.col("stale") >= patience).cast("int")).over(upto) == 1).drop("_island")


def within_session_blocks(frames: DataFrame, session: str, order: str, val: float, test: float, gap: int = 0, least: int = 5) -> DataFrame:
    """frames with ``split``: contiguous blocks train, val, test of each session, sizes
    rounded half to even; ``gap`` frames at each seam belong to none; sessions of fewer
    than ``least`` frames are train."""
    w = Window.partitionBy(session)
    i, n = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
    n_val, n_test = F.bround(n * val, 0).cast("int"), F.bround(n * test, 0).cast("int")
    first_val = n - n_val - n_test
    first_test = n - n_test
    split = F.when(n < least, "train").when(i < first_val - F.when(n_val + n_test > 0, gap).otherwise(0), "train").when((i >= first_val) & (i < first_test - F.when((n_test > 0) & (n_val > 0), gap).otherwise(0)), "val").when(i >= first_test, "test")
    return frames.withColumn("split", split)


def history_by_epoch(rows: DataFrame, epoch: str, order: str, metrics: Sequence[str]) -> DataFrame:
    """Sparse metric rows merged per epoch; the last value that isn't blank wins."""
    pick = [F.max_by(F.col(m), F.when(F.col(m).isNotNull(), F.col(order))).alias(m) for m in metrics]
    return rows.groupBy(epoch).agg(*pick)


def capture_gaps(frames: DataFrame, session: str, index: str) -> DataFrame:
    """Where capture indices jump: the frame before, and how many were dropped."""
    before = F.lag(index).over(Window.partitionBy(session).orderBy(index))
    return frames.withColumn("after", before).withColumn("n_dropped", F.col(index) - before - 1).filter("n_dropped > 0").select(session, "after", index, "n_dropped")
