"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash of its id and text. A source that shall give ``rest``
words takes the documents whose hash lies below a threshold. The threshold is found
without sorting: words are summed by source and hash bucket (12 bits), the bucket in
which the running sum passes the budget is the boundary, and only that bucket's documents
are split by their next 12 bits, until it holds one hash. Budgets are nested: a higher
budget takes a superset, and whole repeats of a source come before its part.

Defined cases: null text has size 0; a null source is a source of its own, ordered last;
null ids hash as the empty string; repeated rows share a hash and are taken or left
together; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, maybe_broadcast

BITS, STEP = 60, 12
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    joined = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size -> with target: weights repeat over the sources in code point
    order (null last) and share all words; no target is above ``most`` times its source,
    what is above goes to the others by weight. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    out = sizes.withColumn("w", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    by_need = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    out = out.withColumn("level", level)
    # the first source, by need, that its share doesn't fill sets the level for it and all after it
    free = F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level"))
    out = out.withColumn("level", F.first(free, ignorenulls=True).over(by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return out.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def find_thresholds(rows: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """rows: source, h, size. budgets: source, rest (below the source's sum). Returns
    source, bound, low, rest: hashes below ``bound`` sum to ``low``, at most ``rest``, and
    with ``bound`` they pass it."""
    state = budgets.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("low"))
    found = None
    for shift in range(BITS - STEP, -1, -STEP):
        here = rows.alias("r").join(maybe_broadcast(state, n_sources).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.shiftright("h", shift + STEP) == F.col("prefix")))
        sums = here.groupBy("r.source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("first"), F.max("h").alias("last"), F.first("rest").alias("rest"), F.first("low").alias("low"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        past = sums.withColumn("run", F.col("low") + run).filter("run > rest").groupBy("source").agg(F.min_by(F.struct("bucket", "run", "words", "first", "last", "rest"), "bucket").alias("b")).select("source", "b.*")
        step = materialise(past.select("source", "rest", F.col("bucket").alias("prefix"), (F.col("run") - F.col("words")).alias("low"), "first", "last"), "mix-step")
        done = step.filter("first = last").select("source", "rest", F.col("first").alias("bound"), "low")
        found = done if found is None else found.unionByName(done)
        state = step.filter("first < last").select("source", "rest", "prefix", "low")
        if state.isEmpty():
            break
    return found


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of docs."""
    rows = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialise(plan, "mix-plan")
    n_sources = plan.count()
    bounds = find_thresholds(rows, plan.filter("source_size > 0").select("source", "rest"), n_sources)
    # What is left of the budget goes to one more document: the one whose size comes nearest, if it gets nearer.
    gap = F.col("rest") - F.col("low")
    more = rows.alias("r").join(maybe_broadcast(bounds, n_sources).alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("h") >= F.col("bound")))
    pick = more.groupBy("r.source").agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("off"), "h")).alias("p"), F.first("bound").alias("bound"), F.first(gap).alias("gap")).select("source", "bound", "gap", F.col("p.h").alias("h"))
    pick = materialise(pick, "mix-pick")
    tied = rows.alias("r").join(maybe_broadcast(pick, n_sources).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.h") == F.col("p.h")))
    extra = tied.groupBy("p.source").agg(F.sum("size").alias("words"), F.first("bound").alias("bound"), F.first("gap").alias("gap"), F.first("r.h").alias("h")).select("source", "bound", F.when(F.abs(F.col("words") - F.col("gap")) < F.col("gap"), F.col("h")).alias("extra"))
    final = materialise(plan.alias("a").join(extra.alias("e"), F.col("a.source").eqNullSafe(F.col("e.source")), "left").select("a.*", "bound", "extra"), "mix-final")
    out = rows.alias("r").join(maybe_broadcast(final, n_sources).alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")))
    part = F.coalesce(F.col("h") < F.col("bound"), F.lit(False)) | F.coalesce(F.col("h") == F.col("extra"), F.lit(False))
    copies = F.col("whole") + part.cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), F.col("r.source").alias("source"), "h")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[:15])::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
    (source_size * 3)::DOUBLE AS cap, sum(source_size::DOUBLE) OVER () AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level FROM l WHERE cap >= level * w ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM f) * w, cap)) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
c AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS run,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS peers
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
b AS (SELECT source, min(h) AS bound, arg_min(run - peers, h) AS low FROM c WHERE run > rest GROUP BY source),
g AS (
  SELECT c.source, arg_min({'h': c.h, 'words': c.peers, 'gap': c.rest - b.low}, {'off': abs(c.size - (c.rest - b.low)), 'h': c.h}) AS x
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE c.h >= b.bound GROUP BY c.source),
e AS (SELECT source, CASE WHEN abs(x.words - x.gap) < x.gap THEN x.h END AS extra FROM g),
r AS (
  SELECT c.doc_id, c.size, c.source_size, c.target, c.whole + (coalesce(c.h < b.bound, false) OR coalesce(c.h = e.extra, false))::BIGINT AS copies
  FROM c LEFT JOIN b ON c.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON c.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM r
"""
