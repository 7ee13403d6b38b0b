"""Active learning: frame scores, diverse selection, and the ledger of rounds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import discard, materialise

# Weights and limits of the score.
WEIGHTS = {"uncertainty": 1.0, "lep_quality": 0.8, "rarity": 1.2, "crop_risk": 0.6}
CONF_LOW, CONF_HIGH, SIGMA_FULL, CROP_RISK_PX = 0.25, 0.70, 12.0, 40.0


def frame_scores(targets: DataFrame, frequencies: DataFrame, frame: str) -> DataFrame:
    """targets: frame, class_name, confidence, sigma, abstained, crop_distance, conflict.
    The four signals, their weighted total and reasons per frame; an unseen class is rarest."""
    t = targets.join(frequencies.select("class_name", F.col("n").alias("labelled")), "class_name", "left")
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    sigma = F.coalesce(F.avg(F.least(F.lit(1.0), F.col("sigma") / SIGMA_FULL)), F.lit(0.0))
    out = t.groupBy(frame).agg(
        F.count("*").alias("n_instances"),
        F.count_if("abstained").alias("n_abstained"),
        F.round(share(F.col("confidence").between(CONF_LOW, CONF_HIGH)), 6).alias("uncertainty"),
        F.round(0.5 * sigma + 0.5 * share(F.col("abstained")), 6).alias("lep_quality"),
        F.round(F.max(1.0 / F.sqrt(1.0 + F.coalesce("labelled", F.lit(0)))), 6).alias("rarity"),
        F.round(share((F.col("crop_distance") <= CROP_RISK_PX) | F.col("conflict")), 6).alias("crop_risk"),
    )
    total = sum((w * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(F.col(k) > 0.5, k) for k in WEIGHTS]))
    return out.withColumn("total", F.round(total, 6)).withColumn("reasons", reasons)


def guidance(frequencies: DataFrame, scarce: int = 10) -> DataFrame:
    """Classes never labelled, and labelled fewer than ``scarce`` times."""
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("class_name"))))
    return frequencies.agg(F.array_join(pick(F.col("n") == 0), ",").alias("missing"), F.array_join(pick((F.col("n") > 0) & (F.col("n") < scarce)), ",").alias("scarce"))


def farthest_point(rows: DataFrame, group: str, key: str, vector: str, score: str, k: int) -> DataFrame:
    """Greedy diverse selection per group: start at the highest score (the first key if all
    are zero), then by half the distance to the picked, normalised, and half the score,
    normalised; of equal merits the first key wins. Adds ``place``. Each row's distance to
    the nearest pick is carried in a table that a pick renews once, so a pick costs one
    distance a row and two grouped aggregates."""
    top = rows.groupBy(group).agg(F.max(score).alias("_top"))
    share = F.when(F.col("_top") > 0, F.col("_s") / F.col("_top")).otherwise(0.0)
    base = rows.select(group, key, F.col(vector).cast("array<double>").alias("_v"), F.col(score).cast("double").alias("_s")).join(top, group)
    left = materialise(base.select(group, key, "_v", share.alias("_s"), F.lit(None).cast("double").alias("_near")), "left")

    def best(merit: Column, candidates: DataFrame, place: int) -> DataFrame:
        first = F.min_by(F.struct(key, "_v"), F.struct(-merit, F.col(key))).alias("_p")
        return materialise(candidates.groupBy(group).agg(first).select(group, F.col(f"_p.{key}").alias(key), F.col("_p._v").alias("_w"), F.lit(place).alias("place")), "picks")

    picks = [best(F.col("_s"), left, 1)]
    apart = F.sqrt(F.aggregate(F.zip_with("_v", "_w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    for place in range(2, k + 1):
        last = picks[-1].select(group, F.col(key).alias("_picked"), "_w")
        near = left.join(last, group).filter(F.col(key) != F.col("_picked")).select(group, key, "_v", "_s", F.least("_near", apart).alias("_near"))
        before, left = left, materialise(near, "left")
        discard(before)
        widest = left.groupBy(group).agg(F.max("_near").alias("_far"))
        merit = 0.5 * F.when(F.col("_far") > 0, F.col("_near") / F.col("_far")).otherwise(F.col("_near")) + 0.5 * F.col("_s")
        picks.append(best(merit, left.join(widest, group), place))
    discard(left)
    return reduce(DataFrame.unionByName, picks).drop("_w")


def next_batch(scored: DataFrame, descriptors: DataFrame | None, key: str, score: str, vector: str, k: int) -> DataFrame:
    """The next k items to label, with ``place`` and ``how``: spread by their descriptors where
    at least two of them have one (those without are left out), else the highest scores, of
    equal ones the first key."""
    have = None if descriptors is None else scored.join(descriptors.filter(F.col(vector).isNotNull()).select(key, vector), key)
    if have is not None and len(have.limit(2).collect()) == 2:
        return farthest_point(have.withColumn("_all", F.lit(0)), "_all", key, vector, score, k).select(key, "place", F.lit("diverse").alias("how"))
    top = scored.orderBy(F.desc(score), key).limit(k)
    place = F.row_number().over(Window.orderBy(F.desc(score), key))  # of at most k rows
    return top.select(key, place.alias("place"), F.lit("top").alias("how"))


def cold_start(descriptors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The first k items to label, by their descriptors alone."""
    rows = descriptors.filter(F.col(vector).isNotNull()).select(key, vector, F.lit(0.0).alias("_zero"), F.lit(0).alias("_all"))
    return farthest_point(rows, "_all", key, vector, "_zero", k).select(key, "place")


def hash_diverse(rows: DataFrame, group: str, key: str, code: str, order: Sequence[Column], n: int, distance: int) -> DataFrame:
    """At most n keys per group that differ from all picked by at least ``distance`` bits,
    then by half of it (at least 2), then any; codes are 64-bit integers. Adds ``place``."""
    item = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(key).alias("k"), F.col(code).alias("c"))
    grouped = rows.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    candidates = F.transform("rows", lambda r: F.struct(r.k.alias("k"), r.c.alias("c")))
    picked = F.filter(candidates, lambda r: F.lit(False))

    def step(least: int):
        def add(acc, r):
            known = F.exists(acc, lambda a: a.k == r.k)
            close = F.exists(acc, lambda a: F.bit_count(a.c.bitwiseXOR(r.c)) < least)
            return F.when((F.size(acc) >= n) | known | close, acc).otherwise(F.concat(acc, F.array(r)))

        return add

    for least in (distance, max(2, distance // 2), 0):
        grouped = grouped.withColumn("_c", candidates).withColumn("_p", F.aggregate("_c", picked, step(least)))
        picked = F.col("_p")
    return grouped.select(group, F.posexplode("_p").alias("place", "p")).select(group, F.col("p.k").alias(key), (F.col("place") + 1).alias("place"))


def next_round(rounds: DataFrame) -> DataFrame:
    return rounds.agg((F.coalesce(F.max("round"), F.lit(0)) + 1).alias("next_round"))


def record_export(rounds: DataFrame, items: DataFrame, item: str, **fields) -> DataFrame:
    """The ledger with one more exported round, numbered after the last; items: its frames.
    fields: other columns of the round; those that the ledger has and aren't given are null."""
    ids = items.agg(F.count(item).alias("n_frames"), F.array_sort(F.collect_list(F.col(item).cast(rounds.schema["item_ids"].dataType.elementType))).alias("item_ids"))
    new = ids.crossJoin(F.broadcast(next_round(rounds))).withColumnRenamed("next_round", "round").withColumn("state", F.lit("exported"))
    new = new.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()})
    cells = [(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in rounds.schema.fields]
    return rounds.unionByName(new.select(*cells))


def attach_metrics(rounds: DataFrame, number: int, before: dict | None = None, after: dict | None = None) -> DataFrame:
    """The ledger with the metrics of one round set; those not given stay."""
    out = rounds
    for name, values in (("metrics_before", before), ("metrics_after", after)):
        if values is not None:
            cells = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]).cast(rounds.schema[name].dataType)
            out = out.withColumn(name, F.when(F.col("round") == number, cells).otherwise(F.col(name)))
    return out


def in_flight(rounds: DataFrame, item: str = "item_ids") -> DataFrame:
    """Ids of rounds that are exported and not yet merged."""
    return rounds.filter(F.col("state") == "exported").select(F.explode(item).alias("item_id")).distinct()


def latest_exported(rounds: DataFrame) -> DataFrame:
    return rounds.filter(F.col("state") == "exported").agg(F.max("round").alias("round"))


def transition(rounds: DataFrame, number: int, to: str) -> DataFrame:
    """The ledger with a round's state changed; only exported rounds change."""
    if to not in ("merged", "abandoned"):
        raise ValueError(f"no such state: {to}")
    hit = (F.col("round") == number) & (F.col("state") == "exported")
    return rounds.withColumn("state", F.when(hit, to).otherwise(F.col("state")))


def round_history(rounds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Each round's change of each metric, rounded to four places; null if either lacks it."""
    delta = lambda m: F.round(F.try_element_at("metrics_after", F.lit(m)) - F.try_element_at("metrics_before", F.lit(m)), 4)
    return rounds.select("round", "state", "n_frames", *[delta(m).alias(f"d_{m}") for m in metrics])


def unlabelled(pool: DataFrame, labelled: DataFrame, flying: DataFrame, holdout: DataFrame, key: str, session: str) -> DataFrame:
    """The pool without labelled frames, frames in flight and held-out sessions."""
    return pool.join(labelled, key, "left_anti").join(flying, key, "left_anti").join(holdout, session, "left_anti")


def contact_rank(rows: DataFrame, session: str, contact: str, name: str, cap: int, top: int) -> DataFrame:
    """Most contact first, none without contact, at most ``cap`` a session and ``top`` in all."""
    w = Window.partitionBy(session).orderBy(F.desc(contact), name)
    out = rows.filter(F.col(contact) > 0).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    return out.orderBy(F.desc(contact), name).limit(top).drop("_n")
