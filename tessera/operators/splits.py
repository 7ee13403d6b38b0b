"""Train, validation and test plans by whole groups of sessions.

Sizes are aggregated by Spark; the quota walk is sequential and works on one row a group
(date, field, camera), a dimension bounded by the number of recordings, on the driver. The
plan goes back as a small table that is joined to the frames.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_GROUPS = 100_000


class SplitError(ValueError):
    pass


def stable_rank(key: str, seed: int) -> float:
    return zlib.crc32(f"{seed}:{key}".encode()) / 0xFFFFFFFF


def interleaved(groups: dict[str, dict], seed: int) -> list[str]:
    """Groups in turns over their strata, large strata first, each stratum by stable rank."""
    strata: dict[str, list[str]] = defaultdict(list)
    for g, info in groups.items():
        strata[info["scene"]].append(g)
    for names in strata.values():
        names.sort(key=lambda g: (stable_rank(min(groups[g]["sessions"]), seed), g))
    size = {s: sum(len(groups[g]["sessions"]) for g in names) for s, names in strata.items()}
    order = sorted(strata, key=lambda s: (-size[s], s))
    longest = max(map(len, strata.values()), default=0)
    return [strata[s][k] for k in range(longest) for s in order if k < len(strata[s])]


def quota_walk(order: list[str], sizes: dict[str, float], firsts: dict[str, str], val: float, test: float) -> dict[str, str]:
    """Test, then val, take the next group that fits their room (the smallest, if none fits
    and they are empty); the rest is train, which gets the largest group if it has none."""
    total, left, out = sum(sizes[g] for g in order), list(order), {}
    for split, share in (("test", test), ("val", val)):
        want, taken = share * total, 0.0
        while left and want - taken > 0:
            fit = next((g for g in left if sizes[g] <= want - taken), None)
            if fit is None:
                if taken:
                    break
                fit = min(left, key=lambda g: (sizes[g], firsts[g]))
            out[fit] = split
            taken += sizes[fit]
            left.remove(fit)
    out |= dict.fromkeys(left, "train")
    if order and not left:
        out[max(order, key=lambda g: (sizes[g], firsts[g]))] = "train"
    return out


def plan_splits(sessions: DataFrame, val: float = 0.15, test: float = 0.15, seed: int = 1337, holdout_val: tuple = (), holdout_test: tuple = ()) -> DataFrame:
    """sessions: session_id, group_id, scene, n_frames. Returns session_id, split. Held-out
    sessions go where they are told with their whole group; if a split stays empty, single
    sessions are dealt instead of groups."""
    if not (0 <= val < 1 and 0 <= test < 1 and val + test < 1):
        raise SplitError("fractions must be in [0, 1) and leave something for train")
    if both := set(holdout_val) & set(holdout_test):
        raise SplitError(f"held out twice: {sorted(both)}")
    rows = sessions.groupBy("session_id").agg(F.min("group_id").alias("group_id"), F.min("scene").alias("scene"), F.sum("n_frames").alias("n")).limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise SplitError(f"more than {MOST_GROUPS} sessions: plan by parts")
    if not rows:
        raise SplitError("no sessions")
    if unknown := (set(holdout_val) | set(holdout_test)) - {r.session_id for r in rows}:
        raise SplitError(f"unknown held-out sessions: {sorted(unknown)}")
    fixed = dict.fromkeys(holdout_val, "val") | dict.fromkeys(holdout_test, "test")

    def attempt(unit):
        groups: dict[str, dict] = {}
        for r in rows:
            g = groups.setdefault(unit(r), {"sessions": [], "scenes": Counter(), "n": 0})
            g["sessions"].append(r.session_id)
            g["scenes"][r.scene or "unknown"] += 1
            g["n"] += r.n or 0
        plan = {}
        for g, info in groups.items():
            told = {fixed[s] for s in info["sessions"] if s in fixed}
            if len(told) > 1:
                raise SplitError(f"one group is held out for both splits: {g}")
            if told:
                plan |= dict.fromkeys(info["sessions"], told.pop())
            known = set(info["scenes"]) - {"unknown"}
            info["scene"] = "mixed" if len(known) > 1 else next(iter(known), "unknown")
        free = {g: i for g, i in groups.items() if not set(i["sessions"]) & set(plan)}
        sizes = {g: float(i["n"] or len(i["sessions"])) for g, i in free.items()}
        need = lambda s, share: 0.0 if s in plan.values() else share
        walked = quota_walk(interleaved(free, seed), sizes, {g: min(i["sessions"]) for g, i in free.items()}, need("val", val), need("test", test))
        return plan | {s: split for g, split in walked.items() for s in free[g]["sessions"]}

    plan = attempt(lambda r: r.group_id)
    wanted = {"train"} | ({"val"} if val or holdout_val else set()) | ({"test"} if test or holdout_test else set())
    if wanted - set(plan.values()):
        plan = attempt(lambda r: r.session_id)
    return sessions.sparkSession.createDataFrame(sorted(plan.items()), "session_id string, split string")


def assign(frames: DataFrame, plan: DataFrame, session: str) -> DataFrame:
    """frames with the split of their session; without one, ``unassigned``."""
    own = plan.withColumnRenamed("session_id", session)
    return frames.join(own, session, "left").withColumn("split", F.coalesce("split", F.lit("unassigned")))


def leaks(frames: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that are in more than one split."""
    return frames.groupBy(key).agg(F.count_distinct(split).alias("n_splits"), F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits")).filter("n_splits > 1")


def assert_no_leaks(frames: DataFrame, key: str, split: str) -> None:
    bad = leaks(frames, key, split).limit(5).collect()
    if bad:
        raise SplitError(f"in several splits: {[(r[key], r.splits) for r in bad]}")
