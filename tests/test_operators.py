"""Ordered operators, quantiles, selections and streams on small and lopsided tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import folds, metrics, windows
from tessera.plans import specs
from tessera.streaming import queries as streams


def rows_of(n=4_000, seed=3):
    rng = random.Random(seed)
    return [(rng.choice(["big"] * 8 + ["b", "c", None]), rng.choice([0.5, 1.0, 2.5, 7.0, None, rng.random()]), k) for k in range(n)] + [("one", 4.0, -1)]


def test_places_and_quantiles_of_lopsided_groups(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "g string, v double, k long").repartition(7)
    held = df.filter("v is not null")
    placed = {r.k: (r.place, r.n) for r in windows.numbered(held, ["v", "k"], "place", by=["g"], total="n").collect()}
    got = {kind: {r.g: r.q for r in windows.quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.95, 1.0], kind).collect()} for kind in ("linear", "floor", "rank")}
    for g in {r[0] for r in rows}:
        own = sorted((v, k) for x, v, k in rows if x == g and v is not None)
        assert [placed[k] for _, k in own] == [(i + 1, len(own)) for i in range(len(own))]
        values = [v for v, _ in own]
        assert np.allclose(got["linear"][g], np.quantile(values, [0, 0.1, 0.5, 0.95, 1]))
        assert got["floor"][g] == [values[int(s * (len(values) - 1))] for s in (0, 0.1, 0.5, 0.95, 1)]
        assert got["rank"][g] == [values[min(len(values) - 1, int(s * len(values)))] for s in (0, 0.1, 0.5, 0.95, 1)]
    assert windows.quantiles(df.limit(0), ["g"], "v", [0.5]).collect() == []


def test_rank_correlation_of_one_group(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3_000)
    y = x + rng.normal(size=3_000)
    df = spark.createDataFrame([("g", float(a), float(b), k) for k, (a, b) in enumerate(zip(x, y, strict=True))], "g string, x double, y double, k long")
    rank = lambda a: np.argsort(np.argsort(a))
    assert abs(metrics.rank_correlations(df, ["g"], "x", ["y"], "k").first().rho_y - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-5


def test_thinning_equals_the_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), k, rng.random() * 10, rng.random() < 0.05, rng.random() < 0.8) for k in range(3_000)]
    df = spark.createDataFrame(rows, "g string, k long, p double, f boolean, live boolean").repartition(5)
    got = {r.k: r.kept for r in folds.keep_by_travel(df, "g", "k", "p", 2.5, forced="f", live=F.col("live")).collect()}
    for g in "ab":
        anchor = None
        for _, k, p, f, live in sorted(r for r in rows if r[0] == g):
            if not live:
                assert got[k] is None
                continue
            stays = anchor is None or f or abs(p - anchor) >= 2.5
            assert got[k] == stays
            anchor = p if stays else anchor


def test_depth_of_a_large_patch_is_linear(spark):
    values = [float(k % 37) for k in range(2_000)]
    df = spark.createDataFrame([(values,)], "v array<double>")
    d = df.select(folds.largest_gap(F.col("v"), F.transform("v", lambda x: F.lit(1.0)), 25.0, 0.15).alias("d")).first().d
    assert d.median == 18.0 and not d.discontinuous


def test_selections(spark):
    df = spark.createDataFrame([(s, f"{s}_{k}") for s in ("s1", "s2") for k in range(10, 40)], "session string, item string")
    pick = lambda inc, exc=(): sorted(r.item for r in specs.select_positions(df, inc, exc, "session", "item").collect())
    assert pick(["s1:1-2", "s2:5", "s2_3[0-1]"]) == ["s1_10", "s1_11", "s2_14", "s2_30", "s2_31"]
    assert pick(["s1:*"], ["s1:3-30"]) == ["s1_10", "s1_11"] and len(pick([], ["s1:*"])) == 30
    for bad in (["s3:1"], ["4"], ["s1:31"], ["s1:0"]):
        with pytest.raises(specs.SpecError):
            pick(bad)


def test_streams_over_several_files_and_late_rows(spark, tmp_path):
    """A file a trigger: state goes on from file to file, and from one run to the next."""
    put = lambda name, rows: spark.createDataFrame(rows, "g long, i long, p double").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    put("a", [(1, 1, 0.0), (1, 2, 5.0), (2, 1, 0.0)])
    put("b", [(1, 5, 30.0), (1, 6, 31.0), (2, 3, 50.0)])
    read = lambda: streams.read_events(spark, f"{tmp_path}/in/*", "g long, i long, p double")
    gaps = lambda: sorted((r.g, r.after, r.i, r.n_dropped) for r in streams.run_to_table(streams.gap_stream(read(), "g", "i"), f"{tmp_path}/gaps").collect())
    kept = lambda: sorted((r.g, r.i) for r in streams.run_to_table(streams.thin_stream(read(), "g", "i", "p", 20.0), f"{tmp_path}/thin").collect())
    assert gaps() == [(1, 2, 5, 2), (2, 1, 3, 1)] and kept() == [(1, 1), (1, 5), (2, 1), (2, 3)]
    put("c", [(1, 3, 29.0), (1, 7, 55.0), (2, 4, 51.0)])  # 3 comes late: nothing moves back
    assert gaps() == [(1, 2, 5, 2), (2, 1, 3, 1)] and kept() == [(1, 1), (1, 5), (1, 7), (2, 1), (2, 3)]
