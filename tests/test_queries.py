"""Every core query against its SQL, and against a brute-force version where SQL has none."""

import numpy as np
import pytest

import __spark_entry__ as contract
from oracle import database, differences
from tessera.plans import curation, instances, pool, rounds

QUERIES = pool.Q | instances.Q | rounds.Q | curation.Q
SQL = pool.SQL | instances.SQL | rounds.SQL | curation.SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == ""


def test_contract_lists_all(spark):
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


def test_split_plan(spark, sf_dir):
    plan = QUERIES["split_plan"](spark, sf_dir).toPandas()
    assert plan.session_id.is_unique
    assert set(plan.split) == {"train", "val", "test"}
    assert plan.groupby("group_id").split.nunique().max() == 1


def test_shuffled_pool_is_stable(spark, sf_dir):
    a, b = (QUERIES["shuffled_pool"](spark, sf_dir).toPandas() for _ in range(2))
    assert a.equals(b) and a["rank"].is_monotonic_increasing and a["rank"].between(0, 1).all()


def test_diverse_batch(spark, sf_dir):
    got = {(r.label, r.place): r.vec_id for r in QUERIES["diverse_batch"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    want = {}
    for label, part in rows.groupby("label"):
        ids, x = part.vec_id.to_numpy(), np.stack(part.embedding).astype(float)
        s = ids % 10 / max(1, (ids % 10).max())
        picked = [int(s.argmax())]
        while len(picked) < min(8, len(ids)):
            near = np.min([np.sqrt(((x - x[p]) ** 2).sum(1)) for p in picked], axis=0)
            merit = 0.5 * near / near[[i for i in range(len(ids)) if i not in picked]].max() + 0.5 * s
            merit[picked] = -1
            picked.append(int(merit.argmax()))
        want |= {(label, k + 1): int(ids[p]) for k, p in enumerate(picked)}
    assert got == want


def greedy(x, s, k):
    s = s / s.max() if s.max() > 0 else s
    picked = [int(s.argmax())]
    while len(picked) < min(k, len(s)):
        near = np.min([np.sqrt(((x - x[p]) ** 2).sum(1)) for p in picked], axis=0)
        merit = 0.5 * near / near[[i for i in range(len(s)) if i not in picked]].max() + 0.5 * s
        merit[picked] = -1
        picked.append(int(merit.argmax()))
    return picked


def test_batches_to_label(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    some = rows[rows.vec_id % 11 != 0]
    got = {r.place: (r.vec_id, r.how) for r in QUERIES["next_batch"](spark, sf_dir).collect()}
    want = greedy(np.stack(some.embedding).astype(float), (some.vec_id % 10).to_numpy(float), 6)
    assert [got[k + 1] for k in range(6)] == [(int(some.vec_id.iloc[i]), "diverse") for i in want]
    cold = {r.place: r.vec_id for r in QUERIES["cold_start"](spark, sf_dir).collect()}
    want = greedy(np.stack(rows.embedding).astype(float), np.zeros(len(rows)), 5)
    assert [cold[k + 1] for k in range(5)] == [int(rows.vec_id.iloc[i]) for i in want]


def test_pictures_are_measured(spark, sf_dir):
    rows = QUERIES["measured_pictures"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert all(r.error is None and (r.height, r.width) == (8, 8) and len(r.phash) == 16 for r in rows)


def test_drawn_growth_points(spark, sf_dir):
    for r in QUERIES["drawn_growth_points"](spark, sf_dir).collect():
        assert abs(r.u - (8 + r.plant % 8)) < 2 and abs(r.v - (8 + r.plant // 8 % 8)) < 2


def test_hash_diverse_batch(spark, sf_dir):
    from pyspark.sql import functions as F

    got = {}
    for r in QUERIES["hash_diverse_batch"](spark, sf_dir).collect():
        got.setdefault(r.session_id, {})[r.place] = r.idx
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value", F.xxhash64(F.floor(F.col("value") / 5)).alias("code")).toPandas()
    for user, part in e.groupby("user_id"):
        rows = part.sort_values(["value", "event_id"], ascending=[False, True])[["event_id", "code"]].to_numpy().tolist()
        picked = []
        for least in (24, 12, 0):
            for k, c in rows:
                if len(picked) < 5 and k not in [p for p, _ in picked] and all(((c ^ q) & (2**64 - 1)).bit_count() >= least for _, q in picked):
                    picked.append((k, c))
        assert [got[user][i + 1] for i in range(len(picked))] == [k for k, _ in picked]


def test_run_length_overlap(spark, sf_dir):
    from tessera.operators.kernels import mask_iou, rle_decode

    rows = QUERIES["run_length_overlap"](spark, sf_dir).limit(5).collect()
    assert all(0 <= r.iou <= 1 and r.area > 0 for r in rows)
    a, b = rle_decode([3, 5, 192], 20, 10), rle_decode([5, 5, 190], 20, 10)
    assert mask_iou(a, b) == pytest.approx(3 / 7)


def test_heat_map_hashes(spark, sf_dir):
    rows = QUERIES["heat_map_hashes"](spark, sf_dir).collect()
    assert len({r.vec_id for r in rows}) == len(rows) and all(len(r.phash) == 16 for r in rows)
