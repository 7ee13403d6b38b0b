import numpy as np
import pytest

from tessera.llm import linededup
from tessera.llm.cuckoo import Cuckoo, built
from tessera.llm.linededup import LineStore, dedup_lines

SCHEMA = "doc_id long, text string, n_lines string"
LONG = "a line that is long enough "


def rows(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in df.collect())


def brute(docs):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(lower)
    held = {}
    for i, t, _ in docs:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(-(2**63) if i is None else i)
    out = []
    for i, t, _ in docs:
        lines = (t or "").split("\n")
        own = -(2**63) if i is None else i
        stay = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and own != max(held[key(x)]))]
        out.append((i is not None, i or 0, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out)


DOCS = [
    (1, f"{LONG}A\nunique one\n  {LONG}a \n", "x"),
    (2, f"{LONG}a\nÄÖ", None),
    (3, f"\t{LONG.upper()}A\nshort", "y"),
    (3, f"{LONG}b", "z"),
    (None, f"{LONG}a\n{LONG}b", "z"),
    (4, None, "n"),
    (5, "", "n"),
    (6, "é" * 19 + "\n" + "é" * 20, ""),
    (7, "é" * 19 + "\n" + "é" * 20, ""),
    (8, "é" * 19 + "\n" + "é" * 20, ""),
    (9, "x" * 300_000 + f"\n{LONG}b", ""),
    (9, "x" * 300_000 + f"\n{LONG}b", ""),
]


def test_equals_brute_force(spark):
    assert rows(dedup_lines(spark.createDataFrame(DOCS, SCHEMA))) == brute(DOCS)


@pytest.mark.parametrize(("filters", "keys"), [(1, 1 << 20), (1 << 20, 1)])
def test_other_ways_equal_brute_force(spark, monkeypatch, filters, keys):
    """A filter a shard, one after another, and exact keys by a join."""
    probed = []
    monkeypatch.setattr(linededup, "FILTER_BYTES", filters)
    monkeypatch.setattr(linededup, "KEY_BYTES", keys)
    probe = LineStore.probe
    monkeypatch.setattr(LineStore, "probe", lambda self, shards: probed.append(shards) or probe(self, shards))
    assert rows(dedup_lines(spark.createDataFrame(DOCS, SCHEMA))) == brute(DOCS)
    assert sorted(x for s in probed for x in s) == list(range(16)) and len(probed) == (16 if filters == 1 else 1)


def test_exact_keys_that_share_a_half():
    h1, h2 = np.array([5, 5, 5, -7]), np.array([3, 1, 2, 9])
    one = linededup.Exact.of(h1, h2, np.array([30, 10, 20, 90]))
    found, last = one.find(np.array([[5, 2], [5, 4], [-7, 9], [6, 1], [5, 1], [5, 3]]))
    assert found.tolist() == [True, False, True, False, True, True] and last[found].tolist() == [20, 90, 10, 30]


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_insert_then_delete_restores_the_store(spark):
    first = [(i, "\n".join(f"line number {k:020d}" for k in range(i)), "") for i in range(1, 12)]
    later = [(100 + i, "\n".join(f"line number {k:020d}" for k in range(i, 40)), "") for i in range(9)]
    a, b = spark.createDataFrame(first, SCHEMA), spark.createDataFrame(later, SCHEMA)
    store = LineStore.build(a)
    grown = store.insert(b)
    state = lambda s: sorted(map(tuple, s.counts.collect()))
    assert state(grown) == state(LineStore.build(a.union(b)))
    assert rows(grown.apply(a.union(b))) == brute(first + later)
    back = grown.delete(b.select("doc_id"))
    assert state(back) == state(store)
    assert rows(back.apply(a)) == brute(first)
    assert back.filters.agg({"n": "sum"}).first()[0] == store.filters.agg({"n": "sum"}).first()[0]


def test_filter_keeps_and_deletes():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**62), 2**62, (20_000, 2))
    one = built(h[:, 0], h[:, 1])
    assert one.contains(h[:, 0], h[:, 1]).all()
    other = rng.integers(-(2**62), 2**62, (20_000, 2))
    assert one.contains(other[:, 0], other[:, 1]).mean() < 0.01
    one.delete(h[:15_000, 0], h[:15_000, 1])
    assert one.contains(h[15_000:, 0], h[15_000:, 1]).all()
    assert one.contains(h[:15_000, 0], h[:15_000, 1]).mean() < 0.01
    assert Cuckoo.read(one.write()).slots.tolist() == one.slots.tolist()
