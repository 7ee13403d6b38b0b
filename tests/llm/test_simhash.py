import random
import re

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.components import components

SCHEMA = "doc_id long, text string, fp string"
MASK = 2**64 - 1


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in h]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints):
    """The smallest reachable print of each, by comparing all."""
    prints = sorted(set(prints))
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(prints):
        for y in prints[:i]:
            if (x ^ y).bit_count() <= 4:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in prints}


def near(rng, n, base=None):
    out = []
    for _ in range(n):
        x = rng.getrandbits(64) if base is None else base
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        out.append(x)
    return out


def signed(x):
    return x - 2**64 if x >> 63 else x


def groups(pairs):
    out = {}
    for node, root in pairs:
        out.setdefault(root, set()).add(node)
    return {frozenset(v) for v in out.values() if len(v) > 1}


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    prints = near(rng, 300) + near(rng, 200, 0x0123456789ABCDEF) + near(rng, 100, MASK) + [0, 1, 3, MASK]
    for x in list(prints[:50]):
        prints += near(rng, 3, x)
    want = groups((signed(k), v) for k, v in brute_roots(prints).items())
    df = spark.createDataFrame([(signed(x),) for x in set(prints)], "fp long")
    for tile in (8192, 40):
        roots = components(simhash.links(df, tile=tile)).collect()
        assert groups([(r.node, r.root) for r in roots] + [(r.root, r.root) for r in roots]) == want


def test_more_parts_lose_nothing(spark, monkeypatch):
    rng = random.Random(4)
    prints = near(rng, 100) + near(rng, 60, 0xFFFF0000FFFF0000)
    want = groups((signed(k), v) for k, v in brute_roots(prints).items())
    df = spark.createDataFrame([(signed(x),) for x in set(prints)], "fp long")
    monkeypatch.setattr(simhash, "GROUP", 1e-3)
    assert len(simhash.parts_of(len(prints), 4)) == 15
    roots = components(simhash.links(df)).collect()
    assert groups([(r.node, r.root) for r in roots] + [(r.root, r.root) for r in roots]) == want


def documents():
    rng = random.Random(1)
    base = [" ".join(rng.choices(["Alpha", "bêta", "c", "dd", "EE", "f"], k=rng.randint(1, 40))) for _ in range(30)]
    docs = [(k, t, "x") for k, t in enumerate(base)] + [(100 + k, t.upper(), None) for k, t in enumerate(base[:9])]
    docs += [(k + 200, t + " more", "") for k, t in enumerate(base)]
    docs += [(300, None, ""), (301, "", ""), (302, " \t\n", ""), (303, "word " * 70_000, ""), (5, base[7], ""), (5, base[7], ""), (None, base[8], ""), (None, "quite alone here by itself now", ""), (None, "quite alone here by itself now", "")]
    return docs


def test_components_equal_brute_force(spark):
    docs = documents()
    prints = [brute_print(t) for _, t, _ in docs]
    roots, least = brute_roots(prints), {}
    for (i, _, _), p in zip(docs, prints, strict=True):
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    want = sorted(((i, p, least.get(roots[p])) for (i, _, _), p in zip(docs, prints, strict=True)), key=repr)
    got = simhash.clusters(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.fp & MASK, r.component_id) for r in got), key=repr) == want
    kept = simhash.keep_one(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted(roots[brute_print(r.text)] for r in kept) == sorted(set(roots.values()))
    assert all(least.get(roots[brute_print(r.text)]) == r.doc_id for r in kept)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.clusters(df).collect() == [] and simhash.keep_one(df).collect() == []


def test_tiles_far_apart_in_count_are_skipped():
    a = np.zeros(1000, np.int64) + np.arange(1000)
    b = ~a
    x, y = simhash.local_roots(a, b, 4)
    assert len(x) == len(y) == 0
    x, y = simhash.local_roots(a, a ^ 1, 4)
    assert len(x) == 1998 and set(y.tolist()) == {0}
