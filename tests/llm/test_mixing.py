import hashlib
import re

import pytest

from tessera.llm import mixing

SCHEMA = "doc_id long, text string, source string, h string, size string"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Raise all sources' shares together until each is full or all words are given out."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(sizes), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        for s in full or free:
            out[s] = 3.0 * sizes[s] if full else level * weight[s]
            left -= out[s]
        free -= full or free
    return out


def brute(docs):
    """(doc_id, size, source_size, target, taken) of each row, by sorting."""
    sizes, rows = {}, {}
    for doc_id, text, source, *_ in docs:
        n = size_of(text)
        sizes[source] = sizes.get(source, 0) + n
        h = int(hashlib.md5(f"{'' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()[:15], 16)
        rows.setdefault(source, []).append((h, n, doc_id))
    targets, out = brute_targets(sizes), []
    for source, own in rows.items():
        whole = int(targets[source] // sizes[source]) if sizes[source] else 0
        rest = targets[source] - whole * sizes[source]
        words = {h: sum(n for g, n, _ in own if g == h) for h, _, _ in own}
        chosen, run = set(), 0
        left = sorted(words)
        while left and run + words[left[0]] <= rest:
            chosen.add(left[0])
            run += words[left.pop(0)]
        if left and sizes[source]:
            gap = rest - run
            _, h = min((abs(n - gap), h) for h, n, _ in own if h in left)
            if abs(words[h] - gap) < gap:
                chosen.add(h)
        out += [(doc_id, n, sizes[source], targets[source], n * (whole + (h in chosen))) for h, n, doc_id in own]
    return out


def got(spark, docs):
    df = mixing.mix(spark.createDataFrame(docs, SCHEMA))
    return [(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()]


def same(a, b):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[4])
    a, b = sorted(a, key=key), sorted(b, key=key)
    assert [(*x[:3], x[4]) for x in a] == [(*x[:3], x[4]) for x in b]
    assert [x[3] for x in a] == pytest.approx([x[3] for x in b])


def corpus():
    docs = [(k, "w " * (k * 7 % 23), "abcd"[k % 4] if k % 3 else "a", "x", None) for k in range(150)]
    docs += [(200 + k, f"n{k} " * 9, None, None, None) for k in range(20)]
    docs += [(300, "tiny source", "e", None, None), (301, None, "f", None, None), (302, "", "a", None, None)]
    docs += [(None, "one two", "a", None, None), (None, "one two", "a", None, None), (5, "copy of a row", "b", None, None), (5, "copy of a row", "b", None, None)]
    return [*docs, (400, "long " * 3000, "c", None, None)]


def test_equals_brute_force(spark):
    docs = corpus()
    found = got(spark, docs)
    same(found, brute(docs))
    assert all(r[4] <= 3 * r[1] for r in found)


def test_near_targets(spark):
    docs = [(k, f"{k} " * (1 + k % 40), "abc"[k % 3], None, None) for k in range(3000)]
    found = got(spark, docs)
    for k in range(3):
        own = [r for r in found if r[0] % 3 == k]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= 20


def test_one_hot_source_and_reruns(spark):
    docs = [(k, "same words here", "hot", None, None) for k in range(400)] + [(1000 + k, "b b", "small", None, None) for k in range(5)]
    a = got(spark, docs)
    assert sorted(a) == sorted(got(spark, docs))
    same(a, brute(docs))


def test_budgets_are_nested(spark):
    """A higher weight takes all that a lower one takes."""
    df = spark.createDataFrame([(k, f"{k} x y", "ab"[k % 2], None, None) for k in range(400)], SCHEMA)
    low, high = ({r.doc_id for r in mixing.mix(df, weights=w).filter("source = 'a' and taken > 0").collect()} for w in ((1.0, 4.0), (1.0, 2.0)))
    assert low < high


def test_edges(spark):
    assert got(spark, []) == []
    assert sorted(got(spark, [(1, None, None, None, None), (2, "", "a", None, None)])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert got(spark, [(1, "a b c", "only", None, None)]) == [(1, 3, 3, 3.0, 3)]
