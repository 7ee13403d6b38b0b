import pickle
import random
import re
import tracemalloc

import numpy as np
import pytest

from tessera.llm import decontam

SCHEMA = "doc_id long, text string, items string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench, n):
    out = []
    for i, t, _ in docs:
        w, hit, items, longest = words(t), set(), set(), 0
        for item, text in bench:
            b = words(text)
            size = min(n, len(b))
            for j in range(len(b) - size + 1 if size else 0):
                for k in range(len(w) - size + 1):
                    if w[k : k + size] == b[j : j + size]:
                        hit |= set(range(k, k + size))
                        items.add("" if item is None else str(item))
                        m = size
                        while k + m < len(w) and j + m < len(b) and w[k + m] == b[j + m]:
                            m += 1
                        longest = max(longest, m)
        out.append((i, len(w), sorted(hit), sorted(items), longest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(5)
    vocab = ["alpha", "Beta", "GAMMA", "délta", "e1", "7", "Ω"]
    bench = [(k, " ".join(rng.choices(vocab, k=rng.randint(5, 14)))) for k in range(6)]
    bench += [(9, "one two"), (9, "single"), (None, "null item here"), (11, None), (12, ""), (13, "--- ...")]
    docs = [(k, " ".join(rng.choices(vocab, k=rng.randint(0, 60))), "x") for k in range(40)]
    docs += [(100, bench[0][1] + "! tail", ""), (100, bench[0][1] + "! tail", ""), (101, None, None), (102, "", ""), (None, "One--TWO null item HERE", ""), (103, "filler " * 5000 + bench[1][1] + " filler" * 5, "")]
    return docs, bench


@pytest.mark.parametrize(("n", "shard", "block"), [(5, 1_000_000, 1 << 24), (3, 50, 40)])
def test_equals_brute_force(spark, monkeypatch, n, shard, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "SHARD_WORDS", shard)
    docs, bench = cases()
    df = decontam.mark(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(bench, "item_id long, text string"), n)
    got = sorted([(r.doc_id, r.n_words, r.hits, r["items"], r.longest, r.contaminated) for r in df.collect()], key=repr)
    assert got == brute(docs, bench, n)


def test_small_shards_and_joins_give_the_same(spark, monkeypatch):
    docs, bench = cases()
    df, items = spark.createDataFrame(docs, SCHEMA).coalesce(1), spark.createDataFrame(bench, "item_id long, text string")
    monkeypatch.setattr(decontam, "SHARD_WORDS", 10)
    monkeypatch.setattr(decontam, "FOUND_BYTES", 0)
    got = sorted([(r.doc_id, r.n_words, r.hits, r["items"], r.longest, r.contaminated) for r in decontam.mark(df, items, 4).collect()], key=repr)
    assert got == brute(docs, bench, 4)
    clean = [str(r[0]) for r in brute(docs, bench, 4) if not r[-1]]
    assert sorted(str(r.doc_id) for r in decontam.decontaminate(df, items, 4).collect()) == sorted(clean)


def test_suffixes_are_sorted_and_found_again():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 4, rng.integers(1, 60)).astype(np.int32) for _ in range(30)]
    one = decontam.Shard.of([bytes([k]) for k in range(30)], docs, 2, 4, 2)
    words = one.words.tolist() + [0] * 4
    suffixes = [words[k : k + 4] for k in one.suffixes]
    assert suffixes == sorted(suffixes)
    runs = sum(max(0, len(r) - 1) for d in docs for r in "".join(map(str, d)).split("0"))
    assert len(suffixes) == runs
    for begin, doc, at in zip(one.begin, one.doc, one.at, strict=True):
        assert docs[one.keys[doc][0]][at] == one.words[begin] and (at == 0 or docs[one.keys[doc][0]][at - 1] == 0)


def test_a_large_block_takes_little_memory():
    rng = random.Random(2)
    rows = [(k, " ".join(f"w{rng.randint(0, 20_000)}" for _ in range(100))) for k in range(4_000)]
    words = sorted({w for _, t in rows for w in decontam.words_of(t)})
    vocabulary = {w: k for k, w in enumerate(words, 1)}
    tracemalloc.start()
    tests = decontam.Tests.of(rows, vocabulary, 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = sum(len(t) for _, t in rows)
    assert len(tests.windows[13].place) == 4_000 * 88 and len(pickle.dumps(tests)) < 8 * size and peak < 80 * size


def test_empty_tables_and_removal(spark):
    docs, bench = cases()
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame(docs, SCHEMA)
    assert decontam.decontaminate(df, none, 5).count() == len(docs)
    assert decontam.mark(df.limit(0), spark.createDataFrame(bench, "item_id long, text string"), 5).collect() == []
    kept = decontam.decontaminate(df, spark.createDataFrame(bench, "item_id long, text string"), 5)
    assert kept.columns == df.columns
    assert 100 not in {r.doc_id for r in kept.collect()}


def test_words_of_the_documents_are_counted_without_a_regex(spark):
    """A regular expression that makes an object of every word took most of the query's time."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10FFFF, 97)]))
    texts = [None, "", " ", "a", " a", "a b ", "A-1\n\n\x0bÉ\x00\x7fz", "   x", every, *(f"a{c}b" for c in every[:256])]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA)
    df = decontam.mark(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"), 2)
    assert {r.doc_id: r.n_words for r in df.collect()} == {k: len(words(t)) for k, t in enumerate(texts)}
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
