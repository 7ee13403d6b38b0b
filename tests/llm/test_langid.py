import math
import random
import zlib
from collections import Counter

import numpy as np

from tessera.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {"xx": ["lorem", "ipsum", "dolor", "sit", "amet"], "yy": ["żółw", "gęś", "kość", "łoś", "ćma"], "zz": ["мир", "дом", "кот", "сон"]}


def make(n=120):
    rng = random.Random(2)
    docs = []
    for k in range(n):
        lang = sorted(WORDS)[k % 3]
        docs.append((k, " ".join(rng.choices(WORDS[lang], k=rng.randint(1, 60))), lang, "x"))
    return docs


def brute_table(texts):
    out = Counter()
    for t in texts:
        cs = [32] * 3 + langid.encode(t).tolist()
        out.update(tuple(cs[k : k + 4]) for k in range(len(cs) - 3) if langid.encode(t).size)
    return out


def brute_p(tables, lang, gram):
    """Interpolated Kneser-Ney by its definition, from dictionaries."""
    orders = {4: {g: Counter(t) for g, t in tables.items()}}
    for k in (3, 2, 1):
        orders[k] = {g: Counter(x[1:] for x in orders[k + 1][g]) for g in tables}
    letters = len({x for g in tables for x in orders[1][g]})

    def p(g, k):
        if k == 0:
            return 1 / (letters + 1)
        t = orders[k][lang]
        ones, twos = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        cut = ones / (ones + 2 * twos) if ones and twos else 0.5
        total = sum(v for x, v in t.items() if x[:-1] == g[:-1])
        if not total:
            return p(g[1:], k - 1)
        types = sum(x[:-1] == g[:-1] for x in t)
        return max(t[g] - cut, 0) / total + cut * types / total * p(g[1:], k - 1)

    return p(gram, 4)


def pack(gram):
    out = 0
    for c in gram:
        out = out << 12 | c
    return out


def test_probabilities_equal_the_definition():
    docs = make(30)
    tables = {g: brute_table([t for _, t, x, _ in docs if x == g]) for g in WORDS}
    model = langid.Model.fit({g: (np.array([pack(x) for x in t], np.int64), np.array(list(t.values()), np.int64)) for g, t in tables.items()})
    rng = random.Random(1)
    seen = sorted({x for t in tables.values() for x in t})
    tries = rng.sample(seen, 40) + [(*a[:2], *b[2:]) for a, b in zip(rng.sample(seen, 40), rng.sample(seen, 40), strict=True)] + [(1, 2, 3, 4), seen[0][:3] + (9,)]
    got = model.logs(np.array([pack(x) for x in tries], np.int64))
    for gram, row in zip(tries, got, strict=True):
        for j, g in enumerate(model.langs):
            assert math.isclose(row[j], math.log(brute_p(tables, g, gram)), rel_tol=1e-4, abs_tol=1e-5), (gram, g)


def test_probabilities_sum_to_one():
    tables = {g: brute_table([t for _, t, x, _ in make(30) if x == g]) for g in WORDS}
    model = langid.Model.fit({g: (np.array([pack(x) for x in t], np.int64), np.array(list(t.values()), np.int64)) for g, t in tables.items()})
    letters = model.keys[1]
    for context in sorted(tables["xx"])[:5]:
        base = pack(context[1:]) << 12
        total = np.exp(model.logs(base | letters).astype(float)).sum(0) + np.exp(model.logs(np.array([base | 4095])).astype(float)).sum(0)
        assert np.allclose(total, 1, atol=1e-4)


def test_entropy_of_pieces_equals_whole(monkeypatch):
    tables = {g: brute_table([t for _, t, x, _ in make(30) if x == g]) for g in WORDS}
    model = langid.Model.fit({g: (np.array([pack(x) for x in t], np.int64), np.array(list(t.values()), np.int64)) for g, t in tables.items()})
    texts = ["lorem ipsum", None, "", "12 !", "кот " * 50, "gęś kość", "x"]
    whole = model.entropies(texts)
    monkeypatch.setattr(langid, "CHUNK", 7)
    pieces = model.entropies(texts)
    assert np.allclose(whole[0], pieces[0]) and (whole[1] == pieces[1]).all()


def test_held_out_and_edges(spark):
    docs = make() + [(1000, None, "xx", ""), (1001, "", None, ""), (1002, "123 %%%", "yy", ""), (None, "lorem ipsum dolor", "yy", ""), (1003, "lorem " * 60_000, None, ""), (1003, "lorem " * 60_000, None, ""), (1004, "ქართული ენა არის ძალიან ლამაზი და მდიდარი", None, "")]
    rows = langid.identify(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 1000 and r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in rows}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected for k in (1000, 1001, 1002))
    assert by[None].lang_pred == "xx" and not by[None].held_out and by[1003].lang_pred == "xx"
    assert by[1004].rejected and not any(r.rejected for r in rows if r.doc_id is None or r.doc_id < 1000)
    assert all(0 <= r.score <= 1 for r in rows)
    kept = langid.keep_known(spark.createDataFrame(docs, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == len(docs) - 4


def test_nothing_to_learn(spark):
    rows = langid.identify(spark.createDataFrame([(1, "abc", None, "")], SCHEMA)).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in rows] == [("und", 0.0, False)]
    assert langid.identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rare_languages_stay_beside_a_frequent_one(spark):
    rng = random.Random(4)
    # one language has 60,000 distinct grams, eighty more a few that occur once
    docs = [(k, "".join(rng.choices([chr(0x4E00 + x) for x in range(1500)], k=60_000)), "big", "") for k in (0, 2, 3)]
    docs += [(100 + k, "".join(chr(0xAC00 + 40 * k + x) for x in range(30)), f"l{k:02d}", "") for k in range(120)]
    train = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 3 != 1]
    model = langid.train(spark.createDataFrame(docs, SCHEMA))
    assert model.langs == sorted({d[2] for d in train}) and len(model.langs) > 70
    grams = {(x, g) for _, t, x, _ in train for g in langid.grams([langid.encode(t)])[0].tolist()}
    assert len(model.logp[4].lang) == len(grams) > 60_000
    rare = [d for d in train if d[2] != "big"]
    assert model.predict([d[1] for d in rare])[0] == [d[2] for d in rare]


def test_letters_beyond_the_second_plane():
    assert langid.encode("\U00030000\U00031000 \U00020000").size == 5 and langid.encode("\U000e0001").size == 0


def test_limits_are_those_of_all_documents(spark):
    rng = random.Random(8)
    rows = [("a", 2 + rng.gauss(0, 0.3), rng.randint(1, 600)) for _ in range(5_000)] + [("b", 3.5, 10), ("c", 2.0, 500), ("c", 2.4, 500)]
    got = {r.lang: (r["limit"], r.short) for r in langid.limits(spark.createDataFrame(rows, "lang string, entropy double, length long")).collect()}
    for lang in "abc":
        own = [(e, n) for x, e, n in rows if x == lang]
        mean = sum(e * n for e, n in own) / sum(n for _, n in own)
        tail = lambda x: sorted(x)[math.ceil(0.999 * len(x)) - 1] if x else 0.0
        gap = max(langid.LEAST_GAP, 2 * tail([e - mean for e, n in own if n >= 200]))
        short = max(0.0, 2 * tail([(e - mean) * math.sqrt(n) for e, n in own if n < 200]))
        assert math.isclose(got[lang][0], mean + gap, abs_tol=0.01) and math.isclose(got[lang][1], short, abs_tol=0.01)


def test_a_rare_language_rejects_noise(spark):
    rng = random.Random(5)
    docs = [(3 * k, " ".join(rng.choices(WORDS["xx"], k=40)), "xx", "") for k in range(400)]
    docs += [(10_000 + k, " ".join(rng.choices(WORDS["zz"], k=40)), "zz", "") for k in range(4)] + [(20_000, "".join(rng.choices("бвгджзлнпртфхцчшщъыьэюя ", k=400)), None, "")]
    by = {r.doc_id: r for r in langid.identify(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert by[20_000].lang_pred == "zz" and by[20_000].rejected and not any(r.rejected for k, r in by.items() if k < 20_000)
