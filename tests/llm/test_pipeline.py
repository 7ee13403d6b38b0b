"""The five stages against brute-force versions of each, on a small corpus with planted cases."""

import random

import pytest
from test_decontam import brute as contaminated
from test_linededup import brute as dedup
from test_mixing import brute as mix
from test_simhash import brute_print, brute_roots

import corpus_pipeline as pipeline

SHARED = "this very line is shared by several documents here"
STRANGE = "ქართული ენა არის ძალიან ლამაზი და მდიდარი ენა რომელსაც აქვს საკუთარი დამწერლობა"
WORDS = {"en": "the of and river stone water green light house under quiet morning walked window garden".split(), "pl": "żółw gęś kość łoś ćma źródło mąka ścieżka wędrówka księżyc".split()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("sf")
    bench = [(k, " ".join(f"item{k}word{j}" for j in range(20))) for k in range(4)] + [(9, None)]
    docs = []
    for k in range(160):
        lang = "en" if k % 4 else "pl"
        docs.append((k, " ".join(rng.choices(WORDS[lang], k=rng.randint(30, 90))), lang, ("web", "book", "news")[k % 3] if k % 10 else None))
    base = docs[20][1]
    docs += [(200, base, "en", "web"), (201, base + " stone", "en", "book"), (202, base.upper() + "\nan end", "en", "web")]
    docs += [(210 + k, f"{' '.join(rng.choices(WORDS['en'], k=40))}\n{SHARED}{' ' * k}", "en", "news") for k in range(5)]
    docs += [(220, f"river stone {bench[0][1]} quiet", "en", "web"), (221, f"{' '.join(rng.choices(WORDS['en'], k=600))} {' '.join(bench[1][1].split()[:13])}", "en", "book")]
    docs += [(230, STRANGE, None, "web"), (231, "12345 %% !!", "en", "web"), (232, None, "en", "web"), (233, "", "en", "book")]
    docs += [(240, "the river and the stone under quiet water " * 800, "en", "web"), (None, " ".join(rng.choices(WORDS["en"], k=50)), None, "web")]
    rows = [(i, t, x, s, len(t or ""), "kept") for i, t, x, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, bench


def key(row):
    return (row[0] is not None, row[0] or 0, row[1] or "")


def stage(number, spark, docs, folder):
    return pipeline.STAGES[number][1](spark, docs, folder)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=key)


def test_stages(spark, tables):
    folder, docs, bench = tables
    assert [name for name, _ in pipeline.STAGES] == ["language identification", "line dedup", "near-duplicates", "decontamination", "source mix"]
    table = spark.read.parquet(f"{folder}/documents.parquet")

    one = stage(0, spark, table, folder)
    known = sorted(((i, t) for i, t, _, _ in docs if i not in (230, 231, 232, 233)), key=key)
    assert pairs(one) == known and one.columns == table.columns

    two = stage(1, spark, one, folder)
    lines = dedup([(i, t, None) for i, t in known])
    assert two.columns == table.columns
    assert pairs(two) == sorted(((i if there else None, t) for there, i, t, _, _ in lines), key=key)
    assert all(r.n_chars == len(r.text) for r in two.collect())
    held = pairs(two)
    assert sum(SHARED in t for _, t in held) == 1 and any(i == 214 and SHARED in t for i, t in held)

    three = stage(2, spark, two, folder)
    roots = brute_roots([brute_print(t) for _, t in held])
    least = {}
    for i, t in held:
        root = roots[brute_print(t)]
        least[root] = min(least.get(root, 2**63), 2**63 - 1 if i is None else i)
    first = sorted(((i, t) for i, t in held if least[roots[brute_print(t)]] == (2**63 - 1 if i is None else i)), key=key)
    assert three.columns == table.columns and pairs(three) == first
    kept = {i for i, _ in first}
    assert 20 in kept and 200 not in kept

    four = stage(3, spark, three, folder)
    marks = {r[0]: r[5] for r in contaminated([(i, t, None) for i, t in first], bench, 13)}
    clean = [(i, t) for i, t in first if not marks[i]]
    assert four.columns == table.columns and pairs(four) == clean
    assert marks[220] and not marks[221]

    source = {i: s for i, _, _, s in docs}
    five = stage(4, spark, four, folder)
    want = [r for r in mix([(i, t, source[i]) for i, t in clean]) if r[4] > 0]
    got = [(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in five.collect()]
    by = lambda r: (r[0] is not None, r[0] or 0)
    for a, b in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert (*a[:3], a[4]) == (*b[:3], b[4]) and a[3] == pytest.approx(b[3])

    whole = [(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in pipeline.run(spark, folder).collect()]
    assert sorted(whole, key=by) == sorted(got, key=by)


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
