import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality

DOCS = "doc_id long, text string, host string, path string, toxic string"
LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng = random.Random(7)
    plain = [f"word{k}" for k in range(60)]
    docs, labels = [], []
    for k in range(600):
        bad = k % 3 == 0 if k % 2 else k % 10 == 0  # odd documents: host "low", a third bad
        host = "low" if k % 2 else "high"
        words = rng.choices(plain, k=rng.randint(20, 60))
        nasty = k % 7 == 0
        if nasty:
            words[5] = rng.choice(["vile", "nasty"])
        text = " ".join(words)
        docs.append((k, text.upper() + "!!!" if bad else text, host, f"{host}/{k % 5}", "x"))
        if k % 4 != 3:
            labels.append((k, 0 if bad else 1, 1 if nasty else 0))
    return docs, labels


def run(spark, docs, labels):
    return quality.judge(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), F.col("host"), F.col("path")).collect()


def test_learns_both_labels_and_keeps_clean(spark):
    docs, labels = corpus()
    rows = {r.doc_id: r for r in run(spark, docs, labels)}
    assert len(rows) == len(docs)
    for k, text, *_ in docs:
        assert rows[k].is_toxic == (k % 7 == 0), k
        assert (rows[k].quality >= 0.5) == (text != text.upper()), k
    assert rows[1].host_quality < rows[2].host_quality


def test_posteriors_equal_the_formula(spark):
    docs, labels = corpus()
    rows = run(spark, docs, labels)
    where = {k: (h, p) for k, _, h, p, _ in docs}
    ev = {r.doc_id: r.label_quality if r.label_quality is not None else r.doc_quality for r in rows}
    host, path = {}, {}
    for k, (h, p) in where.items():
        host.setdefault(h, []).append(ev[k])
        path.setdefault((h, p), []).append(ev[k])
    rate = (sum(ev.values()) + 0.5) / (len(ev) + 1)

    def strength(groups):  # (mean, above, n)
        n = sum(g[2] for g in groups)
        spread = sum(c * (m - a) ** 2 for m, a, c in groups) - sum(a * (1 - a) for _, a, _ in groups)
        noise = sum(c * a * (1 - a) for _, a, c in groups) / n
        return min(1e6, max(1.0, noise / max(spread / n, 1e-12) - 1))

    kh = strength([(np.mean(v), rate, len(v)) for v in host.values()])
    above = {h: (sum(v) + kh * rate) / (len(v) + kh) for h, v in host.items()}
    kp = strength([(np.mean(v), above[h], len(v)) for (h, _), v in path.items()])
    for r in rows[:50]:
        h, p = where[r.doc_id]
        at_host = (sum(host[h]) - ev[r.doc_id] + kh * rate) / (len(host[h]) - 1 + kh)
        at_path = (sum(path[h, p]) - ev[r.doc_id] + kp * at_host) / (len(path[h, p]) - 1 + kp)
        assert abs(r.host_quality - at_host) < 1e-6 and abs(r.path_quality - at_path) < 1e-6
        odds = np.log(r.doc_quality / (1 - r.doc_quality)) + np.log(at_path / (1 - at_path)) - np.log(rate / (1 - rate))
        assert abs(r.quality - 1 / (1 + np.exp(-odds))) < 1e-6


def test_sparse_sites_stay_near_the_prior(spark):
    docs, labels = corpus()
    docs += [(9000, "WORD1 WORD2 WORD3 " * 9 + "!!!", "lone", "lone/1", ""), (9001, "word1 word2 " * 12, "lone", "lone/1", "")]
    rows = {r.doc_id: r for r in run(spark, docs, labels)}
    assert abs(rows[9001].host_quality - rows[9000].host_quality) < 0.2
    assert rows[9001].keep and not rows[9000].keep


def test_edges(spark):
    docs, labels = corpus()
    more = [(None, None, None, None, None), (7000, "", None, "p", ""), (7001, "word1 " * 60_000, "high", None, ""), (0, docs[0][1], "high", "high/0", "x")]
    rows = run(spark, docs + more, labels + [(None, 1, 1), (5, None, None), (8, 1, None), (8, 1, 0), (99999, 0, 1)])
    assert len(rows) == len(docs) + 4 and all(0 <= r.quality <= 1 and 0 <= r.toxic <= 1 for r in rows)
    assert all(r.keep for r in run(spark, docs[:5], []))
    assert run(spark, [], labels) == []
    assert len(run(spark, docs[:20], [(k, 1, 0) for k in range(10)])) == 20


def test_classifier_equals_brute_force(spark):
    """Words by their likelihood ratio, shapes in bins, and the weights at which the
    penalised likelihood is flat, all from plain loops."""
    docs, labels = corpus()
    known = quality.clean_labels(spark.createDataFrame(labels, LABELS))
    model = quality.fit(spark.createDataFrame(docs, DOCS), known)
    value = {k: (q, t) for k, q, t in labels}
    sample = [(t, value[k]) for k, t, *_ in docs if k in value]
    for head in (0, 1):
        have, texts = {}, [(set(quality.words_of(t)), v[head]) for t, v in sample]
        n = [sum(y == side for _, y in texts) for side in (0, 1)]
        for words, y in texts:
            for w in words:
                have.setdefault(w, [0, 0])[y] += 1
        want = {}
        for w, (b, a) in have.items():
            cells = [(a, n[1]), (b, n[0]), (n[1] - a, n[1]), (n[0] - b, n[0])]
            shares = [(a + b) / sum(n)] * 2 + [1 - (a + b) / sum(n)] * 2
            g = 2 * sum(c * np.log(c / (m * s)) for (c, m), s in zip(cells, shares, strict=True) if c)
            if a + b >= quality.LEAST_DOCS and g >= quality.LEAST_RATIO:
                want[w] = np.log((a + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1))
        assert model.words[head].keys() == want.keys() and all(abs(model.words[head][w] - v) < 1e-9 for w, v in want.items())
        shapes = [quality.shape(t, quality.words_of(t)) for t, _ in sample]
        edges = [np.quantile([s[k] for s in shapes], [q / 8 for q in range(1, 8)]) for k in range(quality.SHAPES)]
        x = []
        for (words, _), s in zip(texts, shapes, strict=True):
            up, down = [want[w] for w in words if want.get(w, 0) > 0], [want[w] for w in words if want.get(w, 0) < 0]
            row = [min(sum(up), 20), max(sum(down), -20), np.log1p(len(up)), np.log1p(len(down))]
            for k, v in enumerate(s):
                row += [float(sum(v >= e for e in edges[k]) == b) for b in range(8)]
            x.append([*row, 1.0])
        x, y, w = np.array(x), np.array([v for _, v in texts]), model.weights[head]
        slope = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - np.append(np.full(x.shape[1] - 1, quality.RIDGE), 1e-3) * w
        assert np.abs(slope).max() < 1e-3

        class Text(str):
            as_py = lambda self: str(self)

        got = model.log_odds([Text(t) for t, _ in sample])[head]
        assert np.allclose(got, np.clip(x @ w, -30, 30), atol=1e-6)


def test_the_sample_keeps_its_bound(spark, monkeypatch):
    docs, labels = corpus()
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 100)
    seen = []
    keep = quality.materialise
    monkeypatch.setattr(quality, "materialise", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    assert len(run(spark, docs, labels)) == len(docs)
    assert 50 < dict(seen)["quality-sample"].count() < 150


def test_bounded_tables_have_bounded_files(spark, monkeypatch):
    """However many partitions documents and shuffles have; labels need no table of their own."""
    docs, labels = corpus()
    monkeypatch.setattr(quality, "SAMPLE_PARTS", 3)
    seen = []
    keep = quality.materialise
    monkeypatch.setattr(quality, "materialise", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    held = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        many = spark.createDataFrame(docs, DOCS).repartition(40)
        rows = quality.judge(many, spark.createDataFrame(labels, LABELS), F.col("host"), F.col("path")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == len(docs) and "labels" not in dict(seen)
    assert dict(seen)["quality-sample"].count() == len(labels)
    assert all(len(dict(seen)[name].inputFiles()) <= 3 for name in ("quality-sample", "quality-words"))
