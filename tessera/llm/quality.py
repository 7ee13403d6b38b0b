"""Quality and toxicity by hierarchical empirical Bayes over hosts and paths.

A document classifier gives each text log-odds for both labels: words associated with the
label (the likelihood ratio of their document frequencies decides) and the shape of the text (shares
of capitals, digits, symbols, repeated words and lines, in bins) enter a ridge logistic
regression. Per host and per path, evidence is summed over all documents (the label where
there is one, else the classifier's probability). A host's posterior mean shrinks to the
global one, a path's to its host's, by strengths found from the spread between groups
(method of moments), so sparse sites stay near what stands above them. A document's final
log-odds are its own plus the shift of its path's posterior, without the document itself,
from the global rate.

Bound: the classifier is fitted on about ``SAMPLE_DOCS`` labelled documents, picked by hash;
sums over hosts and paths cover all documents.

Defined cases: null text has the shape of an empty one; null hosts or paths are the group of
the empty string; several labels of a document are averaged, null labels and labels of
unknown documents are ignored; without labels all evidence is zero, quality and toxicity are
a half, and all is kept; repeated rows count each; an empty table gives an empty result;
further columns aren't read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import add_columns, materialise, maybe_broadcast

HEADS = ("quality", "toxic")
SAMPLE_DOCS = 20_000
#: The sample and its words are bounded, and so are the files that hold them, however many
#: partitions the documents have: on a local file system each file costs processes for its rights.
SAMPLE_PARTS = 48
MOST_WORDS, LEAST_DOCS, LEAST_RATIO = 20_000, 4, 20.0
BINS, RIDGE, ROUNDS = 8, 1.0, 30
WORD = re.compile(r"[^\W\d_]+")
SHAPES = 9


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shape(text: str, words: list[str]) -> list[float]:
    """What the text looks like, as shares and logs; words: its words."""
    n = max(1, len(text))
    letters = sum(map(len, words))
    upper = len(text) - len(re.sub(r"[A-ZÀ-ÖØ-Þ]+", "", text))
    blank = len(text) - len(re.sub(r"\s+", "", text))
    digits = len(text) - len(re.sub(r"\d+", "", text))
    lines = [x for x in text.split("\n") if x.strip()]
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        float(np.log1p(len(words))),
        upper / max(1, letters),
        digits / n,
        max(0, len(text) - letters - digits - blank) / n,
        len(set(words)) / max(1, len(words)),
        runs / max(1, len(words)),
        len(set(lines)) / max(1, len(lines)),
        letters / max(1, len(words)),
        len(lines) / max(1, len(words)),
    ]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def ridge_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression (last column of x: ones, not shrunk), by Newton steps."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], RIDGE)
    shrink[-1] = 1e-3
    for _ in range(ROUNDS):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Classifier:
    words: list[dict[str, float]]
    edges: np.ndarray
    weights: list[np.ndarray]

    def features(self, evidence: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, s, "right") for e, s in zip(self.edges, shapes.T, strict=True)], 1)
        hot = (bins[:, :, None] == np.arange(BINS)).reshape(len(shapes), -1)
        return np.hstack([evidence, hot, np.ones((len(shapes), 1))])

    def log_odds(self, texts: list) -> list[np.ndarray]:
        shapes = np.zeros((len(texts), SHAPES))
        evidence = [np.zeros((len(texts), 4)) for _ in self.words]
        for k, text in enumerate(texts):
            text = text.as_py() or ""
            words = words_of(text)
            shapes[k] = shape(text, words)
            for table, row in zip(self.words, evidence, strict=True):
                row[k] = word_evidence(table, [words])[0]
        return [np.clip(self.features(e, shapes) @ w, -30, 30) if w is not None else np.zeros(len(texts)) for e, w in zip(evidence, self.weights, strict=True)]


def word_evidence(table: dict[str, float], found: list[list[str]]) -> np.ndarray:
    """Sums (bounded) and log counts of the weights of each text's distinct words, for and against."""
    rows = []
    for words in found:
        w = np.array([table[x] for x in sorted(table.keys() & set(words))])
        up, down = w[w > 0], w[w < 0]
        rows.append([min(up.sum(), 20.0), max(down.sum(), -20.0), float(np.log1p(len(up))), float(np.log1p(len(down)))])
    return np.array(rows).reshape(-1, 4)


def clean_labels(labels: DataFrame) -> DataFrame:
    """doc_id and the mean of each label, one row a document."""
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.avg(h).alias(f"label_{h}") for h in HEADS])


def likelihood_ratio(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Twice the log-likelihood ratio of a word being in a of n1 and b of n0 documents
    against its being independent of the label."""
    part = lambda have, want: F.when(have > 0, have * F.log(have / want)).otherwise(0.0)
    n, word = float(n1 + n0), a + b
    with_ = part(a, word * n1 / n) + part(b, word * n0 / n)
    return 2 * (with_ + part(n1 - a, (n - word) * n1 / n) + part(n0 - b, (n - word) * n0 / n))


def fit(docs: DataFrame, known: DataFrame) -> Classifier | None:
    """The classifier of a bounded sample of the labelled documents; None without any."""
    n = known.count()
    share = min(1.0, SAMPLE_DOCS / max(1, n))
    picked = known.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= min(int(share * 2**63), 2**63 - 1))
    sample = materialise(docs.select("doc_id", "text").join(maybe_broadcast(picked, int(n * share)), "doc_id").select("text", *[f"label_{h}" for h in HEADS]).repartition(SAMPLE_PARTS), "quality-sample")
    schema = pa.schema([("word", pa.string()), *[(f"label_{h}", pa.float64()) for h in HEADS]])

    def distinct_words(batches):
        for batch in batches:
            out = [(w, *labels) for text, *labels in zip(*[c.to_pylist() for c in batch.columns], strict=True) for w in set(words_of(text or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.types[k]) for k in range(len(schema))], schema=schema)

    counts = sample.mapInArrow(distinct_words, "word string, " + ", ".join(f"label_{h} double" for h in HEADS)).groupBy("word")
    counts = materialise(counts.agg(*[F.sum((F.col(f"label_{h}") >= 0.5).cast("long")).alias(f"{h}_1") for h in HEADS], *[F.sum((F.col(f"label_{h}") < 0.5).cast("long")).alias(f"{h}_0") for h in HEADS]).coalesce(SAMPLE_PARTS), "quality-words")
    totals = sample.agg(*[F.sum((F.col(f"label_{h}") >= 0.5).cast("long")).alias(f"{h}_1") for h in HEADS], *[F.sum((F.col(f"label_{h}") < 0.5).cast("long")).alias(f"{h}_0") for h in HEADS]).first()
    tables = []
    for h in HEADS:
        if not (totals[f"{h}_1"] and totals[f"{h}_0"]):
            tables.append({})
            continue
        a, b = F.coalesce(F.col(f"{h}_1"), F.lit(0)), F.coalesce(F.col(f"{h}_0"), F.lit(0))
        n1, n0 = totals[f"{h}_1"], totals[f"{h}_0"]
        w = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
        top = counts.filter(a + b >= LEAST_DOCS).select("word", w.alias("w"), likelihood_ratio(a, b, n1, n0).alias("g")).filter(F.col("g") >= LEAST_RATIO)
        tables.append({r.word: r.w for r in top.orderBy(F.desc("g"), "word").limit(MOST_WORDS).collect()})

    def features_of(texts):
        found = [words_of(t.as_py() or "") for t in texts]
        evidence = [word_evidence(table, found).tolist() for table in tables]
        return [[shape(t.as_py() or "", w) for t, w in zip(texts, found, strict=True)], *evidence]

    fields = "_shape array<double>, " + ", ".join(f"_words{k} array<double>" for k in range(len(HEADS)))
    rows = add_columns(sample, features_of, fields, ["text"]).drop("text").toPandas()
    if not len(rows):
        return None
    shapes = np.stack(rows["_shape"])
    edges = np.stack([np.quantile(s, np.arange(1, BINS) / BINS) for s in shapes.T])
    out = Classifier(tables, edges, [])
    for k, h in enumerate(HEADS):
        have = rows[f"label_{h}"].notna().to_numpy()
        x = out.features(np.stack(rows[f"_words{k}"])[have], shapes[have])
        y = (rows[f"label_{h}"][have].to_numpy() >= 0.5).astype(float)
        out.weights.append(ridge_logistic(x, y) if len(y) else None)
    return out


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, mean: str, above: str, n: str) -> float:
    """How many documents' worth of prior a level's groups get: from the spread of their
    means about what stands above them, less what chance would give."""
    m = F.col(above)
    r = groups.agg(F.sum(F.col(n) * (F.col(mean) - m) ** 2).alias("spread"), F.sum(m * (1 - m)).alias("chance"), F.sum(n).alias("n"), F.sum(F.col(n) * m * (1 - m)).alias("noise")).first()
    if not r["n"]:
        return 1.0
    between = (r.spread - r.chance) / r["n"]
    return float(min(1e6, max(1.0, r.noise / r["n"] / max(between, 1e-12) - 1)))


def posteriors(rows: DataFrame, head: str) -> tuple[DataFrame, DataFrame, dict]:
    """rows: host, path, ev_<head>. Tables of hosts and paths with their sums and priors."""
    ev = F.col(f"ev_{head}")
    paths = materialise(rows.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum(ev).alias("path_s")), f"{head}-paths")
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"))
    r = paths.agg(F.sum("path_s").alias("s"), F.sum("path_n").alias("n")).first()
    rate = (r.s + 0.5) / (r["n"] + 1) if r["n"] else 0.5
    hosts = materialise(hosts.withColumn("mean", F.col("host_s") / F.col("host_n")).withColumn("above", F.lit(rate)), f"{head}-hosts")
    k_host = strength(hosts, "mean", "above", "host_n")
    both = paths.join(hosts, "host").withColumn("above", (F.col("host_s") + k_host * rate) / (F.col("host_n") + k_host)).withColumn("mean", F.col("path_s") / F.col("path_n"))
    k_path = strength(both, "mean", "above", "path_n")
    return paths, hosts.select("host", "host_n", "host_s"), {"rate": rate, "k_host": k_host, "k_path": k_path}


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """For each row of docs (doc_id, text): per label the classifier's probability, the
    host's and path's posterior without this document, and the final probability; keep."""
    known = clean_labels(labels)
    docs = docs.select("doc_id", "text", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    model = fit(docs, known)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    odds = lambda texts: sent.value.log_odds(texts) if sent.value else [np.zeros(len(texts))] * len(HEADS)
    rows = add_columns(docs, odds, ", ".join(f"odds_{h} double" for h in HEADS), ["text"]).drop("text")
    rows = rows.join(known, "doc_id", "left")
    for h in HEADS:
        rows = rows.withColumn(f"doc_{h}", 1 / (1 + F.exp(-F.col(f"odds_{h}")))).withColumn(f"ev_{h}", F.coalesce(F.col(f"label_{h}"), F.col(f"doc_{h}")))
    rows = materialise(rows, "quality-rows")
    for h in HEADS:
        paths, hosts, k = posteriors(rows, h)
        n = paths.count()
        rows = rows.join(maybe_broadcast(paths, n), ["host", "path"]).join(maybe_broadcast(hosts, n), "host")
        at_host = (F.col("host_s") - F.col(f"ev_{h}") + k["k_host"] * k["rate"]) / (F.col("host_n") - 1 + k["k_host"])
        rows = rows.withColumn(f"host_{h}", at_host)
        at_path = (F.col("path_s") - F.col(f"ev_{h}") + k["k_path"] * F.col(f"host_{h}")) / (F.col("path_n") - 1 + k["k_path"])
        rows = rows.withColumn(f"path_{h}", at_path)
        final = F.col(f"odds_{h}") + logit(F.col(f"path_{h}")) - float(np.log(k["rate"] / (1 - k["rate"]))) if k["rate"] < 1 else F.col(f"odds_{h}")
        rows = rows.withColumn(h, (1 / (1 + F.exp(-final))) if model else F.lit(0.5)).drop("path_n", "path_s", "host_n", "host_s")
    out = rows.withColumn("is_toxic", F.col("toxic") > 0.5).withColumn("keep", (F.col("quality") >= 0.5) & ~F.col("is_toxic"))
    return out.select("doc_id", *[c for h in HEADS for c in (f"label_{h}", f"doc_{h}", f"host_{h}", f"path_{h}", h)], "is_toxic", "keep")
