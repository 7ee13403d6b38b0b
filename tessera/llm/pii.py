"""Personal data with a skip-chain conditional random field.

Base spans come from fixed patterns (``spans``). The field adds spans that patterns miss but
the document's own context supports, such as a phone number repeated without its prefix.

Nodes are the white-space separated tokens with a digit or an at sign; all others are
outside by definition. Node potentials are logistic weights of binary shape and context
features. Neighbouring nodes share chain potentials; nodes with equal or similar tokens (same
text, same last seven digits, same local part), however distant, share skip potentials,
linked each to the next such node so that edges grow with the nodes. Loopy belief
propagation runs over documents of about ``NODES`` nodes at once (a longer one alone) until no
message moves by ``SETTLED``;
each round only renews the messages whose sources have moved, so a base span reaches the
last of any number of repeats. Tokens of base spans are clamped to
their kind, and what they say spreads along skip edges. A token is added if its marginal
for one kind is at least ``SURE``.

The field is trained piecewise on base spans over all documents: Spark counts distinct
(features, label) patterns and label pairs on edges; the weights are fitted to all of these
counts by Newton steps, whose sums are taken on the driver for up to ``HELD`` patterns and in
Spark beyond, with equal results. A token without a base label that a skip edge links to one with a label counts as unknown
there, not as outside.

Defined cases: null text is empty; base spans are always kept as they are; an added span
never overlaps one of a base kind; repeated rows give equal results; an empty table gives
an empty result; further columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import TextsOf, add_columns, materialise
from tessera.llm.spans import PERSONAL, base_spans, luhn

LABELS = ("none", *PERSONAL)
#: Feature patterns that the driver holds at most; nodes and edges worked on at once.
HELD, NODES, EDGES = 50_000, 20_000, 100_000
SURE, DAMP, SETTLED = 0.9, 0.5, 1e-4
#: A message renewed more often than this swings on a loop: from there on its steps shrink.
SWINGS, SHRINK = 200, 0.98
STRONGEST = 4.0
#: Like tokens far apart share labels at least, and unlike ones at most, by these log-potentials.
LIKE, UNLIKE = 6.0, -6.0
NEAR = 2  # tokens between chain neighbours at most
# Starts only where a token starts, and possessive, so that no run is tried twice.
_SITE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
# Words that announce a kind.
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write", "reply"),
    "ip": ("ip", "host", "server", "address", "addr", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "amex", "payment"),
    "phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "whatsapp"),
}
SIZES = (1, 4, 7, 8, 10, 11, 12, 14, 16, 17, 20)


@dataclass
class Nodes:
    """The nodes of one text."""

    start: np.ndarray
    end: np.ndarray
    bits: np.ndarray
    label: np.ndarray
    keys: list[tuple]
    gap: np.ndarray
    spans: list[tuple[int, int, str]]


def token_features(token: str) -> tuple[list[bool], str]:
    digits = "".join(c for c in token if "0" <= c <= "9")
    n, dots, dashes = len(digits), token.count("."), token.count("-")
    out = [lo <= n < hi for lo, hi in zip(SIZES, (*SIZES[1:], 1 << 60), strict=True)]
    out += ["@" in token, token.count("@") == 1 and 0 < token.find("@") < token.rfind("."), dots == 1, dots == 2, dots == 3, dots > 3]
    out += [dashes == 1, dashes == 2, dashes > 2, "(" in token or ")" in token, "+" in token, token.startswith("+"), n == len(token), any(c.isalpha() for c in token), 14 <= n <= 19 and luhn(digits)]
    return out, digits


def nodes_of(text: str) -> Nodes:
    """Nodes of a text with their features, base labels, keys and the base spans."""
    starts, ends, rows, keys = [], [], [], []
    spans = base_spans(text, PERSONAL)
    for m in _SITE.finditer(text):
        token = m[0].strip(",;:!?\"'<>[]{}#%&*$.")
        if not token:
            token = m[0]
        at = m.start() + m[0].find(token)
        shape, digits = token_features(token)
        before = text[max(0, m.start() - 24) : m.start()].lower().split()
        cue = before[-1].strip(",;:.!?\"'()") if before else ""
        starts.append(at)
        ends.append(at + len(token))
        rows.append(shape + [cue in words for words in CUES.values()])
        own = [("text", token.lower())]
        if len(digits) >= 7:
            own.append(("digits", digits[-7:]))
        if "@" in token:
            own.append(("local", token.split("@")[0].lower()))
        keys.append(tuple(own))
    n = len(starts)
    start, end = np.array(starts, np.int64), np.array(ends, np.int64)
    shape = np.array(rows, bool).reshape(n, TOKEN_WIDE)
    # the neighbours' sizes and plus signs are context too
    gap = np.full(n, 1 << 30)
    for k in range(1, n):
        gap[k] = text.count(" ", end[k - 1], start[k]) if start[k] - end[k - 1] < 40 else 1 << 30
    near = gap <= NEAR
    wide = len(SIZES)
    side = np.zeros((n, 2 * (wide + 1)), bool)
    if n:
        part = np.hstack([shape[:, :wide], shape[:, wide + 11 : wide + 12]])
        side[1:, : wide + 1] = part[:-1] & near[1:, None]
        side[:-1, wide + 1 :] = part[1:] & near[1:, None]
    label = np.zeros(n, np.int64)
    for s, e, kind in spans:
        lo, hi = np.searchsorted(end, s, "right"), np.searchsorted(start, e)
        label[lo:hi] = LABELS.index(kind)
    return Nodes(start, end, np.hstack([shape, side]), label, keys, gap, spans)


TOKEN_WIDE = len(SIZES) + 15 + len(CUES)
WIDE = TOKEN_WIDE + 2 * (len(SIZES) + 1)


def edges_of(nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """Chain and skip edges (pairs of node numbers), each node to the next like it."""
    near = np.flatnonzero(nodes.gap <= NEAR)
    last: dict[tuple, int] = {}
    skip = set()
    for k, keys in enumerate(nodes.keys):
        for key in keys:
            if key in last:
                skip.add((last[key], k))
            last[key] = k
    return np.stack([near - 1, near], 1), np.array(sorted(skip), np.int64).reshape(-1, 2)


@dataclass
class Field:
    weights: np.ndarray  # features and a constant by labels
    chain: np.ndarray  # labels by labels
    skip: np.ndarray

    @classmethod
    def fit(cls, sums, pairs: dict[str, np.ndarray]) -> Field:
        """sums: weights -> ``newton_sums`` over all patterns; pairs: counts of label pairs."""
        weights = np.zeros((WIDE + 1, len(LABELS)))
        weights[:, 1:] = newton(sums)
        # counts say little about rare kinds: like tokens are held to be one entity
        skip = association(pairs["skip"])
        skip = np.where(np.eye(len(LABELS), dtype=bool), np.maximum(skip, LIKE), np.minimum(skip, UNLIKE))
        return cls(weights, association(pairs["chain"]), skip)

    def marginals(self, bits: np.ndarray, label: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Beliefs of loopy propagation; nodes with a base label are clamped to it."""
        score = np.hstack([bits, np.ones((len(bits), 1))]) @ self.weights
        held = label > 0
        score[held] = -60.0
        score[held, label[held]] = 0.0
        return propagate(score, [(chain, self.chain), (skip, self.skip)])


def newton_sums(patterns: list[bytes], n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradients and curvatures, in one row, of each kind's logistic regression against
    outside. patterns: packed features; n: their counts by label; w: weights by kind."""
    x = np.unpackbits(np.frombuffer(b"".join(patterns), np.uint8).reshape(len(patterns), -(-WIDE // 8)), axis=1)[:, :WIDE]
    x = np.hstack([x, np.ones((len(x), 1))])
    out = []
    for k in range(w.shape[1]):
        p, all_ = 1 / (1 + np.exp(-np.clip(x @ w[:, k], -30, 30))), n[:, 0] + n[:, k + 1]
        out += [x.T @ (n[:, k + 1] - all_ * p), ((x * (all_ * p * (1 - p))[:, None]).T @ x).ravel()]
    return np.concatenate(out)


def newton(sums, ridge: float = 1.0) -> np.ndarray:
    wide, kinds = WIDE + 1, len(LABELS) - 1
    w = np.zeros((wide, kinds))
    for _ in range(40):
        parts = sums(w).reshape(kinds, wide * (wide + 1))
        steps = [np.linalg.solve(p[wide:].reshape(wide, wide) + ridge * np.eye(wide), p[:wide] - ridge * w[:, k]) for k, p in enumerate(parts)]
        step = np.stack(steps, 1)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def association(n: np.ndarray) -> np.ndarray:
    """Log of how much more often two labels share an edge than by chance, symmetric."""
    n = n + n.T + 0.5
    p = n / n.sum()
    own = p.sum(1)
    return np.clip(np.log(p / own[:, None] / own[None, :]), -STRONGEST, STRONGEST)


def propagate(score: np.ndarray, kinds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Damped sum-product in the log domain until it has settled. A round renews all messages
    at once that still move or whose source has moved."""
    a = np.concatenate([np.concatenate([e[:, 0], e[:, 1]]) for e, _ in kinds])
    b = np.concatenate([np.concatenate([e[:, 1], e[:, 0]]) for e, _ in kinds])
    back = np.concatenate([base + np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))]) for (e, _), base in zip(kinds, np.cumsum([0, *[2 * len(e) for e, _ in kinds[:-1]]]), strict=True)])
    table, of = np.stack([t for _, t in kinds]), np.repeat(np.arange(len(kinds)), [2 * len(e) for e, _ in kinds])
    leaving = np.argsort(a, kind="stable")  # the messages of node k: leaving[first[k]:first[k + 1]]
    first = np.searchsorted(a[leaving], np.arange(len(score) + 1))
    message, renewed = np.full((len(a), score.shape[1]), -np.log(score.shape[1])), np.zeros(len(a), np.int64)
    belief = score.copy()
    live = np.arange(len(a))
    while len(live):
        step = np.empty((len(live), score.shape[1]))
        for k in range(0, len(live), EDGES):  # the sources' beliefs stay as they are until all are renewed
            some = live[k : k + EDGES]
            out = belief[a[some]] - message[back[some]]
            new = logsumexp(out[:, :, None] + table[of[some]], 1)
            new -= logsumexp(new, 1)[:, None]
            step[k : k + EDGES] = (new - message[some]) * ((1 - DAMP) * SHRINK ** np.maximum(renewed[some] - SWINGS, 0))[:, None]
        renewed[live] += 1
        message[live] += step
        np.add.at(belief, b[live], step)
        live = live[np.abs(step).max(1) > SETTLED]
        node = np.unique(b[live])
        n = first[node + 1] - first[node]
        live = np.union1d(live, leaving[np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    return np.exp(belief - logsumexp(belief, 1)[:, None])


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def count_patterns(docs: DataFrame) -> DataFrame:
    """(what, pattern, a, b, n): features by label, and label pairs by edge, over all docs."""
    schema = pa.schema([("what", pa.string()), ("pattern", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            seen: dict[tuple, int] = {}
            for text in batch.column(0):
                nodes = nodes_of(text.as_py() or "")
                chain, skip = edges_of(nodes)
                known = np.ones(len(nodes.label), bool)
                for a, b in ((0, 1), (1, 0)):
                    known[skip[nodes.label[skip[:, a]] > 0, b]] = False
                known |= nodes.label > 0
                for bits, label in zip(np.packbits(nodes.bits[known], axis=1), nodes.label[known], strict=True):
                    key = ("node", bits.tobytes(), int(label), 0)
                    seen[key] = seen.get(key, 0) + 1
                for name, edges in (("chain", chain), ("skip", skip)):
                    for a, b in nodes.label[edges[known[edges].all(1)]]:
                        key = (name, b"", int(a), int(b))
                        seen[key] = seen.get(key, 0) + 1
            columns = [list(c) for c in zip(*[(*k, v) for k, v in seen.items()], strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return docs.select("text").mapInArrow(run, "what string, pattern binary, a int, b int, n long").groupBy("what", "pattern", "a", "b").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Field:
    counts = materialise(count_patterns(docs), "pii-counts")
    pairs = {name: np.zeros((len(LABELS), len(LABELS))) for name in ("chain", "skip")}
    for r in counts.filter("what <> 'node'").collect():
        pairs[r.what][r.a, r.b] = r.n
    by = [F.sum(F.when(F.col("a") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(LABELS))]
    patterns = materialise(counts.filter("what = 'node'").groupBy("pattern").agg(*by), "pii-patterns")
    if patterns.count() > HELD:
        return Field.fit(lambda w: summed(patterns, w), pairs)
    rows = patterns.toArrow()
    held, n = rows["pattern"].to_pylist(), counts_of(rows)
    return Field.fit(lambda w: newton_sums(held, n, w), pairs)


def counts_of(rows) -> np.ndarray:
    return np.stack([rows[f"n{k}"].to_numpy().astype(float) for k in range(len(LABELS))], 1) if rows.num_rows else np.zeros((0, len(LABELS)))


def summed(patterns: DataFrame, w: np.ndarray) -> np.ndarray:
    """``newton_sums`` over a table of patterns."""

    def run(batches):
        out = None
        for batch in batches:
            part = newton_sums(batch["pattern"].to_pylist(), counts_of(pa.Table.from_batches([batch])), w)
            out = part if out is None else out + part
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["v"])

    parts = patterns.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("k", "v"))
    rows = parts.groupBy("k").agg(F.sum("v").alias("v")).toArrow().sort_by("k")
    return rows["v"].to_numpy()


def plausible(text: str, kind: str) -> bool:
    """Whether an added span has what its kind can't be without."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return "@" in text if kind == "email" else text.count(".") == 3 and len(digits) >= 4


def find(texts: list, field: Field) -> list[list[tuple[int, int, str, bool]]]:
    """(start, end, kind, base) of each text, by start, then in the order of kinds."""
    out, waiting, parts, n = [], [], [], 0
    for text in texts:
        waiting.append(text or "")
        parts.append(nodes_of(text or ""))
        n += len(parts[-1].start)
        if n >= NODES:
            out += settled(waiting, parts, field)
            waiting, parts, n = [], [], 0
    return out + settled(waiting, parts, field)


def settled(texts: list[str], parts: list[Nodes], field: Field) -> list[list[tuple[int, int, str, bool]]]:
    first = np.cumsum([0, *[len(p.start) for p in parts]])
    edges = [edges_of(p) for p in parts]
    chain, skip = (np.concatenate([e[k] + f for e, f in zip(edges, first[:-1], strict=True)]) if parts else np.zeros((0, 2), np.int64) for k in (0, 1))
    if first[-1]:
        belief = field.marginals(np.concatenate([p.bits for p in parts]), np.concatenate([p.label for p in parts]), chain.astype(np.int64), skip.astype(np.int64))
    out = []
    for k, p in enumerate(parts):
        found = [(s, e, kind, True) for s, e, kind in p.spans]
        own = belief[first[k] : first[k + 1]] if first[-1] else np.zeros((0, len(LABELS)))
        best = own.argmax(1)
        sure = (best > 0) & (p.label == 0) & (own.max(1, initial=0) >= SURE)
        open_ = None  # neighbours that make up one phone number are one span
        for i in np.flatnonzero(sure):
            if open_ and open_[3] == i - 1 and LABELS[best[i]] == LABELS[open_[2]] == "phone" and p.gap[i] <= 1 and sum(map(texts[k][open_[0] : p.end[i]].count, "0123456789")) <= 15:
                open_ = (open_[0], int(p.end[i]), best[i], i)
                found[-1] = (open_[0], open_[1], LABELS[best[i]], False)
            else:
                open_ = (int(p.start[i]), int(p.end[i]), best[i], i)
                found.append((open_[0], open_[1], LABELS[best[i]], False))
        found = [x for x in found if x[3] or plausible(texts[k][x[0] : x[1]], x[2])]
        out.append(sorted(found, key=lambda x: (x[0], PERSONAL.index(x[2]), x[1])))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """docs with found: array of (start, end, kind, base), code points, end exclusive."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))

    def make(texts):
        return [[[{"start": s, "end": e, "kind": k, "base": b} for s, e, k, b in own] for own in find(TextsOf(texts), sent.value)]]

    return add_columns(docs, make, "found array<struct<start long, end long, kind string, base boolean>>", ["text"])
