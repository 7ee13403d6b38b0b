"""Language identification with interpolated Kneser-Ney character models.

Text is lower-cased, runs of what isn't a letter become one space, and characters are hashed
to 12 bits, so a four-gram packs into one integer. Spark sums the four-grams of all training
documents per language; counts, discounts and Kneser-Ney probabilities of all orders follow
from the whole of that table. The model is one sorted array of packed grams per order, with
the log-probability in each language that has seen the gram, and back-off weights likewise for
contexts; in all other languages a gram backs off to the next order. The language with the lowest cross-entropy per
character is chosen. A text is rejected if its cross-entropy lies above its language's mean
by more than a gap, and for short texts by a further part that falls with the square root of
the length. Every text is scored once; means and gaps are then taken over all training
documents of a language, from counts of binned distances, so that mixed and noisy text of a
known language stays and text of none goes.

Bounds: the model holds every gram of every language, so it grows with the distinct four-grams
of a language, not with documents or with languages times grams. Letters from U+0800 on share
2,048 codes, so large scripts are told apart by sequences of these, with some loss.

Defined cases: null text, or text without letters, is ``und`` with score 0 and rejected;
rows with null lang or null doc_id aren't learned from; repeated rows count each time;
with nothing to learn from all is ``und`` and nothing is rejected; ties go to the first
language by code point; further columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import TextsOf, add_columns, discard, materialise

ORDER, BITS = 4, 12
SPACE = 32
LANG_BITS = 63 - ORDER * BITS
CHUNK = 1 << 18
#: The gap is this many times that of the farthest training texts but one in a thousand, in
#: steps of STEP nats, and at least LEAST_GAP nats a character.
MARGIN, TAIL, LEAST_GAP, STEP = 2.0, 0.999, 1.25, 1 / 1024
#: From this length on a text's cross-entropy counts as settled.
LONG = 200
TOP = 0x110000

_codes: list[np.ndarray] = []


def code_table() -> np.ndarray:
    """Code point -> 12-bit code; space for all that isn't a letter."""
    if not _codes:
        point = np.arange(TOP)
        letter = np.fromiter(map(str.isalpha, map(chr, range(TOP))), bool, TOP)
        _codes.append(np.where(letter, np.where(point < 2048, point, 2048 + point % 2048), SPACE).astype(np.uint16))
    return _codes[0]


def encode(text: str | None) -> np.ndarray:
    """Codes of the letters, one space before, between and after words; empty without letters."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = code_table()[np.minimum(raw, TOP - 1)]
    blank = code == SPACE
    if blank.all():
        return np.zeros(0, np.uint16)
    keep = np.ones(len(code), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[0] = not blank[0]
    code = code[keep]
    return np.append(code, np.uint16(SPACE)) if code[-1] != SPACE else code


def grams(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Packed four-grams ending at each character of each text, and the texts' lengths."""
    pad = np.full(ORDER - 1, SPACE, np.uint16)
    size = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate([x for c in codes for x in (pad, c)]) if codes else np.zeros(0, np.uint16)
    n = max(0, len(flat) - ORDER + 1)
    out = np.zeros(n, np.int64)
    for k in range(ORDER):
        out = (out << BITS) | flat[k : k + n]
    begin = np.concatenate([[0], np.cumsum(size + ORDER - 1)[:-1]]) if len(size) else size
    own = np.zeros(n + 1, np.int64)
    np.add.at(own, begin[size > 0], 1)
    np.add.at(own, (begin + size)[size > 0], -1)
    return out[np.cumsum(own)[:n] > 0], size


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def count_grams(train: DataFrame) -> DataFrame:
    """train: text, lang. (lang, gram, n) over all rows, summed first inside each task."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held: dict[str, list] = {}

        def merged(parts):
            key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            return key[first], np.add.reduceat(n, first) if len(first) else n

        def flush():
            for lang, parts in held.items():
                key, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n)], schema=schema)
            held.clear()

        for batch in batches:
            waiting: dict[str, tuple[list, int]] = {}

            def take(lang, codes):
                key, n = np.unique(grams(codes)[0], return_counts=True)
                held.setdefault(lang, []).append((key, n.astype(np.int64)))
                if len(held[lang]) > 16:
                    held[lang] = [merged(held[lang])]

            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                codes, size = waiting.get(lang, ([], 0))
                codes.append(code := encode(text.as_py()))
                waiting[lang] = (codes, size + len(code))
                if size + len(code) > CHUNK:
                    take(lang, waiting.pop(lang)[0])
            for lang, (codes, _) in waiting.items():
                take(lang, codes)
            if sum(len(p[0]) for parts in held.values() for p in parts) > 4_000_000:
                yield from flush()
        yield from flush()

    return train.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def lookup(keys: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Where each query stands in the sorted keys, -1 if nowhere."""
    if not len(keys):
        return np.full(len(query), -1)
    at = np.searchsorted(keys, query)
    at[at == len(keys)] = 0
    return np.where(keys[at] == query, at, -1)


@dataclass
class Rows:
    """A sparse table: for each of the sorted ``keys`` the languages that have it, with a value each."""

    keys: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, packed: np.ndarray, value: np.ndarray) -> Rows:
        """packed: sorted keys, each followed by its language in the lowest bits."""
        key = packed >> LANG_BITS
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return cls(key[first], np.append(first, len(key)), (packed & ((1 << LANG_BITS) - 1)).astype(np.int16), value.astype(np.float32))

    def find(self, query: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """(place in query, language) and value of each entry of the keys asked for."""
        at = lookup(self.keys, query)
        place = np.flatnonzero(at >= 0)
        begin = self.start[at[place]]
        n = self.start[at[place] + 1] - begin
        flat = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return (np.repeat(place, n), self.lang[flat]), self.value[flat]


@dataclass
class Model:
    """For order k: ``keys[k]`` sorted packed grams, ``logp[k]`` their log-probabilities in the
    languages that have them, ``backoff[k]`` the weights of their contexts likewise."""

    langs: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logp: dict[int, Rows] = field(default_factory=dict)
    backoff: dict[int, Rows] = field(default_factory=dict)
    unseen: np.ndarray | None = None

    @classmethod
    def fit(cls, tables: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """tables: for each language its packed grams (distinct) and their counts."""
        langs = sorted(tables)
        own = np.repeat(np.arange(len(langs)), [len(tables[x][0]) for x in langs])
        return cls.of(langs, own, *(np.concatenate([tables[x][k] for x in langs]).astype(np.int64) for k in (0, 1)))

    @classmethod
    def of(cls, langs: list[str], own: np.ndarray, key: np.ndarray, n: np.ndarray) -> Model:
        """langs: sorted; own, key, n: number of the language, packed gram and count, each pair once."""
        if len(langs) > 1 << LANG_BITS:
            raise ValueError(f"{len(langs)} languages, but {1 << LANG_BITS} can be told apart")
        self = cls(langs)
        low, wide = (1 << LANG_BITS) - 1, len(langs)
        packed = key << LANG_BITS | own
        order = np.argsort(packed)
        orders = {ORDER: (packed[order], n[order])}
        for k in range(ORDER - 1, 0, -1):  # how many characters come before each shorter gram
            orders[k] = np.unique(orders[k + 1][0] & ((1 << BITS * k + LANG_BITS) - 1), return_counts=True)
        letters = len(np.unique(orders[1][0] >> LANG_BITS))
        self.unseen = np.full(wide, -np.log(letters + 1), np.float32)
        lower_packed, lower = None, np.array([1.0 / (letters + 1)])
        for k in range(1, ORDER + 1):
            packed, n = orders[k]
            own = packed & low
            one, two = (np.bincount(own[n == x], minlength=wide) for x in (1, 2))
            cut = np.where((one > 0) & (two > 0), one / np.maximum(one + 2 * two, 1), 0.5)
            contexts, at = np.unique(packed >> BITS + LANG_BITS << LANG_BITS | own, return_inverse=True)
            total, types = np.bincount(at, n), np.bincount(at)
            weight = cut[contexts & low] * types / total
            below = lower if lower_packed is None else lower[np.searchsorted(lower_packed, packed & ((1 << BITS * (k - 1) + LANG_BITS) - 1))]
            p = np.maximum(n - cut[own], 0) / total[at] + weight[at] * below
            if k == 1:
                self.unseen[contexts & low] = np.log(weight * below)
            self.logp[k], self.backoff[k] = Rows.of(packed, np.log(p)), Rows.of(contexts, np.log(weight))
            self.keys[k] = self.logp[k].keys
            lower_packed, lower = packed, p
        return self

    def logs(self, query: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Log-probability of each packed gram's last character after the others, per language."""
        if k == 0:
            return np.repeat(self.unseen[None], len(query), 0)
        out = self.logs(query & ((1 << BITS * (k - 1)) - 1), k - 1)
        if k > 1:
            at, weight = self.backoff[k].find(query >> BITS)
            out[at] += weight
        at, logp = self.logp[k].find(query)
        out[at] = logp
        return out

    def entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (nats a character) of each text in each language, and lengths."""
        out, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        own: list[int] = []
        codes: list[np.ndarray] = []
        for k, text in enumerate(texts):
            code = encode(text)
            size[k] = len(code)
            if len(code):
                own.append(k)
                codes.append(code)
            if size[own].sum() > CHUNK:
                out[own] = self.sums(codes) / -size[own, None]
                own, codes = [], []
        if own:
            out[own] = self.sums(codes) / -size[own, None]
        return out, size

    def sums(self, codes: list[np.ndarray]) -> np.ndarray:
        """Log-probability of each text in each language; a long text is summed piece by piece."""
        query, size = grams(codes)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        out = np.zeros((len(codes), len(self.langs)))
        for piece in range(0, len(query), CHUNK):
            distinct, again = np.unique(query[piece : piece + CHUNK], return_inverse=True)
            logs = self.logs(distinct).astype(np.float64)[again]
            at = np.searchsorted(begin, np.arange(piece, piece + len(logs)), "right") - 1
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            out[at[starts]] += np.add.reduceat(logs, starts)
        return out

    def predict(self, texts: list):
        """Language, score, cross-entropy and length of each text."""
        if not self.langs:
            return [["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [0] * len(texts)]
        h, size = self.entropies(texts)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        score = 1 / np.exp(np.minimum((low[:, None] - h) * np.maximum(size, 1)[:, None], 0)).sum(1)
        named = size > 0
        lang = np.where(named, np.array(self.langs, object)[best], "und")
        return [lang.tolist(), np.where(named, score, 0.0).tolist(), [float(x) if n else None for x, n in zip(low, named, strict=True)], size]


def learned() -> Column:
    """Whether a row may be learned from."""
    return (remainder(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()


def train(docs: DataFrame) -> Model:
    """The model of the documents that may be learned from."""
    rows = docs.filter(learned()).select("text", F.col("lang").cast("string").alias("lang"))
    counts = materialise(count_grams(rows), "grams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model([])
    table = counts.select((F.array_position(F.lit(langs), F.col("lang")) - 1).alias("own"), "gram", "n").toArrow()
    discard(counts)
    return Model.of(langs, *(table[x].to_numpy() for x in ("own", "gram", "n")))


def limits(known: DataFrame) -> DataFrame:
    """known: lang, entropy and length of training texts whose language is predicted right.
    For each language the cross-entropy up to which a text is its own, and the further part
    for short texts; from counts of binned distances, so no group meets in one task."""
    mean = known.groupBy("lang").agg((F.sum(F.col("entropy") * F.col("length")) / F.sum("length")).alias("mean"))
    long, far = F.col("length") >= LONG, F.col("entropy") - F.col("mean")
    step = F.ceil(F.when(long, far).otherwise(far * F.sqrt("length")) / STEP)
    bins = known.join(F.broadcast(mean), "lang").groupBy("lang", "mean", long.alias("long"), step.alias("bin")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang", "long")
    upto = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tails = bins.withColumn("upto", upto).withColumn("all", F.sum("n").over(group)).filter(F.col("upto") >= TAIL * F.col("all"))
    tails = tails.groupBy("lang", "mean", "long").agg((F.min("bin") * STEP).alias("tail"))
    of = lambda long: F.greatest(MARGIN * F.coalesce(F.max(F.when(F.col("long") == long, F.col("tail"))), F.lit(0.0)), F.lit(LEAST_GAP if long else 0.0))
    return tails.groupBy("lang", "mean").agg(of(True).alias("gap"), of(False).alias("short")).select("lang", (F.col("mean") + F.col("gap")).alias("limit"), "short")


def apply(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score, entropy and length, each name after the prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = ("lang_pred string", "score double", "entropy double", "length long")
    return add_columns(docs, lambda texts: sent.value.predict(TextsOf(texts)), ", ".join(prefix + f for f in fields), ["text"])


def judged(docs: DataFrame, prefix: str, without: tuple[str, ...] = ()) -> DataFrame:
    """Learn from docs and score each row once; adds the columns of ``apply`` and rejected."""
    name = lambda x: F.col(prefix + x)
    model = train(docs)
    out = apply(docs, model, prefix).withColumn(f"{prefix}right", learned() & (F.col("lang").cast("string") == name("lang_pred")))
    out = materialise(out.drop(*without), "lang-scored")
    if not model.langs:
        return out.drop(f"{prefix}right").withColumn(f"{prefix}rejected", F.lit(False))
    known = out.filter(name("right")).select(name("lang_pred").alias("lang"), name("entropy").alias("entropy"), name("length").alias("length"))
    most = limits(known).select(F.col("lang").alias(f"{prefix}lang_pred"), F.col("limit").alias("_limit"), F.col("short").alias("_short"))
    beyond = name("entropy") > F.col("_limit") + F.col("_short") / F.sqrt(name("length"))
    rejected = (name("length") == 0) | F.coalesce(beyond, F.lit(False))
    out = out.join(F.broadcast(most), f"{prefix}lang_pred", "left")  # one row a language
    return out.withColumn(f"{prefix}rejected", rejected).drop("_limit", "_short", f"{prefix}right")


def identify(docs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """Learn from docs and predict each row: adds held_out, rejected and the columns of
    ``apply``; columns in ``without`` aren't handed on."""
    out = judged(docs, "", without)
    return out.withColumn("held_out", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs that aren't rejected, with the columns of docs."""
    return judged(docs, "_known_").filter(~F.col("_known_rejected")).select(*docs.columns)
