"""Benchmark decontamination with training suffix arrays.

The documents are the training text. Once, they are cut into shards of about ``SHARD_WORDS``
words; words become ids of the benchmark's vocabulary, runs of fewer of these than the shortest
window match nothing and are left out, and the suffixes of what remains are sorted to the depth
of a window. The shards, words and suffix arrays, are a table in the shared folder. The
benchmark then passes over it in blocks of at most ``BLOCK_BYTES`` of text (one item is never
split), one after another: every test suffix of a block is binary-searched in every shard; its
interval there gives all places of its window, which are extended word by word to the longest
verbatim match. What is found is joined to the documents by the digest of their text, by
broadcast if it was counted to be small.

Bounds: the driver holds one block, as arrays of numbers, and the benchmark's distinct words,
which executors get too; no shard grows with the corpus, except for a longer single document.

Defined cases: null text has no words; an item of fewer than ``n`` words is one window, of
none has no window; a null item_id is written as the empty string; items that share an id
count once; repeated rows are judged alike; a document without words isn't contaminated;
empty tables give empty results or clean documents; further columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import TextsOf, discard, materialise

WINDOW = 13
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 4 << 20
#: What was found is broadcast up to this size.
FOUND_BYTES = 32 << 20
#: Letters A-Z become a-z, other ASCII but digits and letters becomes a space.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Bytes of words become 1, others 0.
IN_WORD = bytes(c != 32 for c in FOLD)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def n_words_of(text: str | None) -> int:
    """How many words ``words_of`` finds, counted by where they begin."""
    return (b" " + (text or "").encode("utf-8", "surrogatepass")).translate(IN_WORD).count(b"\0\1")


def word_count(text: Column) -> Column:
    """``n_words_of`` as a column; Spark's regexp_count makes an object of every word."""

    def count(texts: pa.Array) -> pa.Array:
        return pa.array(map(n_words_of, TextsOf(texts)), pa.int64())

    return F.arrow_udf(count, "long")(text)


def columns(words: np.ndarray, at: np.ndarray, depth: int, bits: int) -> list[np.ndarray]:
    """The ``depth`` words from each position, packed into as few sort keys as fit 62 bits."""
    each, out = max(1, 62 // bits), []
    for k in range(0, depth, each):
        key = np.zeros(len(at), np.int64)
        for d in range(k, min(k + each, depth)):
            key = (key << bits) | words[at + d]
        out.append(key)
    return out


def starts_of(parts: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows of these sorted columns begin."""
    if not len(parts[0]):
        return np.zeros(0, np.int64)
    new = np.any([p[1:] != p[:-1] for p in parts], axis=0)
    return np.flatnonzero(np.concatenate([[True], new]))


@dataclass
class Windows:
    """Distinct windows of one length: a place in the block's words, and the items that own
    each: owners[first[k]:first[k + 1]]."""

    place: np.ndarray
    first: np.ndarray
    owners: np.ndarray


@dataclass
class Tests:
    """A block of the benchmark: its words as ids, 0 after each item, and its windows by length."""

    ids: list[str]
    words: np.ndarray
    bits: int
    windows: dict[int, Windows]

    @classmethod
    def of(cls, rows: list[tuple], vocabulary: dict[bytes, int], n: int) -> Tests:
        """rows: (item_id, text)."""
        ids = sorted({"" if i is None else str(i) for i, _ in rows})
        index = {x: k for k, x in enumerate(ids)}
        own = [np.fromiter(map(vocabulary.__getitem__, w), np.int32, len(w)) for w in (words_of(t) for _, t in rows)]
        item = np.array([index["" if i is None else str(i)] for i, _ in rows], np.int64)
        length = np.array([len(w) for w in own], np.int64)
        begin = np.cumsum([0, *(length + 1)])[:-1]
        words = np.concatenate([*(x for w in own for x in (w, [0])), np.zeros(n + 1)]).astype(np.int64)
        bits = max(1, len(vocabulary).bit_length())
        windows = {}
        for size in sorted({min(n, x) for x in length.tolist() if x}):
            these = np.flatnonzero(np.minimum(length, n) == size)
            count = length[these] - size + 1
            which = np.repeat(these, count)
            at = begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            keys = columns(words, at, size, bits)
            order = np.lexsort([item[which], *keys[::-1]])
            new = starts_of([k[order] for k in keys])
            window = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
            once = starts_of([window, item[which[order]]])
            windows[size] = Windows(at[order[new]], np.searchsorted(window[once], np.arange(len(new) + 1)), item[which[order[once]]].astype(np.int32))
        return cls(ids, words, bits, windows)


def within(column: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """For each value the place it would take in column[low:high], sorted there."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        here = column[np.minimum(mid, len(column) - 1)]
        up = open_ & ((here <= value) if right else (here < value))
        low = np.where(up, mid + 1, low)
        high = np.where(open_ & ~up, mid, high)
    return low


@dataclass
class Shard:
    """Runs of vocabulary words, 0 after each, and their sorted suffixes. Run k begins at
    begin[k] and is found in document doc[k] from its word at[k] on; keys: the documents, of
    n_words words each."""

    words: np.ndarray
    suffixes: np.ndarray
    begin: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    n_words: np.ndarray
    keys: list[bytes]

    NUMBERS = ("words", "suffixes", "begin", "doc", "at", "n_words")

    @classmethod
    def of(cls, keys: list[bytes], docs: list[np.ndarray], least: int, depth: int, bits: int) -> Shard:
        length = np.array([len(d) for d in docs], np.int64)
        first = np.cumsum([0, *(length + 1)])[:-1]
        flat = np.concatenate([x for d in docs for x in (d, [0])]).astype(np.int64) if docs else np.zeros(0, np.int64)
        known = np.concatenate([[0], flat > 0, [0]]).astype(np.int8)
        start, end = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
        keep = end - start >= least
        start, size = start[keep], (end - start)[keep]
        begin = np.cumsum(np.concatenate([[0], size + 1]))[:-1]
        doc = np.searchsorted(first, start, "right") - 1
        words = np.zeros(int((size + 1).sum()), np.int64)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        words[np.repeat(begin, size) + inner] = flat[np.repeat(start, size) + inner]
        held, at = np.unique(doc, return_inverse=True)
        count = size - least + 1
        suffixes = np.repeat(begin, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        padded = np.concatenate([words, np.zeros(depth, np.int64)])
        order = np.lexsort(columns(padded, suffixes, depth, bits)[::-1]) if len(suffixes) else np.zeros(0, np.int64)
        return cls(words.astype(np.int32), suffixes[order].astype(np.int32), begin.astype(np.int32), at.astype(np.int32), (start - first[doc]).astype(np.int32), length[held].astype(np.int32), [keys[k] for k in held])

    def places(self, tests: Tests) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each window length: the index of the window and the position, for each place
        where one occurs."""
        depth, out = max(tests.windows, default=0), []
        words = np.concatenate([self.words, np.zeros(depth + 1, np.int32)]).astype(np.int64)
        suffixes = self.suffixes.astype(np.int64)
        for size, windows in tests.windows.items():
            # suffixes are in order by the first `size` words too, as they are by more
            have, want = columns(words, suffixes, size, tests.bits), columns(tests.words, windows.place, size, tests.bits)
            low, high = np.zeros(len(windows.place), np.int64), np.full(len(windows.place), len(suffixes), np.int64)
            for column, value in zip(have, want, strict=True):
                low, high = within(column, value, low, high, False), within(column, value, low, high, True)
            n = high - low
            if n.any():
                which = np.repeat(np.arange(len(n)), n)
                out.append((size, which, suffixes[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]))
        return out

    def search(self, tests: Tests) -> list[tuple]:
        """(key, number of words, hit word positions, items, length, item and position of the
        longest match) of each document with an occurrence."""
        hits: dict[int, list] = {}
        items: dict[int, list] = {}
        longest: dict[int, tuple] = {}
        covered = np.zeros(len(self.words) + 1, np.int64)
        found = self.places(tests)
        for size, which, place in found:
            windows = tests.windows[size]
            np.add.at(covered, place, 1)
            np.add.at(covered, place + size, -1)
            run = np.searchsorted(self.begin, place, "right") - 1
            doc = self.doc[run]
            pair = np.unique(which * len(self.keys) + doc)
            for w, d in zip((pair // len(self.keys)).tolist(), (pair % len(self.keys)).tolist(), strict=True):
                items.setdefault(d, []).extend(windows.owners[windows.first[w] : windows.first[w + 1]].tolist())
            reach, alive = np.full(len(place), size), np.arange(len(place))
            while len(alive):
                a, b = place[alive] + reach[alive], windows.place[which[alive]] + reach[alive]
                alive = alive[(self.words[a] == tests.words[b]) & (self.words[a] > 0)]
                reach[alive] += 1
            best = np.lexsort((place, -reach, doc))
            for i in best[np.unique(doc[best], return_index=True)[1]]:
                if reach[i] > longest.get(int(doc[i]), (0,))[0]:
                    longest[int(doc[i])] = (int(reach[i]), tests.ids[windows.owners[windows.first[which[i]]]], int(self.at[run[i]] + place[i] - self.begin[run[i]]))
        if found:
            at = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
            run = np.searchsorted(self.begin, at, "right") - 1
            doc, word = self.doc[run], self.at[run] + at - self.begin[run]
            for d, part in zip(*split(doc, word), strict=True):
                hits[d] = part
        return [(self.keys[d], int(self.n_words[d]), hits[d].tolist(), sorted({tests.ids[i] for i in items[d]}), *longest[d]) for d in sorted(hits)]


def split(key: np.ndarray, value: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    order = np.argsort(key, kind="stable")
    own, first = np.unique(key[order], return_index=True)
    return own.tolist(), np.split(value[order], first[1:])


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def shards(docs: DataFrame, vocabulary, least: int, depth: int) -> DataFrame:
    """The suffix arrays of docs (text), a row a shard; vocabulary: a broadcast dict."""
    kinds = [*[(n, pa.binary()) for n in Shard.NUMBERS], ("keys", pa.list_(pa.binary()))]

    def run(batches):
        words, keys, held, size = vocabulary.value, [], [], 0
        bits = max(1, len(words).bit_length())

        def made():
            one = Shard.of(keys, held, least, depth, bits)
            values = [[getattr(one, n).tobytes()] for n in Shard.NUMBERS] + [[one.keys]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, kinds, strict=True)], names=[n for n, _ in kinds])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                own = words_of(text.as_py())
                own = np.fromiter(map(words.get, own, repeat(0)), np.int32, len(own))
                if not own.any():
                    continue
                keys.append(key.as_py())
                held.append(own)
                size += len(own) + 1
                if size >= SHARD_WORDS:
                    yield made()
                    keys, held, size = [], [], 0
        if keys:
            yield made()

    fields = ", ".join(f"{n} binary" for n in Shard.NUMBERS) + ", keys array<binary>"
    return docs.select(digest(F.col("text")).alias("key"), "text").mapInArrow(run, fields)


def found_in(table: DataFrame, tests: Tests) -> tuple[DataFrame, object]:
    """(key, n_words, hits, items, longest) of the documents in the shards that the block
    meets, and the broadcast that holds the block."""
    sent = table.sparkSession.sparkContext.broadcast(tests)
    kinds = [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32(), pa.string(), pa.int32()]
    names = ["key", "n_words", "hits", "items", "length", "item", "at"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                numbers = [np.frombuffer(batch.column(n)[k].as_py(), np.int32) for n in Shard.NUMBERS]
                rows = Shard(*numbers, batch.column("keys")[k].as_py()).search(sent.value)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return table.mapInArrow(run, "key binary, n_words int, hits array<int>, items array<string>, length int, item string, at int"), sent


def occurrences(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """key (digest of the text), n_words, hits, items and the longest match, for each distinct
    text of docs in which a window of the benchmark occurs."""
    spark = docs.sparkSession

    def words_in(batches):
        for batch in batches:
            seen = {w for t in batch.column(0) for w in words_of(t.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.binary())], names=["word"])

    vocabulary = benchmark.select("text").mapInArrow(words_in, "word binary").distinct().toArrow()["word"].to_pylist()
    vocabulary = {w: k for k, w in enumerate(sorted(vocabulary), 1)}
    sizes = benchmark.select(F.octet_length("text").alias("bytes"), word_count(F.col("text")).alias("n"))
    sizes = sizes.agg(F.sum("bytes").alias("bytes"), F.min(F.when(F.col("n") > 0, F.col("n"))).alias("least")).first()
    blocks = -(-(sizes["bytes"] or 0) // BLOCK_BYTES) or 1
    rows = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    rows = materialise(rows, "tests", by=("block",))
    words = spark.sparkContext.broadcast(vocabulary)
    table = materialise(shards(docs, words, min(n, sizes["least"] or n), n), "suffix-arrays")
    words.destroy()
    out = None
    for k in range(blocks):
        block = rows.filter(F.col("block") == k).select("item_id", "text").collect()
        one, sent = found_in(table, Tests.of([tuple(r) for r in block], vocabulary, n))
        one = materialise(one, "found")
        sent.destroy()
        out = one if out is None else out.unionByName(one)
    discard(table)
    best = F.max(F.struct("length", "item", "at"))
    texts = out.groupBy("key", "n_words", "hits", "items").agg(best.alias("longest")) if blocks > 1 else out.groupBy("key", "n_words").agg(F.first("hits").alias("hits"), F.first("items").alias("items"), best.alias("longest"))
    if blocks > 1:
        texts = texts.groupBy("key", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    return texts


def mark(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs with n_words, hits (word positions inside an occurrence of a window), items
    (sorted as strings), longest, longest_item, longest_at and contaminated."""
    found = materialise(occurrences(docs, benchmark, n), "contaminated")
    found = found.select(F.col("key").alias("_key"), F.col("hits").alias("_hits"), F.col("items").alias("_items"), F.col("longest").alias("_longest"))
    size = found.agg(F.sum(64 + 4 * F.size("_hits") + F.length(F.array_join("_items", ",")) * 2)).first()[0] or 0
    rows = docs.withColumns({"n_words": word_count(F.col("text")), "_key": digest(F.col("text"))}).join(F.broadcast(found) if size <= FOUND_BYTES else found, "_key", "left")
    n_hit = F.coalesce(F.size("_hits"), F.lit(0)).cast("long")
    rows = rows.withColumn("contaminated", F.col("_hits").isNotNull() & (20 * n_hit >= F.col("n_words")))
    none = lambda kind: F.array().cast(kind)
    rows = rows.withColumns({"hits": F.coalesce("_hits", none("array<int>")), "items": F.coalesce("_items", none("array<string>")), "longest": F.coalesce("_longest.length", F.lit(0)), "longest_item": F.col("_longest.item"), "longest_at": F.col("_longest.at")})
    return rows.drop("_key", "_hits", "_items", "_longest")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents of docs that aren't contaminated, with the columns of docs."""
    found = occurrences(docs, benchmark, n).filter(20 * F.size("hits").cast("long") >= F.col("n_words"))
    found = materialise(found.select(F.col("key").alias("_key")), "contaminated")
    rows = docs.withColumn("_key", digest(F.col("text")))
    rows = rows.join(F.broadcast(found) if 64 * found.count() <= FOUND_BYTES else found, "_key", "left_anti")
    return rows.select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT item, w, least(len(w), 13) AS size FROM b WHERE len(w) > 0),
t AS (SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS win FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM q)),
s AS (SELECT DISTINCT size FROM t),
p AS (SELECT r, size, k, array_to_string(w[k:k + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d CROSS JOIN s)),
m AS (SELECT DISTINCT p.r, p.k, p.size, t.item FROM p JOIN t ON p.size = t.size AND p.win = t.win),
h AS (SELECT r, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS x FROM m) GROUP BY r),
i AS (SELECT r, count(DISTINCT item)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN i ON d.r = i.r
"""
