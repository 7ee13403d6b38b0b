"""Line dedup: sharded cuckoo filters over an exact reference-count table.

A line's key is the line, white space stripped at both ends, A-Z lower-cased, as a 128-bit
XXH3 digest. The store holds, per key, the exact number of documents and the last of them
(``counts``), the (key, document) references these come from (``refs``), and, per shard of
keys, a cuckoo filter of the keys that at least ``min_docs`` documents hold (``filters``).
Documents can be inserted and deleted again: counts of the touched keys are taken anew from
the references, and keys that cross ``min_docs`` enter or leave the filters. To dedup, lines
that miss the filter stay at once; only hits meet the exact counts, so false hits drop
nothing.

The filters always decide first. They go out in groups of at most ``FILTER_BYTES``: with one
group lines are probed where they are read; with more, the references are written once, parted
by group, and each part is probed by its own group, one after another. The exact counts of
shared keys go out too if they were counted to take at most ``KEY_BYTES``, and no text is
shuffled; else hits are joined to them, and texts to the keys they lose.

Defined cases: doc_ids are integers; null or empty text is one empty line; null doc_ids count
as one document that comes before all others; rows that repeat a doc_id are one document; a key repeated inside a
document counts once and all its lines share its fate; an empty table gives an empty result;
further columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import add_columns, discard, materialise
from tessera.llm.cuckoo import Cuckoo, built

SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
NO_ID = -(2**63)
#: Filters go to the executors in groups of this size, exact keys if they take no more than this.
FILTER_BYTES, KEY_BYTES = 32 << 20, 16 << 20
#: Lines that are looked up at once.
BLOCK = 1 << 16
KEYS_A_SHARD = 500_000
LEAST_CHARS, MIN_DOCS = 20, 3


def line_keys(text: str | None, least: int = LEAST_CHARS) -> list[bytes | None]:
    """For each line its key's digest, None for keys shorter than ``least`` code points."""
    out: list[bytes | None] = []
    digest = xxhash.xxh3_128_digest
    for line in (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(b"\n"):
        key = line.strip(SPACE)
        long = len(key) >= least and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least)
        out.append(digest(key) if long else None)
    return out


def as_pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


@dataclass
class Probe:
    """The shards' filters, as sent to the executors."""

    bits: int
    shards: dict[int, bytes]

    def hits(self, pairs: np.ndarray) -> np.ndarray:
        if not hasattr(self, "read"):
            self.read = {k: Cuckoo.read(v) for k, v in self.shards.items()}
        out = np.zeros(len(pairs), bool)
        shard = shard_of(pairs[:, 0], self.bits)
        for k in np.unique(shard):
            if (one := self.read.get(int(k))) is not None:
                at = np.flatnonzero(shard == k)
                out[at] = one.contains(pairs[at, 0], pairs[at, 1])
        return out


def shard_of(h1: np.ndarray, bits: int) -> np.ndarray:
    return ((np.ascontiguousarray(h1).view(np.uint64) >> np.uint64(40)) & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Exact:
    """Shared keys, sorted, and the last document that holds each."""

    pairs: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, last: np.ndarray) -> Exact:
        order = np.lexsort((h2, h1))
        return cls(np.stack([h1, h2], 1)[order], last[order])

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is here, and its last document."""
        found, last = np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64)
        own = np.ascontiguousarray(self.pairs[:, 0])
        at, end = np.searchsorted(own, pairs[:, 0]), np.searchsorted(own, pairs[:, 0], "right")
        while (open_ := np.flatnonzero((at < end) & ~found)).size:
            same = self.pairs[at[open_], 1] == pairs[open_, 1]
            found[open_[same]], last[open_[same]] = True, self.last[at[open_[same]]]
            at[open_] += 1
        return found, last


REFERENCE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64())])


def reference_batch(pairs: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)] + [pa.array(ids)], schema=REFERENCE)


def references(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, doc): each long key of each document, once a row of docs."""

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {k for k in line_keys(text.as_py(), least) if k}
                keys += own
                ids += [doc] * len(own)
            yield reference_batch(as_pairs(keys), np.array(ids, np.int64))

    return doc_key(docs).select("doc", "text").mapInArrow(run, "h1 long, h2 long, doc long")


def doc_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))


def count_refs(refs: DataFrame) -> DataFrame:
    """refs: distinct."""
    return refs.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))


class LineStore:
    """Counts, references and filters of a corpus; insert and delete return a new store."""

    def __init__(self, counts: DataFrame, filters: DataFrame, bits: int, refs: DataFrame, least: int, min_docs: int):
        self.counts, self.filters, self.bits, self.refs, self.least, self.min_docs = counts, filters, bits, refs, least, min_docs

    @classmethod
    def build(cls, docs: DataFrame, least: int = LEAST_CHARS, min_docs: int = MIN_DOCS) -> LineStore:
        refs = materialise(references(docs, least).distinct(), "line-refs")
        counts = materialise(count_refs(refs), "line-counts")
        shared = counts.filter(F.col("n_docs") >= min_docs).select("h1", "h2")
        bits = max(4, int(np.ceil(np.log2(max(1, shared.count() / KEYS_A_SHARD)))))

        def build(key, rows):
            one = built(rows["h1"].to_numpy(), rows["h2"].to_numpy())
            return rows.iloc[:1].assign(shard=key[0], n=len(rows), slots=[one.write()])[["shard", "n", "slots"]]

        filters = shared.withColumn("shard", shard_column(bits)).groupBy("shard").applyInPandas(build, "shard long, n long, slots binary")
        return cls(counts, materialise(filters, "line-filters"), bits, refs, least, min_docs)

    def groups(self) -> list[list[int]]:
        """The shards, in order, in groups whose filters take at most FILTER_BYTES (one at least)."""
        widest = self.filters.agg(F.max(F.octet_length("slots"))).first()[0] or 1
        each, n = max(1, FILTER_BYTES // widest), 1 << self.bits
        return [list(range(k, min(k + each, n))) for k in range(0, n, each)]

    def probe(self, shards: list[int]):
        """The filters of these shards as a broadcast."""
        rows = self.filters.filter(F.col("shard").between(shards[0], shards[-1])).select("shard", "slots").collect()
        return self.filters.sparkSession.sparkContext.broadcast(Probe(self.bits, {r.shard: bytes(r.slots) for r in rows}))

    def hits(self, refs: DataFrame) -> DataFrame:
        """Those references whose keys the filters hold, a few false ones among them."""

        def probed(part, sent):
            def run(batches):
                for batch in batches:
                    columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                    pairs = np.stack(columns[:2], 1)
                    hit = sent.value.hits(pairs)
                    yield reference_batch(pairs[hit], columns[2][hit])

            return part.select("h1", "h2", "doc").mapInArrow(run, "h1 long, h2 long, doc long")

        groups = self.groups()
        if len(groups) == 1:
            return probed(refs, self.probe(groups[0]))
        routed = refs.select("h1", "h2", "doc", F.floor(shard_column(self.bits) / len(groups[0])).cast("int").alias("part"))
        routed, out = materialise(routed, "line-routed", by=("part",)), None
        for k, shards in enumerate(groups):
            sent = self.probe(shards)
            one = materialise(probed(routed.filter(F.col("part") == k), sent), "line-hits")
            sent.destroy()
            out = one if out is None else out.unionByName(one)
        discard(routed)
        return out

    def _changed(self, refs: DataFrame, touched: DataFrame) -> LineStore:
        """The store for these references; touched: keys (h1, h2) whose counts may differ."""
        refs = materialise(refs, "line-refs")
        touched = materialise(touched.distinct(), "line-touched")
        fresh = count_refs(refs.join(touched, ["h1", "h2"], "left_semi"))
        counts = materialise(self.counts.join(touched, ["h1", "h2"], "left_anti").unionByName(fresh), "line-counts")
        many = F.col("n_docs") >= self.min_docs
        old, new = (x.filter(many).join(touched, ["h1", "h2"], "left_semi").select("h1", "h2") for x in (self.counts, counts))
        moves = new.join(old, ["h1", "h2"], "left_anti").withColumn("up", F.lit(True)).unionByName(old.join(new, ["h1", "h2"], "left_anti").withColumn("up", F.lit(False)))

        def update(key, have, move):
            one = Cuckoo.read(have["slots"].iloc[0]) if len(have) else Cuckoo.sized(0)
            n = int(have["n"].iloc[0]) if len(have) else 0
            add, gone = move[move["up"]], move[~move["up"]]
            one.delete(gone["h1"].to_numpy(), gone["h2"].to_numpy())
            fits = n + len(add) - len(gone) <= one.slots.size * 0.8 and one.insert(add["h1"].to_numpy(), add["h2"].to_numpy())
            import pandas as pd

            return pd.DataFrame({"shard": [key[0]], "n": [n + len(add) - len(gone)], "slots": [one.write()], "full": [not fits]})

        moves = moves.withColumn("shard", shard_column(self.bits))
        made = materialise(self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(update, "shard long, n long, slots binary, full boolean"), "line-filters")

        def rebuild(key, rows):
            one = built(rows["h1"].to_numpy(), rows["h2"].to_numpy())
            return rows.iloc[:1].assign(shard=key[0], n=len(rows), slots=[one.write()])[["shard", "n", "slots"]]

        full = made.filter("full").select("shard")
        again = counts.filter(many).withColumn("shard", shard_column(self.bits)).join(full, "shard", "left_semi").groupBy("shard").applyInPandas(rebuild, "shard long, n long, slots binary")
        filters = materialise(made.filter("not full").drop("full").unionByName(again), "line-filters")
        return LineStore(counts, filters, self.bits, refs, self.least, self.min_docs)

    def insert(self, docs: DataFrame) -> LineStore:
        new = references(docs, self.least).distinct().join(self.refs, ["h1", "h2", "doc"], "left_anti")
        new = materialise(new, "line-new")
        return self._changed(self.refs.unionByName(new), new.select("h1", "h2"))

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """doc_ids: a table with the column doc_id."""
        gone = doc_key(doc_ids).select("doc").distinct()
        touched = self.refs.join(gone, "doc", "left_semi").select("h1", "h2")
        return self._changed(self.refs.join(gone, "doc", "left_anti"), touched)

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with text reduced to the lines that stay, n_lines (before) and n_dropped."""
        shared = self.counts.filter(F.col("n_docs") >= self.min_docs).select("h1", "h2", "last_doc")
        groups = self.groups()
        if len(groups) == 1 and 24 * shared.count() <= KEY_BYTES:
            return self._apply_here(docs, shared, self.probe(groups[0]))
        return self._apply_joined(docs, shared)

    def _apply_here(self, docs: DataFrame, shared: DataFrame, filters) -> DataFrame:
        """Where the shared keys were counted to be few: no text moves."""
        columns = shared.toArrow()
        exact = docs.sparkSession.sparkContext.broadcast(Exact.of(*(columns[c].to_numpy() for c in ("h1", "h2", "last_doc"))))
        least = self.least

        def cut(texts, ids):
            out, ids, at = [[], [], []], ids.to_pylist(), 0
            while at < len(ids):  # blocks of texts, so that many lines are looked up at once
                first, keys, held, lines = at, [], [], []
                while at < len(ids) and (at == first or len(keys) < BLOCK):
                    text = texts[at].as_py() or ""
                    own = line_keys(text, least)
                    long = [k for k, x in enumerate(own) if x]
                    held.append((len(keys), long))
                    keys += [own[k] for k in long]
                    lines.append(text.split("\n"))
                    at += 1
                pairs = as_pairs(keys)
                maybe = np.flatnonzero(filters.value.hits(pairs)) if len(pairs) else np.zeros(0, np.int64)
                found, last = exact.value.find(pairs[maybe])
                own = np.repeat(np.array(ids[first:at], np.int64), [len(long) for _, long in held])
                gone = set(maybe[found & (own[maybe] != last)].tolist())
                for have, (base, long) in zip(lines, held, strict=True):
                    drop = {k for j, k in enumerate(long) if base + j in gone} if gone else ()
                    stay = [x for k, x in enumerate(have) if k not in drop] if drop else have
                    for column, value in zip(out, ("\n".join(stay), len(have), len(have) - len(stay)), strict=True):
                        column.append(value)
            return out

        out = add_columns(doc_key(docs), cut, "_kept string, n_lines long, n_dropped long", ["text", "doc"])
        return out.drop("doc", "text").withColumnRenamed("_kept", "text")

    def _apply_joined(self, docs: DataFrame, shared: DataFrame) -> DataFrame:
        hits = self.hits(references(docs, self.least).distinct())
        drops = hits.join(shared, ["h1", "h2"]).filter("doc <> last_doc").groupBy("doc").agg(F.collect_list("h1").alias("_d1"), F.collect_list("h2").alias("_d2"))
        joined = doc_key(docs).join(materialise(drops, "line-drops").hint("shuffle_hash"), "doc", "left").drop("doc")
        least = self.least

        def cut(texts, d1, d2):
            kept, n_lines, n_dropped = [], [], []
            for text, a, b in zip(texts.to_pylist(), d1.to_pylist(), d2.to_pylist(), strict=True):
                lines = stay = (text or "").split("\n")
                if a:
                    gone = {x.to_bytes(8, "little", signed=True) + y.to_bytes(8, "little", signed=True) for x, y in zip(a, b, strict=True)}
                    stay = [x for x, k in zip(lines, line_keys(text, least), strict=True) if k is None or k not in gone]
                kept.append("\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            return [kept, n_lines, n_dropped]

        return add_columns(joined, cut, "_kept string, n_lines long, n_dropped long", ["text", "_d1", "_d2"]).drop("_d1", "_d2", "text").withColumnRenamed("_kept", "text")


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with each line dropped that at least ``min_docs`` documents hold, but in the
    last of them; adds n_lines and n_dropped."""
    return LineStore.build(docs, least, min_docs).apply(docs)


def shard_column(bits: int):
    return F.shiftrightunsigned("h1", 40).bitwiseAND((1 << bits) - 1)


ORACLE_SQL = r"""
WITH l AS (
  SELECT row_id, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
  FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key, max(coalesce(doc_id, -9223372036854775808)) AS last_doc FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND coalesce(k.doc_id, -9223372036854775808) <> c.last_doc AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY row_id
"""
