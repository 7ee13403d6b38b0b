"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are compared exactly in tiles: exclusive-or and bit counts in numpy,
rows sorted by population count, so that tiles whose counts differ by more than the radius
are skipped. To keep tiles few, 64 bits are cut into ``radius + 1 + extra`` parts: two
fingerprints within the radius agree on at least ``1 + extra`` parts, so tiles are formed
among fingerprints that share these; ``extra`` grows with the number of fingerprints, and
no link is lost for any. A group larger than a tile is dealt into tiles by population count
and hash, and every pair of its tiles within the radius is compared. A tile yields its local
components as stars, never its pairs; stars are joined by ``components``.

Defined cases: null or blank text has the fingerprint zero and links like any other; texts
of fewer words than a shingle are one shingle; null doc_ids count as the largest, and a
component of only these has a null component_id; repeated rows are copies of each other; an
empty table gives an empty result; other columns are not read, or pass through ``keep_one``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import add_columns, materialise
from tessera.llm.components import components

WORDS, SEED, RADIUS = 4, 42, 4
TILE, STRIP = 8192, 256
#: Groups of fingerprints that share their parts are to hold about this many on average.
GROUP = 4096
NO_ID = 2**63 - 1
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, size: int = WORDS) -> int:
    """64 bits, as a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        h = [digest(joined, SEED)]
    else:
        h = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]
    values = np.array(h, np.uint64)
    count = np.zeros(64, np.int64)
    for k in range(0, len(values), 65_536):
        count += np.unpackbits(values[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(values), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = WORDS, name: str = "fp") -> DataFrame:
    """docs with the column ``name``."""
    return add_columns(docs, lambda texts: [[fingerprint(t.as_py(), size) for t in texts]], f"{name} long", ["text"])


def parts_of(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """Lists of (shift, width): the keys by which n fingerprints are grouped."""
    for extra in range(4):
        parts = radius + 1 + extra
        width = [64 // parts + (k < 64 % parts) for k in range(parts)]
        places = [(sum(width[:k]), width[k]) for k in range(parts)]
        keys = [list(x) for x in combinations(places, 1 + extra)]
        if n / 2 ** sum(w for _, w in keys[-1]) <= GROUP:
            break
    return keys


def key_column(parts: list[tuple[int, int]]):
    out, at = F.lit(0).cast("long"), 0
    for shift, width in parts:
        piece = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(piece, at))
        at += width
    return out


def local_roots(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """a, b: the fingerprints of two tiles (b None: of one with itself). Each fingerprint
    that links to another, and the smallest that links reach from it inside these tiles."""
    both = a if b is None else np.concatenate([a, b])
    count = np.bitwise_count(both.view(np.uint64)).astype(np.int16)
    root = np.arange(len(both))
    left = np.argsort(count[: len(a)], kind="stable")
    right = left if b is None else len(a) + np.argsort(count[len(a) :], kind="stable")
    x, y = both[left], both[right]
    cx, cy = count[left], count[right]
    for k in range(0, len(x), STRIP):
        strip = slice(k, k + STRIP)
        low = max(np.searchsorted(cy, cx[strip][0] - radius), k if b is None else 0)
        high = np.searchsorted(cy, cx[strip][-1] + radius, "right")
        for j in range(low, high, TILE):
            at = slice(j, min(j + TILE, high))
            i1, i2 = np.nonzero(np.bitwise_count((x[strip, None] ^ y[None, at]).view(np.uint64)) <= radius)
            i1, i2 = left[k + i1], right[j + i2]
            while True:
                r1, r2 = root[i1], root[i2]
                apart = r1 != r2
                if not apart.any():
                    break
                i1, i2 = i1[apart], i2[apart]
                low_, high_ = np.minimum(r1[apart], r2[apart]), np.maximum(r1[apart], r2[apart])
                np.minimum.at(root, high_, low_)
                while (root != root[root]).any():
                    root = root[root]
    # the root of each set is its smallest fingerprint
    order = np.lexsort((both, root))
    start = np.unique(root[order], return_index=True)[1]
    size = np.diff(np.append(start, len(both)))
    least = np.repeat(both[order][start], size)
    away = least != both[order]
    return both[order][away], least[away]


def compare_tiles(batches, radius: int):
    """Batches of (key, pair, side, fp), sorted by key and pair: edges (a, b) of each tile pair."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest = [np.zeros(0, np.int64)] * 4

    def work(columns):
        key, pair, side, fp = columns
        a, b = [], []
        if len(key):
            new = np.flatnonzero((np.diff(key) != 0) | (np.diff(pair) != 0)) + 1
            for lo, hi in zip([0, *new], [*new, len(key)], strict=True):
                if hi - lo > 1:
                    one = side[lo:hi] == 0
                    x, y = fp[lo:hi][one], fp[lo:hi][~one]
                    if len(x):
                        p, q = local_roots(x, y if len(y) else None, radius) if len(x) > 1 or len(y) else ((), ())
                        a.append(p)
                        b.append(q)
        make = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([make(a), make(b)], schema=schema)

    for batch in batches:
        have = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns, strict=True)]
        key, pair = have[0], have[1]
        if len(key):
            last = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))
            cut = last[-1] + 1 if len(last) else 0
            rest = [c[cut:] for c in have]
            if cut:
                yield work([c[:cut] for c in have])
    yield work(rest)


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """fps: distinct fp. Edges (a, b) whose components are those of all links."""
    keys = parts_of(fps.count(), radius)
    spread = fps.select("fp", F.bit_count("fp").cast("long").alias("ones"), F.posexplode(F.array(*[key_column(p) for p in keys])).alias("part", "value"))
    spread = spread.select("fp", "ones", F.xxhash64("part", "value").alias("key"))
    # groups that share a 64-bit hash by chance are compared together, which is still exact
    sizes = spread.groupBy("key", "ones").agg(F.count("*").alias("n"))
    large = sizes.groupBy("key").agg(F.sum("n").alias("total"), F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).alias("cuts"))).alias("tiles")).filter(F.col("total") > tile).select("key", "tiles")
    large = materialise(large, "tiles")
    if large.isEmpty():
        rows = spread.select("key", F.lit(0).cast("long").alias("pair"), F.lit(0).cast("long").alias("side"), "fp")
    else:
        # a tile is a population count and a cut; a pair is numbered by both tiles
        joined = spread.join(large, "key", "left")
        cut = F.expr("pmod(xxhash64(fp), element_at(filter(tiles, t -> t.ones = ones), 1).cuts)")
        near = F.expr(f"flatten(transform(filter(tiles, t -> abs(t.ones - ones) <= {radius}), t -> transform(sequence(0L, t.cuts - 1L), c -> t.ones * 1000000000L + c)))")
        split = joined.filter("tiles is not null").withColumn("own", F.col("ones") * 1_000_000_000 + cut).withColumn("other", F.explode(near))
        split = split.select("key", F.xxhash64(F.least("own", "other"), F.greatest("own", "other")).alias("pair"), (F.col("own") > F.col("other")).cast("long").alias("side"), "fp")
        rows = joined.filter("tiles is null").select("key", F.lit(0).cast("long").alias("pair"), F.lit(0).cast("long").alias("side"), "fp").unionByName(split)
    return rows.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(lambda batches: compare_tiles(batches, radius), "a long, b long")


def clusters(docs: DataFrame, size: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id, id and component (never null; null ids count as the largest)."""
    rows = fingerprints(docs.select("doc_id", "text"), size).select("doc_id", "fp", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    rows = materialise(rows, "simhash")
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("id")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius))
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("id").alias("component"))
    linked = materialise(linked.join(least, "root").select("fp", "root", "component"), "simhash-roots")
    out = rows.join(linked, "fp")
    return out.withColumn("component_id", F.when(F.col("component") < NO_ID, F.col("component")))


def keep_one(docs: DataFrame, size: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that are the first of their component, by doc_id; of rows that
    repeat a first doc_id, or have none, one stays for each component."""
    found = clusters(docs, size, radius)
    first = materialise(found.filter("id = component").groupBy("id").agg(F.count("*").alias("n")), "simhash-first")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    once = first.filter((F.col("n") == 1) & (F.col("id") < NO_ID)).select("id")
    out = docs.withColumn("_id", key).join(once.withColumnRenamed("id", "_id").hint("shuffle_hash"), "_id", "left_semi")
    many = first.filter((F.col("n") > 1) | (F.col("id") == NO_ID)).select("id")
    if not many.isEmpty():
        roots = found.filter("id = component").select("id", "fp", "root").distinct().join(many, "id")
        again = fingerprints(docs.withColumn("_id", key).join(many.withColumnRenamed("id", "_id"), "_id", "left_semi"), size, "_fp")
        again = again.join(roots.select(F.col("id").alias("_id"), F.col("fp").alias("_fp"), F.col("root").alias("_root")), ["_id", "_fp"])
        out = out.unionByName(again.dropDuplicates(["_id", "_root"]).drop("_fp", "_root"))
    return out.select(*docs.columns)
