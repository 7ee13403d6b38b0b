"""Frame selections written by people: parsed on the driver, applied as joins."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import glob_to_regex
from tessera.operators.windows import numbered

FAR = 2**62


class SpecError(ValueError):
    pass


def parse_tokens(tokens: Sequence[str]) -> tuple[list[tuple[int, int]], list[str]]:
    """Inclusive ranges and what can't be read. Single numbers, lo-hi (turned round if
    needed), open ranges, and file names that end in an index."""
    ranges, odd = [], []
    for token in tokens:
        text = str(token).strip()
        if not text:
            continue
        m = re.fullmatch(r"(\d*)\s*-\s*(\d*)", text)
        if text.isdigit():
            ranges.append((int(text), int(text)))
        elif m and (m[1] or m[2]):
            lo, hi = int(m[1] or 0), int(m[2]) if m[2] else FAR
            ranges.append((min(lo, hi), max(lo, hi)))
        elif m := re.search(r"(?:^|_)(\d+)(?:\.[^./\\]*)?$", re.split(r"[/\\]", text)[-1]):
            ranges.append((int(m[1]), int(m[1])))
        else:
            odd.append(text)
    return ranges, odd


def range_table(spark: SparkSession, tokens: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(parse_tokens(tokens)[0], "lo long, hi long")


def parse_positions(tokens: Sequence[str]) -> list[tuple[str | None, int | None, int | None, str | None]]:
    """(session, lo, hi, glob) of ``session:3``, ``session:1-26``, ``session:*``, bare
    positions and globs. Positions count from 1; a reversed range is an error; a single
    letter before a colon is a drive, not a session; ``@file`` reads tokens from a file."""
    out = []
    for token in tokens:
        text = str(token).strip()
        if text.startswith("@"):
            with open(text[1:]) as f:
                out += parse_positions([x for x in f.read().split() if not x.startswith("#")])
            continue
        head, colon, rest = text.partition(":")
        session, body = (head, rest) if colon and len(head) > 1 or colon and head.isdigit() else (None, text)
        if m := re.fullmatch(r"(\d+)(?:-(\d+))?", body):
            lo, hi = int(m[1]), int(m[2] or m[1])
            if lo < 1 or hi < lo:
                raise SpecError(f"positions count from 1 and upwards: {token!r}")
            out.append((session, lo, hi, None))
        else:
            out.append((session, None, None, glob_to_regex(body)))
    return out


SPEC = "s string, lo long, hi long, g string"


def check_positions(frames: DataFrame, spec: list[tuple], session: str) -> None:
    """Only the sessions that the tokens name are counted."""
    named = sorted({s for s, *_ in spec if s is not None})
    text = F.col(session).cast("string")
    bare = [hi for s, _, hi, _ in spec if s is None and hi is not None]
    if bare and frames.select(text).distinct().limit(2).count() > 1:
        raise SpecError("a bare position needs a session where there are several")
    sizes = {}
    if named or bare:
        table = frames.sparkSession.createDataFrame([(s,) for s in named], "_s string")
        rows = frames if bare else frames.withColumn("_s", text).join(table, "_s", "left_semi")
        sizes = {r["_s"]: r["n"] for r in rows.groupBy(text.alias("_s")).agg(F.count("*").alias("n")).collect()}
    for s, _, hi, _ in spec:
        if s is not None and s not in sizes:
            raise SpecError(f"unknown session {s!r}")
        if hi is not None and hi > (sizes[s] if s is not None else sum(sizes.values())):
            raise SpecError(f"position {hi} lies beyond session {s}")


def select_positions(frames: DataFrame, include: Sequence[str], exclude: Sequence[str], session: str, item: str) -> DataFrame:
    """Frames by their rank in their session or by a pattern of their id; first what is
    included (all, if nothing is), then without what is excluded."""
    spark, parsed = frames.sparkSession, [parse_positions(tokens) for tokens in (include, exclude)]
    for spec in parsed:
        check_positions(frames, spec, session)
    tables = [spark.createDataFrame(spec, SPEC) if spec else None for spec in parsed]
    return select_in_tables(frames, *tables, session, item)


def select_in_tables(frames: DataFrame, include: DataFrame | None, exclude: DataFrame | None, session: str, item: str) -> DataFrame:
    """The same with tokens as tables: s (session, null: any), lo and hi (places from 1) or
    g (a pattern of the item). Rows that name a session meet its frames in a join on it."""
    ranked = numbered(frames.withColumn("_s", F.col(session).cast("string")), [item], "_p", by=["_s"]).withColumn("_i", F.col(item).cast("string"))

    def named(rows: DataFrame, spec: DataFrame, how: str) -> DataFrame:
        within = F.coalesce(rows["_p"].between(spec["lo"], spec["hi"]), F.rlike(rows["_i"], spec["g"]))
        return rows.join(spec, (rows["_s"] == spec["s"]) & within, how)

    def anywhere(spec: DataFrame):
        bare = spec.filter("s is null").collect()  # what a user wrote without a session
        tests = [F.col("_p").between(r.lo, r.hi) if r.lo is not None else F.rlike(F.col("_i"), F.lit(r.g)) for r in bare]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    out = ranked
    if include is not None:
        any_, spec = anywhere(include), include.filter("s is not null")
        out = out.filter(any_).unionByName(named(out.filter(~any_), spec, "left_semi"))
    if exclude is not None:
        out = named(out.filter(~anywhere(exclude)), exclude.filter("s is not null"), "left_anti")
    return out.drop("_s", "_p", "_i")


def lost_sessions(before: DataFrame, after: DataFrame, session: str, named: Sequence[str]) -> DataFrame:
    """Sessions without any frame left that no exclusion names; should be empty."""
    gone = before.select(session).distinct().join(after.select(session).distinct(), session, "left_anti")
    return gone.filter(~F.col(session).cast("string").isin(*named)) if named else gone
