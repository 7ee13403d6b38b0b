"""A training corpus in five stages, each working on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns documents; all but the last return the
columns of docs. ``run`` applies them to the table documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, linededup, mixing, simhash
from tessera.llm.common import materialise
from tessera.session import table, with_package


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models know; rejected ones go."""
    return langid.keep_known(docs)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long lines that three documents share, but in the last of these."""
    out = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each source: doc_id, size, source_size, target, taken, copies."""
    return mixing.mix(docs).filter(F.col("taken") > 0).drop("h")


STAGES = [
    ("language identification", known_language),
    ("line dedup", distinct_lines),
    ("near-duplicates", first_of_near_copies),
    ("decontamination", without_benchmark),
    ("source mix", mixed_sources),
]

#: SQL has no way to say the language models and the fingerprints; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written and read again."""
    docs = table(with_package(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
