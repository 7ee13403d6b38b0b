"""The queries of these operators over the whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, html, langid, linededup, mixing, pii, quality, secrets, simhash, tiff
from tessera.llm.spans import PERSONAL, SECRET
from tessera.session import table, with_package


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(with_package(spark), sf_dir, "documents")).drop("source", "h")


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, found -> a count for each base kind, base_sha256 and spans."""
    base = F.filter("found", lambda x: x.base)
    name = lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))
    listed = lambda spans: F.array_join(F.transform(spans, name), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x.base & (x.kind == kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in kinds], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(with_package(spark), sf_dir, "documents").select("doc_id", "text")
    return span_digest(pii.scan(docs), PERSONAL)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(with_package(spark), sf_dir, "pages").select("page_id", "url", "html")
    return html.extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host", "path")


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.store_texts(table(with_package(spark), sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(with_package(spark), sf_dir, "documents").select("doc_id", "text")
    return span_digest(secrets.scan(docs), SECRET)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(with_package(spark), sf_dir, "documents").select("doc_id", "text")
    out = decontam.mark(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(with_package(spark), sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(with_package(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, without=("text",)).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.clusters(table(with_package(spark), sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(with_package(spark), sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.judge(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_personal_data": op2_personal_data,
    "op3_main_text": op3_main_text,
    "op4_tiff": op4_tiff,
    "op5_secrets": op5_secrets,
    "op6_decontaminate": op6_decontaminate,
    "op7_dedup_lines": op7_dedup_lines,
    "op8_language": op8_language,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE_SQL,
    "op6_decontaminate": decontam.ORACLE_SQL,
    "op7_dedup_lines": linededup.ORACLE_SQL,
}
