"""Stand-ins for pools, frames and instances over the star-schema tables: the same integer
expressions once as DataFrames and once as SQL, for queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import table

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as a frame pool; a supplier is a session."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("session_id"),
        *LINE_KEY,
        (F.col("l_quantity") * 10).alias("sharpness"),
        (F.col("l_discount") + 0.0).alias("clip_frac"),
        (F.col("l_tax") + 0.0).alias("dark_frac"),
        (F.col("l_linenumber") / 10.0).alias("veg_frac"),
        F.when(F.col("l_partkey") % 7 != 0, (F.col("l_partkey") % 100) / 100.0).alias("depth"),
        F.col("l_returnflag").alias("cls"),
    )


POOL_SQL = """pool AS (
  SELECT l_suppkey AS session_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity * 10 AS sharpness,
    l_discount + 0.0::DOUBLE AS clip_frac, l_tax + 0.0::DOUBLE AS dark_frac, l_linenumber / 10.0::DOUBLE AS veg_frac,
    CASE WHEN l_partkey % 7 <> 0 THEN (l_partkey % 100) / 100.0::DOUBLE END AS depth, l_returnflag AS cls FROM lineitem)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames; a user is a session, event_id the frame index."""
    return table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("idx"), "ts", "event_type", "value", "props")


def instances(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as boxes of a frame (an order); odd line numbers are the truth. ``n`` counts
    a frame's boxes of one side from 1."""
    li = table(spark, sf, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey", F.col("l_linenumber") % 2).orderBy(*LINE_KEY))
    return li.select(
        F.col("l_orderkey").alias("frame"),
        n.cast("long").alias("n"),
        (F.col("l_linenumber") % 2 == 1).alias("is_truth"),
        (F.col("l_partkey") % 20).cast("double").alias("x"),
        (F.col("l_suppkey") % 10).cast("double").alias("y"),
        (10 + F.col("l_quantity").cast("int") % 20).cast("double").alias("w"),
        (10 + F.col("l_linenumber")).cast("double").alias("h"),
        F.col("l_returnflag").alias("cls"),
        (F.col("l_discount") + 0.0).alias("score"),
        "l_quantity",
        "l_tax",
        "l_partkey",
        "l_suppkey",
    )


INSTANCES_SQL = """instances AS (
  SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)::BIGINT AS n,
    l_linenumber % 2 = 1 AS is_truth, (l_partkey % 20)::DOUBLE AS x, (l_suppkey % 10)::DOUBLE AS y, (10 + l_quantity::INT % 20)::DOUBLE AS w,
    (10 + l_linenumber)::DOUBLE AS h, l_returnflag AS cls, l_discount + 0.0::DOUBLE AS score, l_quantity, l_tax, l_partkey, l_suppkey FROM lineitem)"""

#: Overlap of the boxes a and b.
IOU_SQL = """(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)
  / (a.w * a.h + b.w * b.h - greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)))"""


def sides(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions (i) and truths (j); rows: instances, if there already."""
    rows = instances(spark, sf) if rows is None else rows
    return rows.filter(~F.col("is_truth")).withColumnRenamed("n", "i"), rows.filter("is_truth").withColumnRenamed("n", "j")


def pairs(spark: SparkSession, sf: str, least: float = 0.5, same_class: bool = False, rows: DataFrame | None = None) -> DataFrame:
    from tessera.operators.matching import instance_pairs

    pred, truth = sides(spark, sf, rows)
    return instance_pairs(pred, truth, "frame", same_class, least)


def pairs_sql(least: float = 0.5, same_class: bool = False) -> str:
    same = "AND a.cls = b.cls " if same_class else ""
    return f"""{INSTANCES_SQL},
pairs AS (SELECT a.frame, a.n AS i, b.n AS j, a.cls, b.cls AS truth_cls, a.score, {IOU_SQL} AS iou
  FROM instances a JOIN instances b ON a.frame = b.frame AND NOT a.is_truth AND b.is_truth {same}WHERE {IOU_SQL} >= {least})"""
