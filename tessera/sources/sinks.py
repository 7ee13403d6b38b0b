"""Sinks: partitioned CSV, JSON and text writers, label text, COCO documents and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import polygon_area, polygon_box, yolo_line
from tessera.operators.windows import numbered


def write_csv(rows: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """CSV with a header; with ``by``, only the partitions in rows are overwritten."""
    writer = rows.write.mode(mode).option("header", True)
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.csv(path)


def union_columns(*tables: DataFrame) -> DataFrame:
    """Rows of all tables with all their columns, in the order they first appear."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_json_by_key(rows: DataFrame, path: str, key: str) -> None:
    """One JSON document a row, partitioned by its key."""
    rows.write.mode("overwrite").partitionBy(key).json(path)


def write_splits(frames: DataFrame, path: str, split: str, name: str) -> DataFrame:
    """A list of names per split, and the summary of sizes."""
    frames.select(split, F.col(name).cast("string").alias("value")).write.mode("overwrite").partitionBy(split).text(path)
    return frames.groupBy(split).agg(F.count("*").alias("n"))


def yolo_labels(instances: DataFrame, item: str, order: str, class_index: str, polygons: str, width: str, height: str) -> DataFrame:
    """Label text per item, a line a polygon of at least three points, in order. An item
    whose size is unknown is an error."""
    unknown = F.assert_true(F.col(width).isNotNull() & F.col(height).isNotNull(), F.lit("image size is unknown"))
    lines = instances.select(item, order, class_index, width, height, F.posexplode(polygons).alias("p", "polygon")).filter(F.size("polygon") >= 6)
    lines = lines.withColumn("ok", unknown).filter("ok is null").withColumn("line", yolo_line(F.col(class_index), F.col("polygon"), F.col(width).cast("double"), F.col(height).cast("double")))
    return lines.groupBy(item).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "p", "line"))), lambda x: x.line), "\n").alias("text"))


def coco_annotations(instances: DataFrame, image: str, order: str, category: str, polygons: str, score: str | None = None, per_polygon: bool = False) -> DataFrame:
    """COCO annotation rows with ids in (image, instance) order. Polygons below three points
    go, and instances without area, before ids are given. ``per_polygon``: a row a polygon,
    with its own area."""
    good = F.filter(polygons, lambda p: F.size(p) >= 6)
    rows = instances.withColumn("_p", good)
    if per_polygon:
        rows = rows.select("*", F.posexplode("_p").alias("_k", "_one")).withColumn("_p", F.array("_one")).drop("_one")
    else:
        rows = rows.withColumn("_k", F.lit(0))
    rows = rows.withColumn("area", F.aggregate(F.transform("_p", polygon_area), F.lit(0.0), lambda a, x: a + x)).filter("area > 0")
    box = polygon_box(F.flatten("_p"))
    rows = numbered(rows, [image, order, "_k"], "_id")
    columns = [F.col("_id").alias("id"), F.col(image), F.col(category), "area", F.array(box.x, box.y, box.w, box.h).alias("bbox"), F.col("_p").alias("segmentation")]
    return rows.select(*columns, *([F.col(score)] if score else []))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """old with the columns of new where a key is in both, other columns kept, new keys added."""
    renamed = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = old.join(renamed, key, "full")
    for c in columns:
        kept = F.col(c) if c in old.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), kept))
    return out.drop(*[f"_new_{c}" for c in columns])


def flatten_names(schema, prefix: str = "") -> list[tuple[str, str]]:
    """(path, dotted name) of every leaf of a nested schema."""
    from pyspark.sql import types as T

    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += flatten_names(f.dataType, f"{path}.") if isinstance(f.dataType, T.StructType) else [(path, path)]
    return out


def flatten(rows: DataFrame) -> DataFrame:
    """Nested structs as dotted columns."""
    return rows.select(*[F.col(".".join(f"`{x}`" for x in path.split("."))).alias(name) for path, name in flatten_names(rows.schema)])
