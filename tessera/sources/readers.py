"""Sources: pool and capture-log CSV, calibration, session metadata, annotation exports,
COCO documents, manifests, ledgers, histories and file listings, all with explicit schemas.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.schemas import ANNOTATION_EXPORT, CLASSES, COCO, LEDGER, POOL, ROUND, SEG_MANIFEST

FIRST_COLUMNS = 128
SESSION_IN_PATH = r"sessions/([^/]+)/meta/[^/]+$"


def read_csv_by_name(spark: SparkSession, path: str, names: Sequence[str], extra: bool = False, columns: int = FIRST_COLUMNS) -> DataFrame:
    """CSV files with headers as text columns by name, whatever the order in each file;
    columns that a file lacks are null, others are kept only if ``extra``. Adds _path. Files
    may have any number of columns: where a header fills ``columns``, they are read with
    twice as many. Where all headers agree, as they mostly do, rows are projected by
    constants; else each row meets its file's header in a join."""
    wide = ", ".join(f"_c{k} string" for k in range(columns))
    cells = F.array(*[f"_c{k}" for k in range(columns)]).alias("_cells")
    where = F.col("_metadata.file_path").alias("_path")
    reader = spark.read.option("mode", "PERMISSIVE")
    first = reader.schema(wide).option("header", False).csv(path).filter("_metadata.file_block_start = 0").select(where, cells, F.monotonically_increasing_id().alias("_k"))
    headers = first.groupBy("_path").agg(F.min_by("_cells", "_k").alias("_raw"))
    headers = headers.withColumn("_header", F.transform("_raw", lambda x: F.trim(F.regexp_replace(x, "^\ufeff", ""))))
    forms = headers.select("_header").distinct().collect()
    if any(f["_header"][-1] is not None for f in forms):  # the last column is taken: there may be more
        return read_csv_by_name(spark, path, names, extra, 2 * columns)
    raw = reader.schema(wide).option("header", True).csv(path).select(where, cells)
    if len(forms) == 1:
        rows = raw.withColumn("_header", F.array(*[F.lit(x).cast("string") for x in forms[0]["_header"]]))
    else:
        rows = raw.join(headers.select("_path", "_header"), "_path")
    others = sorted({x for f in forms for x in f["_header"] if x} - set(names)) if extra else []
    cell = lambda n: F.get("_cells", (F.array_position("_header", n) - 1).cast("int")).alias(n)
    return rows.select(*[cell(n) for n in (*names, *others)], "_path")


def read_pool(spark: SparkSession, root: str, live_only: bool = True) -> DataFrame:
    """All sessions' pools: a blank session id comes from the path, dropped rows go, paths of
    the colour and depth frames are added. Missing curation columns mean kept."""
    rows = read_csv_by_name(spark, f"{root}/sessions/*/meta/pool.csv", POOL)
    sid = F.coalesce(F.when(F.trim("session_id") != "", F.trim("session_id")), F.regexp_extract("_path", SESSION_IN_PATH, 1))
    rows = rows.withColumn("session_id", sid).withColumn("dropped", C.is_dropped(F.col("dropped"))).drop("_path")
    base = F.concat_ws("/", F.lit(root), F.lit("sessions"), "session_id")
    rows = rows.withColumn("rgb_path", F.concat(base, F.lit("/rgb/"), "filename")).withColumn("depth_path", F.concat(base, F.lit("/depth/"), "filename"))
    return rows.filter(~F.col("dropped")) if live_only else rows


def read_pool_session(spark: SparkSession, root: str, session: str) -> DataFrame:
    """One session's pool with its curation columns."""
    rows = read_csv_by_name(spark, f"{root}/sessions/{session}/meta/pool.csv", POOL).drop("_path")
    return rows.withColumn("session_id", F.lit(session)).withColumn("dropped", C.is_dropped(F.col("dropped"))).withColumn("drop_reason", F.coalesce("drop_reason", F.lit("")))


def kept_filenames(pool: DataFrame) -> DataFrame:
    """Names that aren't blank, of rows that aren't dropped."""
    return pool.filter((F.trim(F.coalesce("filename", F.lit(""))) != "") & ~C.is_dropped(F.col("dropped"))).select("session_id", "filename")


def read_capture_log(spark: SparkSession, path: str) -> DataFrame:
    """Capture logs of either version, told apart by capture_frame_idx. A row that can't be
    read voids its whole file, which then counts as absent."""
    rows = read_csv_by_name(spark, path, ["frame_idx", "video_frame_idx", "capture_frame_idx", "timestamp_ns", "image_timestamp_ns", "host_realtime_ns", "pose_state", "tx_mm", "ty_mm", "tz_mm"])
    index = F.coalesce("video_frame_idx", "frame_idx").try_cast("long")
    stamp = F.coalesce("image_timestamp_ns", "timestamp_ns").try_cast("long")
    rows = rows.withColumn("version", F.when(F.col("capture_frame_idx").isNotNull(), 2).otherwise(1)).withColumn("video_frame_idx", index).withColumn("timestamp_ns", stamp)
    rows = rows.withColumn("_bad", F.max((F.col("video_frame_idx").isNull() | F.col("timestamp_ns").isNull()).cast("int")).over(Window.partitionBy("_path")))
    return rows.filter("_bad = 0").select("_path", "version", "video_frame_idx", F.col("capture_frame_idx").try_cast("long").alias("capture_frame_idx"), "timestamp_ns", "pose_state", *[C.number(c).alias(c) for c in ("tx_mm", "ty_mm", "tz_mm")])


def read_calibration_text(spark: SparkSession, path: str, keys: Sequence[str] = ("fx", "fy", "cx", "cy")) -> DataFrame:
    """Per file the intrinsics after each key."""
    text = spark.read.text(path, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    return text.select("_path", *[F.regexp_extract("value", rf"(?i)\b{k}\b\s*[:=]\s*([-+0-9.eE]+)", 1).try_cast("double").alias(k) for k in keys])


def read_calibration_json(spark: SparkSession, path: str) -> DataFrame:
    """Per file the rectified intrinsics, and the ground size of a pixel a metre away."""
    block = "struct<fx: double, fy: double, cx: double, cy: double>"
    text = spark.read.text(path, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    doc = text.withColumn("d", F.from_json("value", f"rectified struct<left: {block}>, baseline_mm double"))
    return doc.select("_path", "d.rectified.left.*", "d.baseline_mm", F.try_divide(F.lit(1000.0), F.col("d.rectified.left.fx")).alias("mm_per_px_at_1m"))


def parse_key_values(text: Column) -> Column:
    """'key: value' lines as a map; only the first colon splits."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(":")))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v"))
    entries = F.transform(lines, pair)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o.k == e.k))
    return F.map_from_entries(last)


def read_session_meta(spark: SparkSession, json_path: str | None, text_path: str | None, keys: Sequence[str]) -> DataFrame:
    """Session metadata by session id: JSON's values win over the text file's."""
    sides = []
    for priority, path in enumerate((json_path, text_path)):
        if path:
            raw = spark.read.text(path, wholetext=True)
            parsed = F.from_json("value", "map<string,string>") if priority == 0 else parse_key_values(F.col("value"))
            sides.append(raw.select(F.regexp_extract(F.col("_metadata.file_path"), SESSION_IN_PATH, 1).alias("session_id"), F.lit(priority).alias("priority"), parsed.alias("m")))
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    pick = lambda k: F.min_by(F.try_element_at("m", F.lit(k)), F.when(F.try_element_at("m", F.lit(k)).isNotNull(), F.col("priority"))).alias(k)
    return both.groupBy("session_id").agg(*[pick(k) for k in keys])


def read_annotations(spark: SparkSession, path: str, strict: bool = True, classes: Sequence[str] = CLASSES, extra: Sequence[str] = ("weed_LEP", "ignore_region")) -> DataFrame:
    """An annotation export, one row an annotation: item, order, label by canonical name,
    type, group, points, box and attributes. A document's unknown label is an error if strict."""
    docs = spark.read.schema(ANNOTATION_EXPORT).option("multiLine", True).json(path).withColumn("_path", F.col("_metadata.file_path"))
    docs = docs.filter(F.col("items").isNotNull())
    labels = F.transform("categories.label.labels", lambda x: C.canonical_label(x["name"], classes))
    if strict:
        names = docs.select(F.explode(labels).alias("label")).distinct().filter(~F.col("label").isin(*classes, *extra)).limit(20).collect()
        if names:
            raise ValueError(f"labels that the classes don't have: {sorted(r.label for r in names)}")
    items = docs.select("_path", labels.alias("labels"), F.posexplode("items").alias("item_no", "item"))
    rows = items.select("_path", "labels", "item_no", F.col("item.id").alias("item_id"), F.coalesce("item.image", "item.media").alias("image"), F.posexplode_outer("item.annotations").alias("k", "a"))
    label = F.get("labels", F.col("a.label_id"))
    return rows.select("_path", "item_no", "item_id", C.session_of_frame(F.col("item_id")).alias("session_id"), F.col("image.path").alias("image"), F.get("image.size", F.lit(0)).alias("height"), F.get("image.size", F.lit(1)).alias("width"), "k", F.col("a.id").alias("annotation_id"), F.col("a.type").alias("type"), F.col("a.label_id").alias("label_id"), label.alias("label"), F.coalesce("a.group", F.lit(0)).alias("group"), F.col("a.points").alias("points"), F.col("a.bbox").alias("bbox"), F.col("a.rle").alias("rle"), F.col("a.attributes").alias("attributes"))


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """COCO annotations with file and category names; annotations of unknown images go, an
    unknown category is its id as text."""
    doc = spark.read.schema(COCO).option("multiLine", True).json(path).withColumn("_doc", F.col("_metadata.file_path"))
    images = doc.select("_doc", F.explode("images").alias("i")).select("_doc", F.col("i.id").alias("image_id"), F.regexp_extract("i.file_name", r"([^/\\]*)$", 1).alias("file_name"), F.col("i.width").alias("width"), F.col("i.height").alias("height"))
    names = doc.select("_doc", F.explode("categories").alias("c")).select("_doc", F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    notes = doc.select("_doc", F.posexplode("annotations").alias("k", "a")).select("_doc", "k", "a.*")
    out = notes.join(images, ["_doc", "image_id"]).join(names, ["_doc", "category_id"], "left")
    return out.withColumn("category", F.coalesce("category", F.col("category_id").cast("string"))).drop("_doc")


def read_seg_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Frames of segmentation manifests by base name; of repeated names the last wins."""
    doc = spark.read.schema(SEG_MANIFEST).option("multiLine", True).json(path)
    frames = doc.select(F.posexplode("frames").alias("k", "f")).select("k", F.regexp_extract("f.image", r"([^/\\]*)$", 1).alias("file_name"), "f")
    return frames.groupBy("file_name").agg(F.max_by("f", "k").alias("f")).select("file_name", "f.*")


def sniff_documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """What each JSON file is: annotation export, COCO, segmentation manifest or other, with
    its description's provenance."""
    text = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json" if recursive else "*").text(path, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    has = lambda k: F.get_json_object("value", f"$.{k}").isNotNull()
    kind = F.when(has("items"), "annotations").when(has("images") & has("annotations"), "coco").when(has("frames"), "manifest").otherwise("other")
    return text.select("_path", kind.alias("kind"), C.provenance_caveat(F.get_json_object("value", "$.info.description")).alias("provenance"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The rounds of an active-learning ledger; a missing or broken file has none."""
    try:
        doc = spark.read.schema(LEDGER).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        return doc.filter(F.col("rounds").isNotNull()).select(F.explode("rounds").alias("r")).select("r.*")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ROUND)


def read_history(spark: SparkSession, path: str, metrics: Sequence[str]) -> DataFrame:
    """A sparse metrics CSV merged per epoch; the last value that isn't blank wins."""
    from tessera.operators.windows import history_by_epoch

    rows = read_csv_by_name(spark, path, ["epoch", *metrics]).withColumn("_k", F.monotonically_increasing_id())
    rows = rows.select(C.number("epoch").cast("int").alias("epoch"), "_k", *[C.number(m).alias(m) for m in metrics])
    return history_by_epoch(rows.filter("epoch is not null"), "epoch", "_k", metrics)


def flatten_metrics(text: Column, blocks: Sequence[str] = ("overall", "summary")) -> Column:
    """A metrics document as one map: a block's numbers first, then top-level ones."""
    parts = [F.from_json(F.get_json_object(text, f"$.{b}"), "map<string,string>") for b in blocks]
    top = F.from_json(text, "map<string,string>")
    numeric = lambda m: F.map_filter(F.transform_values(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    without = lambda m, other: F.map_filter(m, lambda k, v: ~F.map_contains_key(other, k))
    out = numeric(top)
    for part in reversed([numeric(p) for p in parts]):
        out = F.map_concat(without(out, part), part)
    return out


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, size and time of change of files, without their content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", "modificationTime")


def resolve_images(wanted: DataFrame, files: DataFrame, key: str = "image") -> DataFrame:
    """Each wanted image's file: by whole path, else by name, else by session and index if
    exactly one file fits. wanted: image, session_id, idx; files: path, name, session_id, idx."""
    exact = wanted.join(files.select("path"), F.col(key) == F.col("path")).select(key, "path", F.lit(0).alias("priority"))
    base = F.regexp_extract(key, r"([^/\\]*)$", 1)
    named = wanted.join(files.groupBy("name").agg(F.min("path").alias("path")), base == F.col("name")).select(key, "path", F.lit(1).alias("priority"))
    unique = files.groupBy("session_id", "idx").agg(F.min("path").alias("path"), F.count("*").alias("n")).filter("n = 1")
    indexed = wanted.join(unique, ["session_id", "idx"]).select(key, "path", F.lit(2).alias("priority"))
    best = exact.unionByName(named).unionByName(indexed).groupBy(key).agg(F.min_by("path", F.struct("priority", "path")).alias("path"))
    return wanted.join(best, key, "left")


def unlabelled_files(files: DataFrame, stride: int, exclude: DataFrame | None, limit: int | None) -> DataFrame:
    """Every stride-th file of a session, then without the excluded, then the first ``limit``
    over all sessions."""
    from tessera.operators.windows import every_nth

    out = every_nth(files, "session_id", "path", stride)
    out = out if exclude is None else out.join(exclude, "name", "left_anti")
    return out if limit is None else out.orderBy("session_id", "path").limit(limit)


def read_side(spark: SparkSession, path: str) -> DataFrame:
    """Truths or predictions below a folder, or of one file, in either of two formats: a
    segmentation manifest (seg_manifest.json first), else COCO (instances_default.json
    first), else the first other JSON file, by path, that is one of them: file_name, label,
    polygons, score."""
    kinds = sniff_documents(spark, path, recursive=True).filter(F.col("kind").isin("manifest", "coco"))
    name = F.regexp_extract("_path", r"([^/]*)$", 1)
    rank = F.when((F.col("kind") == "manifest") & (name == "seg_manifest.json"), 0).when((F.col("kind") == "coco") & (name == "instances_default.json"), 1).otherwise(2)
    first = kinds.orderBy(rank, "_path").select("_path", "kind").first()
    if first is None:
        raise ValueError(f"neither a manifest nor a COCO document below {path}")
    if first.kind == "manifest":
        rows = read_seg_manifest(spark, first["_path"]).select("file_name", F.explode("instances").alias("i"))
        return rows.select("file_name", F.col("i.class_name").alias("label"), F.col("i.polygons").alias("polygons"), F.col("i.score").alias("score"))
    return read_coco(spark, first["_path"]).select("file_name", F.col("category").alias("label"), F.col("segmentation").alias("polygons"), "score")


def coco_masks(notes: DataFrame, category: str | None) -> DataFrame:
    """One run-length mask a file of the polygons of a category, as ``read_coco`` gives them:
    file_name, height, width, counts, area. A category that no annotation names filters
    nothing; polygons of fewer than three points are left out. An image's polygons meet in
    one task, an image at a time."""
    from tessera.operators.kernels import rasterise, rle_encode

    known = category is not None and notes.filter(F.col("category") == category).limit(1).count() > 0
    rows = (notes.filter(F.col("category") == category) if known else notes).select("file_name", "height", "width", "segmentation")

    def draw(part):
        import numpy as np
        import pandas as pd

        height, width = int(part["height"].iloc[0]), int(part["width"].iloc[0])
        mask = np.zeros((height, width), bool)
        for polygons in part["segmentation"]:
            for flat in () if polygons is None else polygons:
                if len(flat) >= 6:
                    mask |= rasterise(list(flat), height, width)
        return pd.DataFrame([(part["file_name"].iloc[0], height, width, rle_encode(mask), int(mask.sum()))], columns=["file_name", "height", "width", "counts", "area"])

    return rows.groupBy("file_name").applyInPandas(draw, "file_name string, height int, width int, counts array<int>, area long")


def verified_sessions(spark: SparkSession, root: str, only: Sequence[str] = ()) -> DataFrame:
    """session_id and path of the verified exports below a folder, a folder a session; only:
    the sessions asked for, all if none is named."""
    found = list_files(spark, root, "instances_default.json")
    rows = found.select(F.regexp_extract("path", r"([^/]+)/instances_default\.json$", 1).alias("session_id"), "path")
    return rows.filter(F.col("session_id").isin(*only)) if only else rows
