"""Explicit schemas of the data model and the class dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The classes in category order (ids count from 1), and the groups among them.
CLASSES = ("cutleaf_evening_primrose", "wild_radish", "grass_weed", "weed_cluster", "other_weed", "onion_plant")
CROP_CLASS = "onion_plant"
ROSETTE_CLASSES = ("cutleaf_evening_primrose", "wild_radish", "other_weed")
AUTO_ASSIGNABLE = ("grass_weed", "weed_cluster", "other_weed")
POINT_LABEL, IGNORE_LABEL = "weed_LEP", "ignore_region"
SCENES = ("onion_only", "weed_only", "mixed", "unknown")
SPLITS = ("train", "val", "test")

#: A frame pool's columns; numbers that can be blank are read as text.
POOL = (
    "video_frame_idx capture_frame_idx timestamp_ns host_realtime_ns exposure gain wb_temp pose_state tx_mm ty_mm tz_mm in_pool sharpness mean_luma clip_frac dark_frac "
    "veg_frac phash depth_valid_frac depth_valid_frac_veg depth_median_mm depth_inrange_frac conf_mean conf_mean_veg filename session_id trip site field scene_hint capture_format dropped drop_reason"
).split()
#: An annotation export: labels and items with annotations.
_PICTURE = "struct<path: string, size: array<int>>"
_NOTE = "struct<id: bigint, type: string, label_id: int, `group`: bigint, points: array<double>, bbox: array<double>, rle: struct<counts: array<int>, size: array<int>>, attributes: map<string,string>>"
ANNOTATION_EXPORT = f"categories struct<label: struct<labels: array<struct<name: string, parent: string, attributes: array<string>>>>>, items array<struct<id: string, image: {_PICTURE}, media: {_PICTURE}, annotations: array<{_NOTE}>>>"
COCO = (
    "info struct<description: string>, images array<struct<id: bigint, file_name: string, width: int, height: int>>, "
    "annotations array<struct<id: bigint, image_id: bigint, category_id: int, bbox: array<double>, area: double, segmentation: array<array<double>>, score: double>>, "
    "categories array<struct<id: int, name: string, supercategory: string>>"
)
SEG_MANIFEST = "frames array<struct<item_id: string, session_id: string, image: string, split: string, width: int, height: int, instances: array<struct<class_name: string, polygons: array<array<double>>, score: double>>>>"
ROUND = "round int, state string, n_frames int, item_ids array<string>, metrics_before map<string,double>, metrics_after map<string,double>, note string"
LEDGER = "rounds array<struct<round: int, state: string, n_frames: int, item_ids: array<string>, metrics_before: map<string,double>, metrics_after: map<string,double>, note: string>>"


def class_dimension(spark: SparkSession) -> DataFrame:
    """class_name, category_id, is_crop, is_rosette, auto_assignable."""
    rows = [(c, i, c == CROP_CLASS, c in ROSETTE_CLASSES, c in AUTO_ASSIGNABLE) for i, c in enumerate(CLASSES, 1)]
    return spark.createDataFrame(rows, "class_name string, category_id int, is_crop boolean, is_rosette boolean, auto_assignable boolean")
