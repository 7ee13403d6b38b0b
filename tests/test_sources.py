"""Sources and sinks on small written trees."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers as R
from tessera.sources import sinks as K


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def rows(df, *by):
    return [r.asDict(True) for r in (df.orderBy(*by) if by else df).collect()]


def test_pools(spark, tmp_path):
    put(tmp_path, "sessions/a/meta/pool.csv", "video_frame_idx,filename,session_id,sharpness,dropped\n1,a_000001.png,,5,\n2,a_000002.png,a,6,true\n3,,a,7,0\n")
    put(tmp_path, "sessions/b/meta/pool.csv", "filename,video_frame_idx,session_id\nb_000007.png,7,b\n")
    pool = R.read_pool(spark, str(tmp_path))
    assert [(r["session_id"], r["video_frame_idx"]) for r in rows(pool, "session_id", "video_frame_idx")] == [("a", "1"), ("a", "3"), ("b", "7")]
    assert pool.filter("session_id = 'b'").first().rgb_path.endswith("sessions/b/rgb/b_000007.png")
    assert R.read_pool_session(spark, str(tmp_path), "a").filter("dropped").count() == 1
    assert R.kept_filenames(R.read_pool(spark, str(tmp_path), live_only=False)).count() == 2


def test_capture_logs(spark, tmp_path):
    put(tmp_path, "good/frames.csv", "frame_idx,timestamp_ns,fps\n0,100,15\n1,200,15\n")
    put(tmp_path, "new/frames.csv", "video_frame_idx,capture_frame_idx,image_timestamp_ns,tx_mm\n0,0,5,1.5\n1,2,6,\n")
    put(tmp_path, "bad/frames.csv", "frame_idx,timestamp_ns\n0,100\nx,200\n")
    old, new, bad = (R.read_capture_log(spark, str(tmp_path / d / "frames.csv")) for d in ("good", "new", "bad"))
    assert [(r["version"], r["timestamp_ns"]) for r in rows(old, "video_frame_idx")] == [(1, 100), (1, 200)]
    assert [(r["version"], r["capture_frame_idx"], r["tx_mm"]) for r in rows(new, "video_frame_idx")] == [(2, 0, 1.5), (2, 2, None)]
    assert bad.count() == 0


def test_calibration_and_metadata(spark, tmp_path):
    text = put(tmp_path, "c.txt", "left\nfx: 700.5\nfy = 701\ncx: 320\ncy: 240\n")
    assert R.read_calibration_text(spark, text).first()[1:] == (700.5, 701.0, 320.0, 240.0)
    doc = put(tmp_path, "c.json", {"rectified": {"left": {"fx": 500, "fy": 500, "cx": 1, "cy": 2}}, "baseline_mm": 63})
    assert R.read_calibration_json(spark, doc).first().mm_per_px_at_1m == 2.0
    put(tmp_path, "sessions/a/meta/session.json", {"site": "north"})
    put(tmp_path, "sessions/a/meta/session.txt", "site: south\nnote: at 10:30\n")
    meta = R.read_session_meta(spark, str(tmp_path / "sessions/*/meta/session.json"), str(tmp_path / "sessions/*/meta/session.txt"), ["site", "note"])
    assert rows(meta) == [{"session_id": "a", "site": "north", "note": "at 10:30"}]


EXPORT = {
    "info": {},
    "categories": {"label": {"labels": [{"name": "Onion plant", "parent": "", "attributes": []}, {"name": "weed_LEP", "parent": "", "attributes": []}], "attributes": []}},
    "items": [
        {"id": "s1_000004", "image": {"path": "s1_000004.png", "size": [32, 64]}, "annotations": [{"id": 1, "type": "polygon", "label_id": 0, "group": 2, "points": [0, 0, 4, 0, 4, 4]}, {"id": 2, "type": "points", "label_id": 1, "points": [1, 1]}]},
        {"id": "s1_000005", "image": {"path": "s1_000005.png", "size": [32, 64]}, "annotations": []},
    ],
}


def test_annotations(spark, tmp_path):
    out = rows(R.read_annotations(spark, put(tmp_path, "a.json", EXPORT)), "item_no", "k")
    assert [(r["item_id"], r["label"], r["group"], r["width"]) for r in out][:2] == [("s1_000004", "onion_plant", 2, 64), ("s1_000004", "weed_LEP", 0, 64)]
    assert out[2]["label"] is None
    odd = json.loads(json.dumps(EXPORT))
    odd["categories"]["label"]["labels"].append({"name": "tomato", "parent": "", "attributes": []})
    path = put(tmp_path, "b.json", odd)
    with pytest.raises(ValueError, match="tomato"):
        R.read_annotations(spark, path)
    assert R.read_annotations(spark, path, strict=False).count() == 3


def test_coco_and_sniffing(spark, tmp_path):
    doc = {"info": {"description": "hand corrected"}, "images": [{"id": 1, "file_name": "x/a.png", "width": 4, "height": 4}], "categories": [{"id": 3, "name": "grass_weed"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 3, "bbox": [0, 0, 2, 2], "area": 4.0, "segmentation": [[0, 0, 2, 0, 2, 2]]}, {"id": 2, "image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1]}, {"id": 3, "image_id": 8, "category_id": 3, "bbox": [0, 0, 1, 1]}]}
    path = put(tmp_path, "d/coco.json", doc)
    assert [(r["file_name"], r["category"]) for r in rows(R.read_coco(spark, path), "k")] == [("a.png", "grass_weed"), ("a.png", "9")]
    put(tmp_path, "d/a.json", EXPORT)
    kinds = {r.kind: r.provenance for r in R.sniff_documents(spark, str(tmp_path / "d")).collect()}
    assert kinds == {"coco": "hand_corrected", "annotations": "unknown"}


def test_ledger_and_history(spark, tmp_path):
    path = put(tmp_path, "l.json", {"rounds": [{"round": 1, "state": "merged", "n_frames": 2, "item_ids": ["a", "b"]}, {"round": 2, "state": "exported", "n_frames": 1, "item_ids": ["c"]}]})
    assert [r["round"] for r in rows(R.read_ledger(spark, path), "round")] == [1, 2]
    assert R.read_ledger(spark, str(tmp_path / "none.json")).count() == 0
    history = put(tmp_path, "h.csv", "epoch,loss,map50\n0,1.5,\n0,,0.2\n1,1.2,\n")
    assert rows(R.read_history(spark, history, ["loss", "map50"]), "epoch") == [{"epoch": 0, "loss": 1.5, "map50": 0.2}, {"epoch": 1, "loss": 1.2, "map50": None}]


def test_flattened_metrics(spark):
    text = json.dumps({"map": 0.5, "overall": {"map": 0.7, "recall": 0.9}, "name": "x"})
    out = spark.createDataFrame([(text,)], "t string").select(R.flatten_metrics(F.col("t")).alias("m")).first().m
    assert out == {"map": 0.7, "recall": 0.9}


def test_image_resolution(spark):
    files = spark.createDataFrame([("/r/a.png", "a.png", "s", 1), ("/r/b.png", "b.png", "s", 2), ("/q/b.png", "b.png", "s", 2)], "path string, name string, session_id string, idx int")
    wanted = spark.createDataFrame([("/r/a.png", "s", 9), ("x/b.png", "s", 9), ("none.png", "s", 1), ("lost.png", "s", 2)], "image string, session_id string, idx int")
    got = {r.image: r.path for r in R.resolve_images(wanted, files).collect()}
    assert got == {"/r/a.png": "/r/a.png", "x/b.png": "/q/b.png", "none.png": "/r/a.png", "lost.png": None}


def test_unlabelled_files(spark):
    files = spark.range(10).select(F.lit("s").alias("session_id"), F.format_string("/f/%02d.png", "id").alias("path"), F.format_string("%02d.png", "id").alias("name"))
    done = spark.createDataFrame([("03.png",)], "name string")
    assert [r.name for r in R.unlabelled_files(files, 3, done, 2).collect()] == ["00.png", "06.png"]


def test_partitioned_rewrite(spark, tmp_path):
    path = str(tmp_path / "out")
    K.write_csv(spark.createDataFrame([(1, "a"), (2, "b")], "v int, s string"), path, ["s"])
    K.write_csv(spark.createDataFrame([(3, "b")], "v int, s string"), path, ["s"])
    assert sorted((r.v, r.s) for r in spark.read.option("header", True).schema("v int, s string").csv(path).collect()) == [(1, "a"), (3, "b")]


def test_other_sinks(spark, tmp_path):
    f = spark.createDataFrame([("train", "a"), ("train", "b"), ("val", "c")], "split string, name string")
    assert {r.split: r.n for r in K.write_splits(f, str(tmp_path / "s"), "split", "name").collect()} == {"train": 2, "val": 1}
    old = spark.createDataFrame([("a", 1, "k"), ("b", 2, "l")], "key string, v int, other string")
    new = spark.createDataFrame([("b", 5), ("c", 6)], "key string, v int")
    assert rows(K.upsert(old, new, "key", ["v"]), "key") == [{"key": "a", "v": 1, "other": "k"}, {"key": "b", "v": 5, "other": "l"}, {"key": "c", "v": 6, "other": None}]
    nested = spark.createDataFrame([((1, (2.0,)),)], "m struct<a: int, b: struct<c: double>>")
    assert K.flatten(nested).columns == ["m.a", "m.b.c"]
    assert K.union_columns(old, new.withColumn("more", F.lit(1))).columns == ["key", "v", "other", "more"]


def test_either_format_masks_and_sessions(spark, tmp_path):
    coco = {"images": [{"id": 1, "file_name": "x/a.png", "width": 8, "height": 6}], "categories": [{"id": 2, "name": "grass_weed"}, {"id": 3, "name": "onion_plant"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 2, "segmentation": [[1, 1, 5, 1, 5, 4, 1, 4], [0, 0, 1, 1]]}, {"id": 2, "image_id": 1, "category_id": 3, "segmentation": [[5, 1, 7, 1, 7, 3, 5, 3]]}]}
    put(tmp_path, "side/s1/instances_default.json", coco)
    put(tmp_path, "side/s2/instances_default.json", coco)
    put(tmp_path, "side/a_first.json", {"frames": [{"image": "q.png", "instances": [{"class_name": "wild_radish", "polygons": [[0, 0, 1, 0, 1, 1]]}]}]})
    side = str(tmp_path / "side")
    assert sorted((r.file_name, r.label) for r in R.read_side(spark, side).collect()) == [("a.png", "grass_weed"), ("a.png", "onion_plant")]
    put(tmp_path, "side/seg_manifest.json", {"frames": [{"image": "m.png", "instances": [{"class_name": "wild_radish", "polygons": [[0, 0, 1, 0, 1, 1]]}]}]})
    assert [(r.file_name, r.label) for r in R.read_side(spark, side).collect()] == [("m.png", "wild_radish")]
    notes = R.read_coco(spark, f"{side}/s1/instances_default.json")
    one = R.coco_masks(notes, "grass_weed").first()
    assert (one.file_name, one.area, sum(one.counts)) == ("a.png", 12, 48)
    assert R.coco_masks(notes, "no such class").first().area == 16
    assert sorted(r.session_id for r in R.verified_sessions(spark, side).collect()) == ["s1", "s2"]
    assert [r.session_id for r in R.verified_sessions(spark, side, ["s2"]).collect()] == ["s2"]


def test_wide_files_and_rows_like_the_header(spark, tmp_path):
    names = [f"n{k}" for k in range(300)]
    (tmp_path / "w.csv").write_text(",".join(names) + "\n" + ",".join(str(k) for k in range(300)) + "\n" + ",".join(names) + "\n")
    got = R.read_csv_by_name(spark, str(tmp_path / "w.csv"), ["n299", "n0", "lost"]).collect()
    assert sorted((r.n299, r.n0, r.lost) for r in got) == [("299", "0", None), ("n299", "n0", None)]
