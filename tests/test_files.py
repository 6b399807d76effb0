import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from boxloom.operators import compare, views
from boxloom.plans import inference, jobs
from boxloom.sources import files
from boxloom.sources.tracking import Tracker

DOC = {
    "images": [{"id": "7", "file_name": "s/a.jpg", "width": 100, "height": 50.0}, {"id": 8.0, "file_name": "b.png", "width": 10, "height": 10}],
    "annotations": [{"id": 1, "image_id": 7.0, "category_id": "3", "bbox": [10, 10, 20, 20]}, {"id": 2, "image_id": "7", "category_id": 5, "bbox": [0, 0, 0, 5], "area": 0, "iscrowd": 1}],
    "categories": [{"id": 5, "name": "é"}, {"id": 3, "name": "x", "supercategory": "y"}],
}


def test_coco_reads_ids_however_written(spark, tmp_path):
    files.save_json(DOC, tmp_path / "c.json")
    d = files.read_coco(spark, str(tmp_path / "c.json"))
    assert [(r.image_id, r.width, r.height, r.ord) for r in d.images.orderBy("ord").collect()] == [(7, 100, 50, 0), (8, 10, 10, 1)]
    assert [(r.ann_id, r.image_id, r.category_id, r.w, r.iscrowd) for r in d.annotations.orderBy("ord").collect()] == [(1, 7, 3, 20.0, 0), (2, 7, 5, 0.0, 1)]
    index = views.category_index(d.categories)
    assert {(r.category_id, r.idx, r.name) for r in index.collect()} == {(3, 0, "x"), (5, 1, "é")}
    files.write_coco(d.images.select("image_id", "file_name", "width", "height"), d.annotations, d.categories, str(tmp_path / "o.json"))
    back = files.read_coco(spark, str(tmp_path / "o.json"))
    assert sorted(back.annotations.select("ann_id", "image_id", "category_id", "x", "y", "w", "h", "iscrowd").collect()) == sorted(d.annotations.select("ann_id", "image_id", "category_id", "x", "y", "w", "h", "iscrowd").collect())
    files.write_labels(d.annotations, d.images, index, str(tmp_path / "labels"))
    assert (tmp_path / "labels/s/a.txt").read_text() == "0 0.20000000 0.40000000 0.20000000 0.40000000\n"
    assert (tmp_path / "labels/b.txt").read_text() == ""
    files.write_dataset_yaml(index, ["train"], str(tmp_path / "y"))
    assert {(r.idx, r.category_id) for r in files.read_class_map(spark, str(tmp_path / "y/category_mapping.json")).collect()} == {(0, 3), (1, 5)}


def test_missing_key_is_an_error_empty_list_is_not(spark, tmp_path):
    files.save_json({"images": [], "annotations": []}, tmp_path / "m.json")
    with pytest.raises(Exception, match="missing"):
        files.read_coco(spark, str(tmp_path / "m.json")).images.collect()
    files.save_json({"images": [], "annotations": [], "categories": []}, tmp_path / "e.json")
    assert files.read_coco(spark, str(tmp_path / "e.json")).images.count() == 0


def test_predictions_keep_their_order(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"image_id": 2, "category_id": "1", "bbox": [1, 2, 3, 4], "score": 0.5}, {"image_id": 1, "category_id": 1, "bbox": [0, 0, 1, 1], "score": 0.9}]))
    assert [(r.det_id, r.image_id, r.h) for r in files.read_predictions(spark, str(tmp_path / "p.json")).orderBy("det_id").collect()] == [(0, 2, 4.0), (1, 1, 1.0)]
    (tmp_path / "n.json").write_text("[]")
    assert files.read_predictions(spark, str(tmp_path / "n.json")).count() == 0


def test_export_needs_equal_class_maps(spark, tmp_path):
    for s in ("train", "valid", "test"):
        files.save_json(DOC, tmp_path / s / "_annotations.coco.json")
    img, ann, _ = files.read_export(spark, str(tmp_path))
    assert img.count() == 6 and ann.count() == 6 and {r.grp for r in img.collect()} == {"a.jpg", "b.png"}
    files.save_json(DOC | {"categories": [{"id": 3, "name": "other"}]}, tmp_path / "test" / "_annotations.coco.json")
    with pytest.raises(ValueError, match="differs"):
        files.read_export(spark, str(tmp_path))


def test_listing_and_placing(spark, tmp_path):
    src = tmp_path / "src"
    (src / "s").mkdir(parents=True)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 30, 20) + bytes([8, 0, 0, 0, 0])) + chunk(b"IEND", b"")
    (src / "s/a.png").write_bytes(png)
    (src / "bad.jpg").write_bytes(b"\xff\xd8oops")
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 11, 22) + b"\0" * 10 + b"\xff\xd9"
    (src / "c.jpg").write_bytes(jpg)
    got = {r.file_name: (r.width, r.height) for r in files.file_listing(spark, str(src)).collect()}
    assert got == {"s/a.png": (30, 20), "bad.jpg": (None, None), "c.jpg": (22, 11)}
    names = spark.createDataFrame([("s/a.png",), ("nope.jpg",)], "file_name string")
    assert [r.file_name for r in files.missing_files(spark, names, str(src)).collect()] == ["nope.jpg"]
    for mode in ("hardlink", "symlink", "copy"):
        files.place_files(names.limit(1), str(src), str(tmp_path / mode), mode)
        assert (tmp_path / mode / "s/a.png").read_bytes() == png


def test_metrics_history_and_tracking(spark, tmp_path):
    files.save_json({"metrics": {"coco_map5095": 0.3, "ok": True, "text": "x"}, "per_class": {}}, tmp_path / "r1/metrics.json")
    files.save_json({"coco_map5095": 0.5}, tmp_path / "r2/metrics.json")
    files.save_json({"fps": 12.5, "scope": "s"}, tmp_path / "r2/inference_metrics.json")
    m = compare.flat_metrics(files.read_metrics(spark, [str(tmp_path / f"r{i}/metrics.json") for i in (1, 2)]))
    assert {tuple(r) for r in m.collect()} == {("r1", "coco_map5095", 0.3), ("r1", "ok", 1.0), ("r2", "coco_map5095", 0.5), ("r2", "inference_fps", 12.5)}
    table = compare.compared(m)
    assert [r.experiment for r in table.collect()] == ["r2", "r1"]
    assert compare.markdown(table).splitlines()[0].startswith("| experiment | coco_map5095")
    (tmp_path / "h.csv").write_text(" epoch , loss/a:b\n1.0,0.5\n2,nan\n3,0.25\n")
    assert {tuple(r) for r in files.read_history(spark, str(tmp_path / "h.csv"), "r").collect()} == {("r", 1, "loss/a_b", 0.5), ("r", 3, "loss/a_b", 0.25)}
    (tmp_path / "n.csv").write_text("loss\n1\n2\n")
    assert {tuple(r) for r in files.read_history(spark, str(tmp_path / "n.csv"), "r").collect()} == {("r", 1, "loss", 1.0), ("r", 2, "loss", 2.0)}
    t = Tracker(spark, str(tmp_path / "log"))
    run = t.start("e", {"a": 1, "b": [1]}, str(tmp_path / "run"))
    t.metrics(run, {"x:y": "2.5", "bad": "z", "inf": float("inf")}, 3)
    t.artifacts(run, str(tmp_path / "h.csv"))
    assert t.run_of(str(tmp_path / "run")) == run and [(r.metric, r.value, r.step) for r in t.read("metrics").collect()] == [("x_y", 2.5, 3)]
    t.sync_history(str(tmp_path / "run"), str(tmp_path / "h.csv"))
    assert t.read("metrics").count() == 3 and t.read("params").count() == 1 and t.read("artifacts").count() == 1
    with pytest.raises(FileNotFoundError):
        t.sync_history(str(tmp_path), str(tmp_path / "h.csv"))
    assert Tracker(spark, str(tmp_path / "off"), enabled=False).start("e", {}) is None and not (tmp_path / "off").exists()


def test_inference(spark):
    images = spark.createDataFrame([(i, 100, 50) for i in range(5)], "image_id long, width int, height int")
    raw = inference.predict(images, inference.stub_model)
    index = spark.createDataFrame([(0, 10), (1, 11)], "idx int, category_id long")
    got = inference.normalised(raw, index)
    assert {(r.image_id, r.category_id, r.w, r.h) for r in got.collect()} == {(0, 10, 50.0, 25.0), (3, 10, 50.0, 25.0), (1, 11, 50.0, 25.0), (4, 11, 50.0, 25.0)}
    with pytest.raises(Exception, match="unknown label"):
        inference.normalised(raw, index, unknown="raise").collect()


def test_config_and_jobs(tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs/c.yaml").write_text("tracking:\n  uri: sqlite:///runs.db\n  artifact_root: art\n")
    c = files.load_config(tmp_path / "configs/c.yaml")
    assert c["tracking"]["uri"] == f"sqlite:///{tmp_path}/runs.db" and c["tracking"]["artifact_root"] == f"{tmp_path}/art"
    (tmp_path / "configs/l.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        files.load_config(tmp_path / "configs/l.yaml")
    done = []
    steps = jobs.plan(["YOLO"], actions={"convert": lambda: done.append(1), "compare": lambda: done.append(2)})
    assert jobs.execute(steps, dry_run=True) == ["convert", "yolo:train", "yolo:predict", "yolo:evaluate", "compare"] and not done
    jobs.execute(steps)
    assert done == [1, 2] and "pyspark" in jobs.environment()
    with pytest.raises(ValueError):
        jobs.plan(["unknown"])
