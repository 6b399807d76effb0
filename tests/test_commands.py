import json
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boxloom.__main__ import main
from boxloom.operators import views
from boxloom.plans import commands
from boxloom.sources import files

CATS = [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}, {"id": 3, "name": "unused"}]


def png(w, h, note):
    """A PNG file of that size, with a note so that contents differ."""
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    rows = zlib.compress(b"".join(b"\0" + b"\0" * w for _ in range(h)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + chunk(b"tEXt", b"note\0" + note.encode()) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


@pytest.fixture
def export(tmp_path):
    """Two images of one photo in different splits, others alone; one box over the border, one outside."""
    root, k = tmp_path / "export", 0
    for s, names in {"train": ["x_jpg.rf.aa.jpg", "y.jpg", "z.jpg"], "valid": ["x_jpg.rf.bb.jpg"], "test": ["w.png"]}.items():
        images, anns = [], []
        for i, n in enumerate(names):
            images.append({"id": i, "file_name": n, "width": 100, "height": 100})
            anns += [{"id": k, "image_id": i, "category_id": 1 + k % 2, "bbox": [90, 10, 20, 20]}, {"id": k + 1, "image_id": i, "category_id": 1, "bbox": [200, 0, 5, 5]}]
            k += 2
            p = root / s / n
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(png(100, 100, n))
        files.save_json({"images": images, "annotations": anns, "categories": CATS}, root / s / "_annotations.coco.json")
    return root


def test_prepare_validate_convert_evaluate(spark, export, tmp_path, capsys):
    out = tmp_path / "out"
    assert main(["prepare", "--source", str(export), "--out", str(out), "--train", "0.5", "--val", "0.3", "--test", "0.2"], spark) == 0
    report = json.loads((out / "preparation_report.json").read_text())
    assert report["source_groups"] == 4 and report["clipped_boxes"] == 10 and sorted(report["removed_empty_categories"]) == ["b", "unused"]
    assert sum(v["images"] for v in report["output_summary"].values()) == 5 and report["source_summary"]["train"] == {"images": 3, "annotations": 6}
    docs = {s: json.loads((out / "annotations" / f"{s}.json").read_text()) for s in ("train", "val", "test")}
    where = {}
    for s, d in docs.items():
        assert [i["id"] for i in d["images"]] == list(range(1, len(d["images"]) + 1)) and [a["id"] for a in d["annotations"]] == list(range(1, len(d["annotations"]) + 1))
        assert all(a["bbox"] == [90.0, 10.0, 10.0, 20.0] for a in d["annotations"])
        for i in d["images"]:
            assert (out / s / "images" / i["file_name"]).exists()
            where.setdefault(i["source_group"], set()).add(s)
    assert all(len(v) == 1 for v in where.values()) and where.keys() == {"x", "y.jpg", "z.jpg", "w.png"}
    with pytest.raises(FileExistsError):
        commands.prepare_export(spark, str(export), str(out))
    full = next(s for s, d in docs.items() if d["annotations"])
    ann = str(out / "annotations" / f"{full}.json")
    found, ok = commands.validate(spark, str(out / full / "images"), ann)
    assert ok, found.collect()
    assert main(["validate", "--annotations", str(export / "train" / "_annotations.coco.json"), "--strict"], spark) == 1
    main(["convert", "--train-annotations", ann, "--train-images", str(out / full / "images"), "--out", str(tmp_path / "yolo")], spark)
    label = sorted((tmp_path / "yolo/labels/train").glob("*.txt"))[0].read_text()
    assert label == "0 0.95000000 0.20000000 0.10000000 0.20000000\n" and len(list((tmp_path / "yolo/images/train").iterdir())) == len(docs[full]["images"])
    pred = [{"image_id": a["image_id"], "category_id": a["category_id"], "bbox": a["bbox"], "score": 0.9} for a in docs[full]["annotations"]]
    (tmp_path / "pred.json").write_text(json.dumps(pred))
    payload = commands.measure(spark, ann, str(tmp_path / "pred.json"), str(tmp_path / "run1/metrics.json"))
    assert payload["metrics"]["overall_f1"] == 1.0 and payload["metrics"]["coco_map5095"] == pytest.approx(1.0) and payload["metrics"]["relative_medium_map5095"] == pytest.approx(1.0)
    assert payload["per_class"]["a"]["tp"] == len(pred)
    (tmp_path / "none.json").write_text("[]")
    empty = commands.measure(spark, ann, str(tmp_path / "none.json"), str(tmp_path / "run2/metrics.json"))
    assert empty["metrics"]["coco_map50"] == 0.0 and empty["metrics"]["overall_fn"] == len(pred) and empty["metrics"]["relative_large_map50"] == 0.0
    main(["compare", "--metrics", str(tmp_path / "run2/metrics.json"), str(tmp_path / "run1/metrics.json"), "--out", str(tmp_path / "cmp")], spark)
    assert (tmp_path / "cmp/comparison.md").read_text().splitlines()[2].startswith("| run1 |")
    assert commands.analyse(spark, ann, str(tmp_path / "rep"))["size_counts"] == {"medium": len(pred)}
    assert main(["environment"]) == 0 and "pyspark" in capsys.readouterr().out


def test_tile_and_merge(spark, tmp_path):
    doc = {"images": [{"id": 10, "file_name": "d/p.v.jpg", "width": 96, "height": 64}, {"id": 11, "file_name": "q.jpg", "width": 64, "height": 64}], "annotations": [{"id": 5, "image_id": 10, "category_id": 1, "bbox": [40, 10, 10, 10], "iscrowd": 1}], "categories": CATS}
    files.save_json(doc, tmp_path / "a.json")
    images, boxes = commands.tile(spark, str(tmp_path / "a.json"), str(tmp_path / "t"), patch=64, overlap=0.5, min_visible=0.3)
    got = {(r.id, r.file_name, r.source_image_id, r.patch_x, r.width) for r in images.collect()}
    assert {g for g in got if g[2] == 10} == {(1, "p.v__src10_x0_y0.jpg", 10, 0, 64), (2, "p.v__src10_x32_y0.jpg", 10, 32, 64)} and len(got) == 3
    assert {(r.id, r.image_id, tuple(r.bbox), r.iscrowd, r.source_annotation_id) for r in boxes.collect()} == {(1, 1, (40.0, 10.0, 10.0, 10.0), 1, 5), (2, 2, (8.0, 10.0, 10.0, 10.0), 1, 5)}
    patches = {"images": [{"id": 1, "source_image_id": 10, "patch_x": 0, "patch_y": 0}, {"id": 2, "source_image_id": 10, "patch_x": 32, "patch_y": 0}], "annotations": [], "categories": []}
    files.save_json(patches, tmp_path / "p.json")
    files.save_json([{"image_id": 1, "category_id": 1, "bbox": [40, 10, 10, 10], "score": 0.9}, {"image_id": 2, "category_id": 1, "bbox": [8, 10, 10, 10], "score": 0.8}], tmp_path / "d.json")
    assert commands.merge(spark, str(tmp_path / "p.json"), str(tmp_path / "d.json"), str(tmp_path / "m")) == 1
    assert commands.merge_manifest({"a": 1, "b": 1}, {"b": 2}) == {"a": 1, "b": 2}
    d = files.read_coco(spark, str(tmp_path / "a.json"))
    per = {r.image_id: r.boxes for r in views.per_image(d.images, views.plain_view(d.annotations, views.category_index(d.categories)), ("x", "label")).collect()}
    assert [(b.ann_id, b.x, b.label) for b in per[10]] == [(5, 40.0, 0)] and per[11] == []
    assert Path(tmp_path / "t/images").exists() and F is not None


def test_tile_predict_merge_evaluate(spark, tmp_path):
    """Each command reads what the one before wrote; no detection is lost on the way."""
    boxes = [(1, 1, [10, 10, 40, 40]), (2, 1, [100, 80, 30, 30]), (3, 2, [150, 20, 40, 60]), (4, 2, [20, 100, 50, 50])]
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 200, "height": 160}, {"id": 2, "file_name": "b.jpg", "width": 200, "height": 160}], "annotations": [{"id": k, "image_id": i, "category_id": 1, "bbox": b} for k, i, b in boxes], "categories": CATS}
    files.save_json(doc, tmp_path / "a.json")
    commands.tile(spark, str(tmp_path / "a.json"), str(tmp_path / "t"), patch=128, overlap=0.5, min_visible=0.99)
    tiles = json.loads((tmp_path / "t/annotations.json").read_text())
    assert tiles["info"] == {"description": "tiles"} and len(tiles["categories"]) == 3 and [i["id"] for i in tiles["images"]] == list(range(1, len(tiles["images"]) + 1))
    pred = [{"image_id": a["image_id"], "category_id": a["category_id"], "bbox": a["bbox"], "score": 0.5 + a["id"] / 1000} for a in tiles["annotations"]]
    assert len(pred) > len(boxes)
    (tmp_path / "p").mkdir()
    for k in range(3):
        (tmp_path / f"p/{k}.json").write_text(json.dumps(pred[k::3]))
    read = files.read_predictions(spark, str(tmp_path / "p")).orderBy("det_id").collect()
    assert [r.det_id for r in read] == list(range(len(pred))) and [r.score for r in read] == [p["score"] for k in range(3) for p in pred[k::3]]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 1)
    try:
        for patches in ("t/annotations.json", "t"):
            assert commands.merge(spark, str(tmp_path / patches), str(tmp_path / "p"), str(tmp_path / "m")) == len(boxes)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(list((tmp_path / "m").glob("part-*"))) == len(boxes)
    payload = commands.measure(spark, str(tmp_path / "a.json"), str(tmp_path / "m"), str(tmp_path / "r/metrics.json"))
    assert (payload["metrics"]["overall_tp"], payload["metrics"]["overall_fp"], payload["metrics"]["overall_fn"]) == (len(boxes), 0, 0)
    assert main(["run", "--gt", str(tmp_path / "a.json"), "--predictions", f"yolo={tmp_path}/m", "--out", str(tmp_path / "all")], spark) == 0
    assert json.loads((tmp_path / "all/yolo/metrics.json").read_text()) == payload and (tmp_path / "all/comparison/comparison.md").exists()
    for text in ('[{"image_id": 1}', '{"image_id": 1}\nnonsense', '[{"image_id": 1}] more'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(Exception, match="not a detection"):
            files.read_predictions(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "none.json").write_text("")
    assert files.read_predictions(spark, str(tmp_path / "none.json")).count() == 0
    stray = [{"image_id": 77, "category_id": 1, "bbox": [0, 0, 5, 5], "score": 0.5}]
    (tmp_path / "stray.json").write_text(json.dumps(stray))
    with pytest.raises(Exception, match="unknown image_id"):
        commands.measure(spark, str(tmp_path / "a.json"), str(tmp_path / "stray.json"), str(tmp_path / "r2/metrics.json"))


def test_missing_image_file(spark, export, tmp_path):
    (export / "valid" / "x_jpg.rf.bb.jpg").unlink()
    with pytest.raises(FileNotFoundError, match="x_jpg.rf.bb.jpg"):
        commands.prepare_export(spark, str(export), str(tmp_path / "o"))


def test_truncated_image_is_unreadable():
    whole = png(30, 20, "x")
    assert files.header_size(whole) == (30, 20)
    assert [files.header_size(whole[:k]) for k in (30, len(whole) - 20, len(whole) - 1)] == [None] * 3
    assert files.header_size(whole.replace(b"note", b"nope")) is None
