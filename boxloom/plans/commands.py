"""Whole runs from files to files: prepare, validate, analyse, tile, convert, merge, evaluate, compare."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.operators import compare, nms, prepare, profile, quality, tiling, views
from boxloom.operators import matching as M
from boxloom.plans.detection import evaluate
from boxloom.plans.prefix import row_numbers
from boxloom.plans.shared import Scratch
from boxloom.sources import files
from boxloom.sources.tracking import Tracker


def merge_manifest(old: dict, new: dict) -> dict:
    """Entries of both; new ones count where a key is in both."""
    return {**old, **new}


def prepare_export(spark: SparkSession, source: str, out: str, ratios: dict[str, float] = prepare.RATIOS, seed: int = 42, order: str = "hash", place: str | None = "hardlink") -> dict:
    """Cleaned splits of an export: COCO per split, images placed under their new names, and the report, which is returned.

    out must be empty or missing. place None leaves the images where they are.
    """
    if abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("split ratios must sum to 1")
    if os.path.isdir(out) and os.listdir(out):
        raise FileExistsError(f"output folder must be empty: {out}")
    s = Scratch(spark, "prepare")
    img, ann, cats = files.read_export(spark, source)
    if place:
        for split in ("train", "valid", "test"):
            lost = files.missing_files(spark, img.where((F.col("source_split") == split) & F.col("file_name").isNotNull()), f"{source}/{split}").select("file_name").orderBy("file_name").limit(5).collect()
            if lost:
                raise FileNotFoundError(f"missing image files in {split}: {', '.join(r.file_name for r in lost)}")
    # ids repeat from split to split, so that images and annotations get one that doesn't
    tag = lambda i: F.concat_ws(":", "source_split", i)
    keyed = row_numbers(img.select("source_split", "grp", "file_name", "width", "height", "image_id", "ord"), [], [F.col("source_split"), F.col("ord")], "k")
    keyed = s.cut(keyed.withColumn("tag", tag("image_id")))
    boxes = ann.withColumn("tag", tag("image_id")).drop("image_id").join(keyed.select("tag", F.col("k").alias("image_id")), "tag")
    boxes = row_numbers(boxes, [], [F.col("image_id"), F.col("ord"), F.col("ann_id")], "key")
    boxes = s.cut(boxes.select(F.col("key").alias("ann_id"), F.col("ann_id").alias("source_annotation_id"), "image_id", "category_id", "x", "y", "w", "h", "iscrowd"))
    images = s.cut(keyed.select(F.col("k").alias("image_id"), "source_split", "grp", "file_name", "width", "height"))
    named, new, used = prepare.cleaned(images, boxes, cats.withColumnRenamed("id", "category_id"), ratios, seed, order)
    named, new, used = s.cut(named), s.cut(new.join(boxes.select("ann_id", "source_annotation_id", "iscrowd"), "ann_id")), s.cut(used)
    for split in prepare.SPLITS:
        i = named.where(F.col("split") == split).select(F.col("new_id").alias("id"), F.col("new_name").alias("file_name"), "width", "height", F.col("file_name").alias("source_file_name"), "source_split", F.col("grp").alias("source_group"))
        a = new.where(F.col("split") == split).select("id", "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), "iscrowd", "source_annotation_id")
        c = used.select(F.col("category_id").alias("id"), "name", "supercategory")
        files.write_coco(i, a, c, str(Path(out, "annotations", f"{split}.json")), {"description": "cleaned split"})
        if place:
            moved = named.where((F.col("split") == split) & F.col("file_name").isNotNull()).select("source_split", "file_name", "new_name")
            moved.foreachPartition(lambda rs, split=split: [files.place_file(Path(source, r.source_split, r.file_name), Path(out, split, "images", r.new_name), place) for r in rs])
    all_names = {r.id: r.name for r in cats.select("id", "name").collect()}
    kept = {r.category_id for r in used.select("category_id").collect()}
    clip = prepare.clip_report(boxes, images).first()
    classes: dict[str, dict[str, int]] = {}
    for r in new.groupBy("split", "category_id").agg(F.count("*").alias("n")).collect():
        classes.setdefault(r.split, {})[all_names[r.category_id]] = r.n
    report = {
        "source": str(Path(source).resolve()), "seed": seed, "ratios": ratios,
        "source_summary": {r.source_split: {"images": r.n} for r in images.groupBy("source_split").agg(F.count("*").alias("n")).collect()},
        "source_groups": images.select("grp").distinct().count(), "removed_empty_categories": [n for k, n in sorted(all_names.items()) if k not in kept], "clipped_boxes": clip.clipped,
        "output_summary": {r.split: {"images": r.images, "annotations": r.annotations, "classes": classes.get(r.split, {})} for r in prepare.split_summary(named, new).collect()},
    }
    for r in ann.groupBy("source_split").agg(F.count("*").alias("n")).collect():
        report["source_summary"].setdefault(r.source_split, {"images": 0})["annotations"] = r.n
    files.save_json(report, Path(out, "preparation_report.json"))
    return report


def validate(spark: SparkSession, images_dir: str | None, annotations: str, strict: bool = False) -> tuple[DataFrame, bool]:
    """The violations of a dataset, and whether it passes."""
    d = files.read_coco(spark, annotations)
    found = Scratch(spark, "validate").cut(quality.violations(d.images, d.annotations, d.categories, files.file_listing(spark, images_dir) if images_dir else None))
    return found, quality.passes(found, strict)


def analyse(spark: SparkSession, annotations: str, out: str, small_max: float = 0.01, medium_max: float = 0.05) -> dict:
    """annotations_scale, class_by_size and histogram as CSV folders and summary.json, which is returned."""
    d = files.read_coco(spark, annotations)
    scale = Scratch(spark, "scale").cut(profile.scales(d.annotations, d.images, views.category_index(d.categories), small_max, medium_max, strict=True))
    files.write_csv(scale, f"{out}/annotations_scale.csv")
    files.write_csv(profile.crosstab(scale).orderBy("class"), f"{out}/class_by_size.csv")
    files.write_csv(profile.histogram(scale), f"{out}/relative_area_histogram.csv")
    n = {k: {r.value: r.n for r in profile.value_counts(scale).where(F.col("kind") == k).orderBy(F.col("n").desc(), "value").collect()} for k in ("size_bin", "class")}
    cats = {str(r.id): r.name for r in d.categories.orderBy("id").collect()}
    summary = {"images": d.images.count(), "annotations": d.annotations.count(), "categories": cats, "small_max": small_max, "medium_max": medium_max, "size_counts": n["size_bin"], "class_counts": n["class"]}
    files.save_json(summary, Path(out, "summary.json"))
    return summary


def tile(spark: SparkSession, annotations: str, out: str, **how) -> tuple[DataFrame, DataFrame]:
    """The tiled dataset's images and annotations, written below out as Parquet and as annotations.json, which merge and
    evaluate read. how: as for sampled_tiles."""
    d = files.read_coco(spark, annotations)
    s = Scratch(spark, "tile")
    images, boxes = (s.cut(t) for t in tiling.tile_dataset(d.images, d.annotations, **how))
    images.write.mode("overwrite").parquet(f"{out}/images")
    boxes.write.mode("overwrite").parquet(f"{out}/annotations")
    files.write_coco(images, boxes, d.categories, f"{out}/annotations.json", {"description": "tiles"})
    return images, boxes


def convert(spark: SparkSession, splits: dict[str, tuple[str | None, str]], out: str, mode: str = "hardlink") -> None:
    """Label files, images and class maps of splits {name: (image folder or None, annotation file)}; the classes of the first count."""
    if not splits:
        raise ValueError("no split given")
    first = None
    for name, (folder, path) in splits.items():
        d = files.read_coco(spark, path)
        index = views.category_index(d.categories)
        first = first if first is not None else index
        files.write_labels(d.annotations, d.images, index, f"{out}/labels/{name}")
        if folder:
            files.place_files(d.images, folder, f"{out}/images/{name}", mode)
    files.write_dataset_yaml(first, list(splits), out)


def merge(spark: SparkSession, patch_annotations: str, predictions: str, out: str, threshold: float = 0.5, max_detections: int = 300) -> int:
    """Detections of tiles as detections of their images, written as JSON lines that evaluate reads; how many there are.

    patch_annotations: the annotations.json of tile, or the folder it wrote.
    """
    if os.path.isdir(f"{patch_annotations}/images"):
        patches = spark.read.parquet(f"{patch_annotations}/images").withColumnRenamed("id", "image_id")
    else:
        patches = files.read_coco(spark, patch_annotations).images
    patches = patches.select("image_id", "source_image_id", "patch_x", "patch_y")
    merged = nms.merge_patches(files.read_predictions(spark, predictions), patches, threshold, max_detections)
    merged.select("image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), "score").write.mode("overwrite").json(out)
    return spark.read.json(out).count()


def measure(spark: SparkSession, gt: str, pred: str, out: str, conf: float = 0.25, threshold: float = 0.5) -> dict:
    """The evaluation's report: metrics, values of each class, and what they rest on."""
    d, p = files.read_coco(spark, gt), files.read_predictions(spark, pred)
    s = Scratch(spark, "measure")
    g, p, i = s.cut(d.annotations), s.cut(p), s.cut(d.images.select("image_id", "width", "height"))
    g = g.withColumn("area", F.coalesce("area", F.col("w") * F.col("h")))
    metrics = {r.metric: r.value for r in evaluate(g, p, i, conf, threshold, strict=True).collect()}
    names = {r.id: r.name for r in d.categories.collect()}
    zero = {"tp": 0, "fp": 0, "fn": 0, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    by = {names[r.category_id]: {k: r[k] for k in zero} for r in M.counts(g, p, i, threshold, conf, [M.ALL]).collect() if r.category_id in names}
    payload = {"metrics": metrics, "per_class": {n: by.get(n, zero) for n in names.values()}, "definition": {"f1_confidence": conf, "iou_threshold": threshold, "relative_small_max": 0.01, "relative_medium_max": 0.05}}
    files.save_json(payload, out)
    return payload


def compare_experiments(spark: SparkSession, metrics: list[str], out: str) -> DataFrame:
    """comparison.csv (a folder) and comparison.md of metrics.json files."""
    flat = compare.flat_metrics(files.read_metrics(spark, metrics))
    table = compare.compared(flat)
    files.write_csv(table.coalesce(1), f"{out}/comparison.csv")
    Path(out, "comparison.md").write_text(compare.markdown(table), encoding="utf-8")
    files.write_csv(compare.bars(flat).coalesce(1), f"{out}/bars.csv")
    return table


def log_evaluation(spark: SparkSession, metrics: str, run_dir: str, tracking: str) -> int:
    """The numbers of an evaluation file brought into the log of the run in run_dir; how many. Without a run id none."""
    t = Tracker(spark, tracking)
    run = t.run_of(run_dir)
    if run is None:
        return 0
    values = {r.metric: r.value for r in compare.flat_metrics(files.read_metrics(spark, [metrics])).where("metric not like 'inference_%'").collect()}  # of one file
    t.metrics(run, values)
    return len(values)
