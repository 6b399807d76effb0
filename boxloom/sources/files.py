"""Files in and out: COCO JSON, prediction arrays, class maps, training CSV, configuration, labels, reports."""

from __future__ import annotations

import json
import os
import shutil
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.operators import compare, views
from boxloom.plans.prefix import row_numbers
from boxloom.plans.shared import Scratch

# ids are read as text: the files have them as numbers, as numbers with a point and as strings
_IMAGE = "struct<id:string,file_name:string,width:string,height:string,source_file_name:string,source_split:string,source_group:string,source_image_id:string,patch_x:string,patch_y:string>"
_ANN = "struct<id:string,image_id:string,category_id:string,bbox:array<double>,area:double,iscrowd:string,source_annotation_id:string,visible_fraction:double>"
_CAT = "struct<id:string,name:string,supercategory:string>"
COCO = f"images array<{_IMAGE}>, annotations array<{_ANN}>, categories array<{_CAT}>"
PREDICTION = "struct<image_id:string,category_id:string,bbox:array<double>,score:double>"


def _id(name: str) -> Column:
    """The bigint that a JSON id is, written as 7, 7.0 or "7"; null for anything else."""
    return F.expr(f"coalesce(try_cast({name} as bigint), try_cast(try_cast({name} as double) as bigint))")


class Dataset:
    """images (image_id, file_name, width, height, ord, ...), annotations (ann_id, image_id, category_id, x, y, w, h, area, iscrowd, ord, ...), categories (id, name, supercategory)."""

    def __init__(self, images: DataFrame, annotations: DataFrame, categories: DataFrame) -> None:
        self.images, self.annotations, self.categories = images, annotations, categories


def hidden(path: str) -> bool:
    """Whether Spark's own readers skip a file, as they do with names that start with _ or a point."""
    return path.rstrip("/").rpartition("/")[2][:1] in ("_", ".")


def hidden_text(spark: SparkSession, path: str) -> DataFrame:
    """value: the whole text of one file that Spark's readers skip, read by an executor."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for f in frames:
            texts = []
            for p in f["path"]:
                system, name = fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p)
                with system.open_input_stream(name) as s:
                    texts.append(s.read().decode("utf-8"))
            yield pd.DataFrame({"value": texts})

    return spark.createDataFrame([(path,)], "path string").mapInPandas(run, "value string")


def read_coco(spark: SparkSession, path: str) -> Dataset:
    """A COCO document, or several under one path pattern; ord is the order in the file.

    A document is parsed once: its parts are written to the shared folder as one table. A document without images,
    annotations or categories is an error; an empty list is not.
    """
    doc = spark.read.schema(COCO).json(path, multiLine=True) if not hidden(path) else hidden_text(spark, path).select(F.from_json("value", COCO).alias("d")).select("d.*")
    missing = F.raise_error(F.lit(f"{path}: images, annotations or categories missing"))
    none = {"i": _IMAGE, "a": _ANN, "c": _CAT}
    part = lambda list_, name: F.transform(list_, lambda v, k: F.struct(k.alias("ord"), *[v.alias(n) if n == name else F.lit(None).cast(t).alias(n) for n, t in none.items()]))
    rows = F.concat(part(F.col("images"), "i"), part(F.col("annotations"), "a"), part(F.col("categories"), "c"))
    fine = F.col("images").isNotNull() & F.col("annotations").isNotNull() & F.col("categories").isNotNull()
    kind = ", ".join(f"{n}: {t}" for n, t in none.items())
    one = doc.select(F.explode(F.when(fine, rows).otherwise(missing.cast(f"array<struct<ord: int, {kind}>>"))).alias("v")).select("v.*")
    one = Scratch(spark, "coco").cut(one)
    i = one.where("i is not null").select("ord", "i.*").select(_id("id").alias("image_id"), "file_name", *[_id(c).cast("int").alias(c) for c in ("width", "height", "patch_x", "patch_y")], _id("source_image_id").alias("source_image_id"), "source_file_name", "source_split", "source_group", "ord")
    a = one.where("a is not null").select("ord", "a.*").select(
        _id("id").alias("ann_id"), _id("image_id").alias("image_id"), _id("category_id").alias("category_id"), *[F.get("bbox", F.lit(k)).alias(c) for k, c in enumerate("xywh")],
        "area", F.coalesce(_id("iscrowd").cast("int"), F.lit(0)).alias("iscrowd"), _id("source_annotation_id").alias("source_annotation_id"), "visible_fraction", "ord",
    )
    c = one.where("c is not null").select("c.*").select(_id("id").alias("id"), "name", "supercategory")
    return Dataset(i, a, c)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """det_id, image_id, category_id, x, y, w, h, score of detections in JSON: arrays, or a line for each, in one file or
    a folder of them, as merge writes them. det_id counts from 0 over all files, by name and place in the file.

    Arrays are read whole, lines by ranges. Text that isn't a detection is an error; an empty file or array has none.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").where(F.trim("value") != "")
    head = lines.select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    bad = F.raise_error(F.concat(F.lit(f"{path}: not a detection or an array of them: "), F.substring("value", 1, 80)))
    if head is not None and head.c == "[":
        text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"), "_metadata.file_path").where("value <> ''")
        kind = f"array<{PREDICTION}>"
        whole = F.when(F.col("value").endswith("]"), F.from_json("value", kind))
        rows = text.select("file_path", F.posexplode(F.coalesce(whole, bad.cast(kind))).alias("place", "v"))
        rows = rows.select("file_path", F.lit(0).cast("bigint").alias("at"), F.col("place").cast("bigint").alias("place"), "v")
    else:
        parsed = lines.withColumn("d", F.from_json("value", PREDICTION))
        v = F.when(F.col("d.image_id").isNotNull(), F.col("d")).otherwise(bad.cast(PREDICTION))  # what can't be parsed has nulls only
        rows = parsed.select("file_path", F.col("file_block_start").alias("at"), F.monotonically_increasing_id().alias("place"), v.alias("v"))
    number = row_numbers(rows, [], [F.col("file_path"), F.col("at"), F.col("place")], "n").select((F.col("n") - 1).alias("det_id"), "v.*")
    return number.select("det_id", _id("image_id").alias("image_id"), _id("category_id").alias("category_id"), *[F.get("bbox", F.lit(k)).alias(c) for k, c in enumerate("xywh")], "score")


def read_export(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "valid", "test")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images and annotations of <root>/<split>/_annotations.coco.json with source_split and grp, and the categories.

    Image ids may be the same in two splits: the key is (source_split, image_id). Class maps that differ are an error.
    """
    from boxloom.operators.prepare import export_records

    sets = {}
    for s in splits:
        path = Path(root, s, "_annotations.coco.json")
        if "://" not in root and not path.exists():
            raise FileNotFoundError(f"missing annotation file: {path}")
        sets[s] = read_coco(spark, f"{root}/{s}/_annotations.coco.json")
    img, ann = export_records({s: (d.images, d.annotations, d.categories) for s, d in sets.items()})
    return img, ann, sets[splits[0]].categories


def missing_files(spark: SparkSession, images: DataFrame, folder: str) -> DataFrame:
    """The images whose file isn't in the folder. Only the listing is read, not the content."""
    have = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    prefix = folder.rstrip("/") + "/"
    name = F.substring_index(F.col("path"), prefix, -1)
    return images.join(have.select(name.alias("file_name")).distinct(), "file_name", "left_anti")


def file_listing(spark: SparkSession, folder: str, size_of=None) -> DataFrame:
    """(file_name, width, height, sha256) of every file. size_of(bytes) gives (width, height) or None if unreadable.

    Without it PNG and JPEG headers are read.
    """
    probe = size_of or header_size
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sizes = [probe(bytes(c)) or (None, None) for c in f["content"]]
            out = pd.DataFrame({"file_name": f["file_name"], "width": pd.array([s[0] for s in sizes], "Int32"), "height": pd.array([s[1] for s in sizes], "Int32"), "sha256": f["sha256"]})
            yield out

    return files.select(name.alias("file_name"), "content", F.sha2("content", 256).alias("sha256")).mapInPandas(run, "file_name string, width int, height int, sha256 string")


def header_size(content: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG or JPEG file that is all there: each chunk of a PNG with its checksum up to the end mark,
    the markers of a JPEG up to its scan, and its end mark. None for anything else; pixels are not decoded."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at, size = 8, None
        while at + 12 <= len(content):
            n, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
            if at + 12 + n > len(content) or zlib.crc32(content[at + 4 : at + 8 + n]) != int.from_bytes(content[at + 8 + n : at + 12 + n], "big"):
                return None
            if kind == b"IHDR":
                size = int.from_bytes(content[at + 8 : at + 12], "big"), int.from_bytes(content[at + 12 : at + 16], "big")
            if kind == b"IEND":
                return size
            at += 12 + n
        return None
    if content[:2] != b"\xff\xd8" or content.rstrip(b"\0")[-2:] != b"\xff\xd9":
        return None
    i = 2
    while i + 9 <= len(content):
        if content[i] != 0xFF:
            return None
        kind = content[i + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[i + 7 : i + 9], "big"), int.from_bytes(content[i + 5 : i + 7], "big")
        i += 2 + (0 if kind == 0xFF or 0xD0 <= kind <= 0xD9 else int.from_bytes(content[i + 2 : i + 4], "big")) - (kind == 0xFF)
    return None


def crops(spark: SparkSession, folder: str, tiles: DataFrame, cut: Callable[[bytes, int, int, int, int], bytes], out: str) -> int:
    """Tiles cut out of their images and written below out; how many. cut(bytes, x, y, w, h) gives the tile's bytes, by
    whatever image library there is. tiles: source_file_name, file_name, patch_x, patch_y, width, height."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1).alias("source_file_name"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                p = Path(out, r.file_name)
                p.parent.mkdir(parents=True, exist_ok=True)
                p.write_bytes(cut(bytes(r.content), int(r.patch_x), int(r.patch_y), int(r.width), int(r.height)))
            yield pd.DataFrame({"n": [len(f)]})

    return tiles.join(named, "source_file_name").mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """(idx, category_id) of a class map file, whichever of its two key names it has."""
    text = spark.read.text(path, wholetext=True)
    m = lambda k: F.from_json(F.get_json_object("value", f"$.{k}"), "map<string, bigint>")
    return text.select(F.explode(F.coalesce(m("yolo_id_to_coco_category_id"), m("idx0_to_coco_category_id"))).alias("k", "category_id")).select(F.col("k").cast("int").alias("idx"), "category_id")


def read_history(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """(run_id, step, metric, value) of a training CSV. Headers may have blanks; without an epoch the row's number counts."""
    rows = spark.read.csv(path, header=True)
    names = [c.strip() for c in rows.columns]
    if "epoch" not in names:
        # a training log is one small file; its rows are numbered in the order they stand there
        rows = rows.coalesce(1).withColumn("_row", F.monotonically_increasing_id() + 1)
    return compare.history_metrics(rows, run_id)


def read_metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(experiment, metrics, inference) texts of metrics.json files: the folder names the experiment; a sibling
    inference_metrics.json is taken along if there is one."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    m = spark.read.text(paths, wholetext=True).select(folder.alias("experiment"), F.col("value").alias("metrics"))
    beside = [p for p in (str(Path(p).with_name("inference_metrics.json")) for p in paths) if os.path.exists(p)]
    if not beside:
        return m.withColumn("inference", F.lit(None).cast("string"))
    i = spark.read.text(beside, wholetext=True).select(folder.alias("experiment"), F.col("value").alias("inference"))
    return m.join(i, "experiment", "left")


def save_json(data: object, path: str | Path) -> None:
    """UTF-8, two blanks of indent, non-ASCII as it is; folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, ensure_ascii=False, indent=2), encoding="utf-8")


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, info: dict | None = None) -> int:
    """A COCO document, streamed to the file by one task from rows sorted by id; how many rows it has.

    images: id (or image_id), file_name, ...; annotations: id, image_id, category_id, bbox, ..., or as a Dataset has them;
    categories: id, ... Columns that are null are left out. Nothing is collected; for a dataset that no single file should
    hold see write_coco_lines.
    """
    images = images if "id" in images.columns else images.withColumnRenamed("image_id", "id")
    if "ann_id" in annotations.columns:
        area = F.coalesce("area", F.col("w") * F.col("h")) if "area" in annotations.columns else F.col("w") * F.col("h")
        crowd = F.coalesce("iscrowd", F.lit(0)) if "iscrowd" in annotations.columns else F.lit(0)
        annotations = annotations.select(F.col("ann_id").alias("id"), "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), area.alias("area"), crowd.alias("iscrowd"))
    row = lambda d, k: d.select(F.lit(k).alias("k"), F.col("id").cast("bigint").alias("id"), F.to_json(F.struct(*d.columns)).alias("v"))
    rows = row(images, 0).unionByName(row(annotations, 1)).unionByName(row(categories, 2)).repartition(1).sortWithinPartitions("k", "id", "v")
    head = json.dumps(info or {}, ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Path(f"{path}.{os.getpid()}.part")  # moved when complete, so a task that runs again leaves no half
        own.parent.mkdir(parents=True, exist_ok=True)
        names, at, n, fresh = ("images", "annotations", "categories"), -1, 0, True
        with own.open("w", encoding="utf-8") as f:
            f.write('{\n"info": ' + head)

            def upto(k: int) -> None:
                nonlocal at, fresh
                while at < k:
                    at, fresh = at + 1, True
                    f.write(("\n]" if at else "") + (f',\n"{names[at]}": [' if at < 3 else "\n}\n"))

            for b in batches:
                for k, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    upto(k)
                    f.write(("\n" if fresh else ",\n") + v)
                    fresh, n = False, n + 1
            upto(3)
        os.replace(own, path)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return rows.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_coco_lines(images: DataFrame, annotations: DataFrame, path: str) -> None:
    """The same at any size: a JSON line for each image with its annotations, in as many files as there are partitions."""
    a = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ann_id", "category_id", F.array("x", "y", "w", "h").alias("bbox")))).alias("annotations"))
    images.join(a, "image_id", "left").write.json(path)


def write_labels(annotations: DataFrame, images: DataFrame, index: DataFrame, folder: str) -> None:
    """One text file for each image, below a folder that all executors share; sub-folders of names are kept."""
    def put(rows) -> None:
        for r in rows:
            p = Path(folder, r.file_name)
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(r.content, encoding="utf-8")

    views.label_files(annotations, images, index).foreachPartition(put)


def place_file(source: Path, target: Path, mode: str = "hardlink") -> None:
    """One file linked or copied; one that is there already stays. A link that can't be made is a copy."""
    if mode not in ("hardlink", "symlink", "copy"):
        raise ValueError("mode must be hardlink, symlink or copy")
    target.parent.mkdir(parents=True, exist_ok=True)
    if target.exists() or target.is_symlink():
        return
    if mode != "copy":
        try:
            os.link(source, target) if mode == "hardlink" else os.symlink(source.resolve(), target)
            return
        except OSError:
            pass
    shutil.copy2(source, target)


def place_files(images: DataFrame, source: str, target: str, mode: str = "hardlink") -> None:
    """The images' files linked or copied to another folder, sub-folders kept."""
    images.select("file_name").foreachPartition(lambda rows: [place_file(Path(source, r.file_name), Path(target, r.file_name), mode) for r in rows])


def write_dataset_yaml(index: DataFrame, splits: list[str], folder: str) -> None:
    """dataset.yaml and category_mapping.json of a label export; index as of the first split."""
    import yaml

    rows = sorted(index.select("idx", "category_id", "name").collect())  # a row a class
    data = {"path": folder, **{s: f"images/{s}" if s in splits else None for s in ("train", "val", "test")}, "names": {r.idx: r.name for r in rows}}
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "dataset.yaml").write_text(yaml.safe_dump(data, sort_keys=False, allow_unicode=True), encoding="utf-8")
    save_json({"yolo_id_to_coco_category_id": {str(r.idx): r.category_id for r in rows}, "id2label": {str(r.idx): r.name for r in rows}}, Path(folder, "category_mapping.json"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_config(path: str | Path) -> dict:
    """A YAML mapping; the tracking store's and artifacts' relative places are taken from the configuration's project root."""
    import yaml

    path = Path(path).resolve()
    config = yaml.safe_load(path.read_text(encoding="utf-8"))
    if not isinstance(config, dict):
        raise ValueError(f"{path}: the configuration must be a mapping")
    root = project_root(path)
    tracking = config.get("tracking") or {}
    store = str(tracking.get("uri", ""))
    if store.startswith("sqlite:///") and not store.startswith("sqlite:////"):
        tracking["uri"] = f"sqlite:///{resolve(root, store.removeprefix('sqlite:///'))}"
    if tracking.get("artifact_root") and "://" not in str(tracking["artifact_root"]):
        tracking["artifact_root"] = str(resolve(root, tracking["artifact_root"]))
    return config


def project_root(config_path: str | Path) -> Path:
    return Path(config_path).resolve().parent.parent


def resolve(root: str | Path, value: str | Path) -> Path:
    """value itself if absolute, else below root."""
    return Path(value) if Path(value).is_absolute() else Path(root) / value
