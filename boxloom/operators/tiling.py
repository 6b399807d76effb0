"""Sliding-window tiles of images, and the annotations seen in each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.boxes import intersection, num, visible_fraction
from boxloom.plans.prefix import row_numbers


def stride_of(patch: int, overlap: float) -> int:
    """Whole pixels between two tiles; overlap is a share of the tile from 0 to below 1."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    return max(1, int(patch * (1 - overlap)))


def origins(length: Column, patch: int, stride: int) -> Column:
    """Where the tiles of an axis start: every stride pixels, and one flush with the end."""
    last = length - F.lit(patch)
    many = F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), F.array(last)))
    return F.when(length <= patch, F.array(F.lit(0))).otherwise(many)


def tiles(images: DataFrame, patch: int = 640, overlap: float = 0.2) -> DataFrame:
    """(image_id, tx, ty, tw, th) of every tile. Images without a positive size have none."""
    step = stride_of(patch, overlap)
    known = images.where("width > 0 and height > 0").select("image_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    rows = known.withColumn("ty", F.explode(origins(F.col("height"), patch, step)))
    cells = rows.withColumn("tx", F.explode(origins(F.col("width"), patch, step)))
    return cells.select("image_id", "tx", "ty", F.least(F.lit(patch), F.col("width") - F.col("tx")).alias("tw"), F.least(F.lit(patch), F.col("height") - F.col("ty")).alias("th"))


def _covered(at: Column, size: Column, length: Column, patch: int, stride: int) -> Column:
    """Origins of the tiles that a box may meet on an axis: those of the grid around it, and the flush one."""
    last = F.greatest(length - patch, F.lit(0))
    lo = F.greatest(F.lit(0), F.ceil((at - patch) / stride)).cast("int")
    hi = F.least(F.floor((at + size) / stride), F.floor(last / stride)).cast("int")
    near = F.when(lo <= hi, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(near, F.array(last.cast("int"))))


def tile_annotations(images: DataFrame, annotations: DataFrame, patch: int = 640, overlap: float = 0.2, min_visible: float = 0.3) -> DataFrame:
    """(image_id, tx, ty, ann_id, category_id, x, y, w, h, visible): boxes cut to the tiles that show enough of them.

    Each box goes to the few tiles it can meet; no image's boxes are compared with all of its tiles.
    """
    step = stride_of(patch, overlap)
    known = images.where("width > 0 and height > 0").select("image_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    a = annotations.select("image_id", "ann_id", "category_id", "x", "y", "w", "h").join(known, "image_id")
    a = a.withColumn("ty", F.explode(_covered(F.col("y"), F.col("h"), F.col("height"), patch, step)))
    a = a.withColumn("tx", F.explode(_covered(F.col("x"), F.col("w"), F.col("width"), patch, step)))
    tw, th = F.least(F.lit(patch), F.col("width") - F.col("tx")), F.least(F.lit(patch), F.col("height") - F.col("ty"))
    part = intersection((F.col("x"), F.col("y"), F.col("w"), F.col("h")), (F.col("tx").cast("double"), F.col("ty").cast("double"), tw.cast("double"), th.cast("double")))
    a = a.withColumn("part", part).where("part is not null").withColumn("visible", visible_fraction(F.col("part"), F.col("w"), F.col("h")))
    kept = a.where(F.col("visible") >= num(min_visible))
    return kept.select("image_id", "tx", "ty", "ann_id", "category_id", (F.col("part.x") - F.col("tx")).alias("x"), (F.col("part.y") - F.col("ty")).alias("y"), F.col("part.w").alias("w"), F.col("part.h").alias("h"), "visible")


def sampled_tiles(images: DataFrame, annotations: DataFrame, patch: int = 640, overlap: float = 0.2, min_visible: float = 0.3, negative_ratio: float = 0.5, seed: int = 42, keep_all: bool = False) -> DataFrame:
    """(patch_id, image_id, tx, ty, tw, th, positive): all tiles with a box, and of the others as many as the ratio allows.

    The others go by a hash of the seed and the tile. patch_id counts from 1 by image, row and column.
    """
    if negative_ratio < 0:
        raise ValueError("negative_ratio must be at least 0")
    shown = tile_annotations(images, annotations, patch, overlap, min_visible).select("image_id", "tx", "ty").distinct().withColumn("positive", F.lit(True))
    all_tiles = tiles(images, patch, overlap).join(shown, ["image_id", "tx", "ty"], "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    if not keep_all:
        key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "image_id", "tx", "ty")), 1, 15), 16, 10).cast("bigint")
        n_pos = all_tiles.where("positive").count()
        ranked = row_numbers(all_tiles.where("not positive").withColumn("key", key), [], [F.col("key"), F.col("image_id"), F.col("ty"), F.col("tx")], "rank")
        few = ranked.where(F.col("rank") <= math.ceil(n_pos * negative_ratio)).select(*all_tiles.columns)
        all_tiles = all_tiles.where("positive").unionByName(few)
    numbered = row_numbers(all_tiles, [], [F.col("image_id"), F.col("ty"), F.col("tx")], "patch_id")
    return numbered.select("patch_id", "image_id", "tx", "ty", "tw", "th", "positive")


def tile_dataset(images: DataFrame, annotations: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of the tiled dataset. images also has file_name, annotations iscrowd if known."""
    t = sampled_tiles(images, annotations, **how)
    cut = {k: how[k] for k in ("patch", "overlap", "min_visible") if k in how}
    stem = F.regexp_replace(F.element_at(F.split("file_name", "/"), -1), r"(?<=.)\.[^.]*$", "")
    name = F.concat(stem, F.lit("__src"), F.col("image_id"), F.lit("_x"), F.col("tx"), F.lit("_y"), F.col("ty"), F.lit(".jpg"))
    img = t.join(images.select("image_id", "file_name"), "image_id")
    out = img.select(F.col("patch_id").alias("id"), name.alias("file_name"), F.col("tw").alias("width"), F.col("th").alias("height"), F.col("image_id").alias("source_image_id"), F.col("file_name").alias("source_file_name"), F.col("tx").alias("patch_x"), F.col("ty").alias("patch_y"))
    seen = tile_annotations(images, annotations, **cut).join(t.select("patch_id", "image_id", "tx", "ty"), ["image_id", "tx", "ty"])
    crowd = annotations.select("ann_id", F.coalesce("iscrowd", F.lit(0)).alias("iscrowd")) if "iscrowd" in annotations.columns else None
    seen = seen.join(crowd, "ann_id") if crowd is not None else seen.withColumn("iscrowd", F.lit(0))
    ids = row_numbers(seen, [], [F.col("patch_id"), F.col("ann_id")], "id")
    ann = ids.select("id", F.col("patch_id").alias("image_id"), "category_id", F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), "iscrowd", F.col("ann_id").alias("source_annotation_id"), F.col("visible").alias("visible_fraction"))
    return out, ann
