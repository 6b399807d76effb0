"""Training views and label lines of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.boxes import clip, fixed8, flip_x, yolo
from boxloom.plans.shared import small


def category_index(categories: DataFrame) -> DataFrame:
    """(category_id, idx, name): classes from 0 on by ascending id; categories are few, they are taken as one window."""
    one = categories.where("id is not null").groupBy(F.col("id").alias("category_id")).agg(F.max_by("name", F.struct("received_at", "name")).alias("name") if "received_at" in categories.columns else F.max("name").alias("name"))
    return one.select("category_id", (F.row_number().over(Window.orderBy("category_id")) - 1).alias("idx"), "name")


def yolo_labels(annotations: DataFrame, images: DataFrame, index: DataFrame) -> DataFrame:
    """(image_id, ann_id, line): class and box relative to the image, eight decimals; boxes or images without extent have none."""
    j = annotations.where("w > 0 and h > 0").join(images.where("width > 0 and height > 0"), "image_id").join(small(index.select("category_id", "idx")), "category_id")
    v = yolo(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")])
    return j.select("image_id", "ann_id", F.concat_ws(" ", F.col("idx").cast("string"), *[fixed8(c) for c in v]).alias("line"))


def label_files(annotations: DataFrame, images: DataFrame, index: DataFrame) -> DataFrame:
    """(image_id, file_name, content) of each image's label file; empty for an image without boxes.

    The lines of one image are one value, in the order of the annotations.
    """
    lines = yolo_labels(annotations, images, index).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ann_id", "line"))).alias("l"))
    text = F.coalesce(F.concat(F.array_join(F.col("l.line"), "\n"), F.lit("\n")), F.lit(""))
    return images.join(lines, "image_id", "left").select("image_id", F.regexp_replace("file_name", r"(?<=[^/])\.[^./]*$", "").alias("stem"), text.alias("content")).select("image_id", F.concat("stem", F.lit(".txt")).alias("file_name"), "content")


def clipped_view(annotations: DataFrame, images: DataFrame, index: DataFrame) -> DataFrame:
    """(image_id, ann_id, x1, y1, x2, y2, area, label): boxes with extent cut to the image, labels from 1 on."""
    known = images.where("width is not null and height is not null")
    j = annotations.where("w > 0 and h > 0").join(known, "image_id").withColumn("c", clip(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")]))
    j = j.where("c.w > 0 and c.h > 0").join(small(index.select("category_id", "idx")), "category_id")
    x2, y2 = F.col("c.x") + F.col("c.w"), F.col("c.y") + F.col("c.h")
    return j.select("image_id", "ann_id", F.col("c.x").alias("x1"), F.col("c.y").alias("y1"), x2.alias("x2"), y2.alias("y2"), (F.col("c.w") * F.col("c.h")).alias("area"), (F.col("idx") + 1).alias("label"))


def plain_view(annotations: DataFrame, index: DataFrame) -> DataFrame:
    """(image_id, ann_id, x, y, w, h, area, iscrowd, label): boxes with extent as they are, labels from 0 on."""
    j = annotations.where("w > 0 and h > 0").join(small(index.select("category_id", "idx")), "category_id")
    area = F.coalesce("area", F.col("w") * F.col("h")) if "area" in annotations.columns else F.col("w") * F.col("h")
    crowd = F.coalesce("iscrowd", F.lit(0)) if "iscrowd" in annotations.columns else F.lit(0)
    return j.select("image_id", "ann_id", "x", "y", "w", "h", area.alias("area"), crowd.alias("iscrowd"), F.col("idx").alias("label"))


def flipped(annotations: DataFrame, images: DataFrame, share: float = 1.0, seed: int = 42) -> DataFrame:
    """(image_id, ann_id, x1, x2): boxes after images are mirrored; an image is, by a hash of seed and id, or is not."""
    j = annotations.join(images.select("image_id", F.col("width").cast("double").alias("width")), "image_id")
    x1, x2 = flip_x(F.col("x"), F.col("w"), F.col("width"))
    chosen = F.pmod(F.xxhash64(F.lit(seed), "image_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    return j.select("image_id", "ann_id", F.when(chosen, x1).otherwise(F.col("x")).alias("x1"), F.when(chosen, x2).otherwise(F.col("x") + F.col("w")).alias("x2"))


def class_map_differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """(side, id, name) of categories that one of two splits has and the other has not; empty if the maps are equal."""
    a, b = one.select("id", "name").distinct(), other.select("id", "name").distinct()
    return a.exceptAll(b).select(F.lit("only_first").alias("side"), "id", "name").unionByName(b.exceptAll(a).select(F.lit("only_second").alias("side"), "id", "name"))


def per_image(images: DataFrame, boxes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """images with boxes: an array of structs of the columns for each, in order of ann_id; empty without any."""
    b = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ann_id", *columns))).alias("boxes"))
    j = images.join(b, "image_id", "left")
    return j.withColumn("boxes", F.coalesce("boxes", F.array().cast(b.schema["boxes"].dataType)))
