"""The detection tables as of now: the latest row of each id, boxes as four columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions.boxes import valid_box
from boxloom.plans.shared import table


def _latest(df: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    return df.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("_id")).agg(F.max(F.struct("received_at", *columns)).alias("v")).select(F.col("_id").alias(ident), *[f"v.{c}" for c in columns])


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, file_name, width, height, source_file_name, source_split, source_group of images not withdrawn."""
    cols = ["file_name", "width", "height", "source_file_name", "source_split", "source_group", "deleted_at"]
    return _latest(table(spark, sf_dir, "images"), "id", cols).where("deleted_at is null").drop("deleted_at").withColumnRenamed("id", "image_id")


def annotations(spark: SparkSession, sf_dir: str, valid: bool = True) -> DataFrame:
    """ann_id, image_id, category_id, x, y, w, h, area, iscrowd; only those with a valid box and both references unless told otherwise."""
    a = _latest(table(spark, sf_dir, "annotations"), "id", ["image_id", "category_id", "bbox", "area", "iscrowd"])
    a = a.where(valid_box(F.col("bbox")) & F.col("image_id").isNotNull() & F.col("category_id").isNotNull()) if valid else a
    return a.select(F.col("id").alias("ann_id"), "image_id", "category_id", *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")], "area", F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_id, image_id, category_id, x, y, w, h, score of the latest row of each detection, if its box is valid, its
    score is a number from 0 to 1 and it names an image and a category, existing or not. Experiments are taken together."""
    p = _latest(table(spark, sf_dir, "predictions"), "det_id", ["image_id", "category_id", "bbox", "score"])
    p = p.where(valid_box(F.col("bbox")) & F.col("score").between(0.0, 1.0) & F.col("image_id").isNotNull() & F.col("category_id").isNotNull())
    return p.select("det_id", "image_id", "category_id", *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")], "score")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category_id, name of categories not withdrawn."""
    return _latest(table(spark, sf_dir, "categories"), "id", ["name", "deleted_at"]).where("deleted_at is null").select(F.col("id").alias("category_id"), "name")


SQL = """im as (select id as image_id, file_name, width, height, source_file_name, source_split, source_group from (select * from images where id is not null qualify row_number() over (partition by id order by received_at desc) = 1) where deleted_at is null),
al as (select id as ann_id, image_id, category_id, bbox, area, coalesce(iscrowd, 0) as iscrowd from annotations where id is not null qualify row_number() over (partition by id order by received_at desc) = 1),
an as (select ann_id, image_id, category_id, bbox[1] as x, bbox[2] as y, bbox[3] as w, bbox[4] as h, area, iscrowd from al
  where len(bbox) = 4 and list_count(bbox) = 4 and isfinite(bbox[1]) and isfinite(bbox[2]) and isfinite(bbox[3]) and isfinite(bbox[4]) and bbox[3] > 0 and bbox[4] > 0 and image_id is not null and category_id is not null),
pr as (select det_id, image_id, category_id, bbox[1] as x, bbox[2] as y, bbox[3] as w, bbox[4] as h, score from
  (select * from predictions where det_id is not null qualify row_number() over (partition by det_id order by received_at desc) = 1)
  where len(bbox) = 4 and list_count(bbox) = 4 and isfinite(bbox[1]) and isfinite(bbox[2]) and isfinite(bbox[3]) and isfinite(bbox[4]) and bbox[3] > 0 and bbox[4] > 0
    and score between 0 and 1 and image_id is not null and category_id is not null),
ca as (select id as category_id, name from (select * from categories where id is not null qualify row_number() over (partition by id order by received_at desc) = 1) where deleted_at is null),
ci as (select category_id, (row_number() over (order by category_id) - 1)::int as idx, name from ca)"""
