"""Boxes derived from the order tables by integer arithmetic, the same in Spark and in SQL: ground truth and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.plans.prefix import row_numbers
from boxloom.plans.shared import table


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, width, height: one 640 x 640 image for each order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(640).alias("width"), F.lit(640).alias("height"))


_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ann_id, image_id, category_id, x, y, w, h (doubles), k: one box for each line of an order."""
    line = table(spark, sf_dir, "lineitem").select(*_ORDER)
    n = row_numbers(line, [], [F.col(c) for c in _ORDER], "ann_id")
    k = F.col("l_partkey")
    return n.select(
        "ann_id", F.col("l_orderkey").alias("image_id"), (k % 3).alias("category_id"), ((k * 37) % 560).cast("double").alias("x"), ((F.col("l_suppkey") * 53) % 560).cast("double").alias("y"),
        (F.col("l_quantity").cast("bigint") * 3 + 10).cast("double").alias("w"), ((k % 40) * 3 + 10).cast("double").alias("h"), k.alias("k"),
    )


def detections(gt: DataFrame) -> DataFrame:
    """det_id, image_id, category_id, x, y, w, h, score: up to three copies of each box, a little off; scores tie."""
    j, k = F.col("j"), F.col("k")
    c = gt.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where((k + j) % 4 != 0)
    return c.select(
        (F.col("ann_id") * 3 + j).alias("det_id"), "image_id", "category_id", (F.col("x") + (k * j) % 9 - 4).alias("x"), (F.col("y") + (k + j) % 7 - 3).alias("y"),
        (F.col("w") + (k % 5) * j).alias("w"), (F.col("h") + j).alias("h"), (((k * 31 + j * 17) % 100) / F.lit(100.0)).alias("score"),
    )


def patch_detections(pred: DataFrame, patch: int = 320) -> DataFrame:
    """The detections as if found in tiles: image_id names the tile, four to an image, and the box is in its pixels."""
    px, py = F.floor(F.greatest(F.lit(0.0), F.least(F.col("x"), F.lit(639.0))) / patch) * patch, F.floor(F.greatest(F.lit(0.0), F.least(F.col("y"), F.lit(639.0))) / patch) * patch
    return pred.withColumn("px", px).withColumn("py", py).select(
        "det_id", (F.col("image_id") * 4 + F.col("py") / patch * 2 + F.col("px") / patch).cast("bigint").alias("image_id"), "category_id", (F.col("x") - F.col("px")).alias("x"), (F.col("y") - F.col("py")).alias("y"), "w", "h", "score"
    )


def patches(img: DataFrame, patch: int = 320) -> DataFrame:
    """image_id of each tile, source_image_id, patch_x, patch_y."""
    q = img.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"))
    return q.select((F.col("image_id") * 4 + F.col("q")).alias("image_id"), F.col("image_id").alias("source_image_id"), ((F.col("q") % 2) * patch).alias("patch_x"), (F.floor(F.col("q") / 2) * patch).cast("int").alias("patch_y"))


SQL = """img as (select o_orderkey as image_id, 640 as width, 640 as height from orders),
gt as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as ann_id,
  l_orderkey as image_id, l_partkey % 3 as category_id, ((l_partkey * 37) % 560)::double as x, ((l_suppkey * 53) % 560)::double as y,
  (cast(l_quantity as bigint) * 3 + 10)::double as w, ((l_partkey % 40) * 3 + 10)::double as h, l_partkey as k from lineitem),
pred as (select ann_id * 3 + j as det_id, image_id, category_id, x + ((k * j) % 9) - 4 as x, y + ((k + j) % 7) - 3 as y, w + (k % 5) * j as w, h + j as h,
  ((k * 31 + j * 17) % 100) / 100.0::double as score from gt cross join (values (0), (1), (2)) v(j) where (k + j) % 4 <> 0)"""

IOU = """case when greatest(0, {a}.x + {a}.w - {a}.x) * greatest(0, {a}.y + {a}.h - {a}.y) + greatest(0, {b}.x + {b}.w - {b}.x) * greatest(0, {b}.y + {b}.h - {b}.y)
  - greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)) > 0
then greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))
  / (greatest(0, {a}.x + {a}.w - {a}.x) * greatest(0, {a}.y + {a}.h - {a}.y) + greatest(0, {b}.x + {b}.w - {b}.x) * greatest(0, {b}.y + {b}.h - {b}.y)
  - greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))
else 0::double end"""
