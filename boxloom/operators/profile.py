"""What an annotation set looks like: sizes, classes, their distribution."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.boxes import num, relative_area, size_bin
from boxloom.plans.prefix import row_numbers, running_sums
from boxloom.plans.shared import Scratch, small


def scales(annotations: DataFrame, images: DataFrame, index: DataFrame, small_max: float = 0.01, medium_max: float = 0.05, strict: bool = False) -> DataFrame:
    """(annotation_id, image_id, class, bbox_area_px, relative_area, size_bin); dangling references are left out, or with strict an error."""
    if strict:
        lost = F.raise_error(F.concat(F.lit("annotation with unknown image or category: "), F.coalesce(F.col("ann_id").cast("string"), F.lit("null"))))
        known = annotations.join(images.select("image_id").distinct().withColumn("_i", F.lit(True)), "image_id", "left").join(small(index.select("category_id").distinct().withColumn("_c", F.lit(True))), "category_id", "left")
        annotations = known.withColumn("ann_id", F.when(F.col("_i").isNull() | F.col("_c").isNull(), lost.cast("bigint")).otherwise(F.col("ann_id")))
        annotations = Scratch(annotations.sparkSession, "strict").cut(annotations.select("ann_id", "image_id", "category_id", "w", "h"))  # so that the rows at fault aren't joined away
    j = annotations.join(images.select("image_id", "width", "height"), "image_id").join(small(index.select("category_id", "name")), "category_id")
    rel = relative_area(F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    return j.select(F.col("ann_id").alias("annotation_id"), "image_id", F.col("name").alias("class"), (F.col("w") * F.col("h")).alias("bbox_area_px"), rel.alias("relative_area"), size_bin(rel, small_max, medium_max).alias("size_bin"))


def value_counts(scale: DataFrame) -> DataFrame:
    """(kind, value, n) of size bins and classes."""
    part = lambda c: scale.groupBy(F.lit(c).alias("kind"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return part("size_bin").unionByName(part("class"))


def crosstab(scale: DataFrame) -> DataFrame:
    """class by size bin, zero-filled. The bins are fixed, so no extra pass looks for them."""
    cols = [F.count_if(F.col("size_bin") == b).alias(b) for b in ("large", "medium", "small")]
    return scale.groupBy("class").agg(*cols)


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The exact q-quantile of a column, between its two neighbours by linear interpolation; null values don't count.

    Distinct values are counted where they lie, then ranked by ranges; no task holds them all. None without any value.
    """
    s = Scratch(df.sparkSession, "quantile")
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    rank = running_sums(s.cut(v).withColumn("g", F.lit(0)), ["g"], [F.col("v")], {"upto": F.col("n")})
    n = rank.agg(F.max("upto")).first()[0]
    if not n:
        return None
    at = q * (n - 1)
    low, high = (rank.where(F.col("upto") > k).agg(F.min("v")).first()[0] for k in (math.floor(at), math.ceil(at)))
    return low + (high - low) * (at - math.floor(at))


def histogram(scale: DataFrame, column: str = "relative_area", upper: float = 0.99, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, n): equal-width bins of the values cut at a quantile, the last bin closed, empty bins as 0.

    The quantile is exact. An empty table gives no rows.
    """
    v = scale.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    top, low = F.lit(quantile(v, "v", upper)).cast("double"), v.agg(F.min("v")).scalar()
    known = lambda d: d.withColumn("q", top).withColumn("lo", F.least(low, "q")).withColumn("width", (F.col("q") - F.col("lo")) / bins)
    c = known(v).withColumn("c", F.least("v", "q"))
    i = F.when(F.col("width") > 0, F.least(F.floor((F.col("c") - F.col("lo")) / F.col("width")), F.lit(bins - 1))).otherwise(F.lit(bins // 2))
    n = c.groupBy(i.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = known(scale.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))).where("q is not null")
    return grid.join(n, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def winsorised(scale: DataFrame, column: str = "relative_area", upper: float = 0.99) -> DataFrame:
    """scale with the column cut at its exact quantile."""
    q = F.lit(quantile(scale, column, upper)).cast("double")
    return scale.withColumn(column, F.when(F.col(column).isNotNull(), F.least(F.col(column), q)))


def summary(annotations: DataFrame, images: DataFrame, scale: DataFrame) -> DataFrame:
    """(metric, value): images, annotations, and the counts of each size bin and class."""
    one = lambda d, name: d.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    parts = value_counts(scale).select(F.concat_ws(":", "kind", "value").alias("metric"), F.col("n").alias("value"))
    return one(images, "images").unionByName(one(annotations, "annotations")).unionByName(parts)


def latency(durations: DataFrame, order: str = "seq", seconds: str = "seconds", warmup: int = 10) -> DataFrame:
    """(images, warmup_images, latency_ms_mean, fps): the first warmup rows are left out; null without any other."""
    n = row_numbers(durations.select(F.col(order).alias("o"), F.col(seconds).alias("s")), [], [F.col("o")], "rn")
    rest = F.col("rn") > warmup
    a = n.agg(F.count_if(rest).alias("images"), F.count_if(~rest).alias("warmup_images"), F.avg(F.when(rest, F.col("s"))).alias("mean"), F.sum(F.when(rest, F.col("s"))).alias("total"))
    return a.select("images", "warmup_images", (F.col("mean") * num(1000)).alias("latency_ms_mean"), F.when(F.col("total") > 0, F.col("images") / F.col("total")).alias("fps"))
