"""Rules a dataset must keep, as one table of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR, WARNING = "error", "warning"


def _rows(df: DataFrame, severity: str, rule: str, entity: str, ident: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(entity).alias("entity"), ident.cast("string").alias("entity_id"), detail.cast("string").alias("detail"))


def violations(images: DataFrame, annotations: DataFrame, categories: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """(severity, rule, entity, entity_id, detail) of every breach.

    images: image_id, file_name, width, height. annotations: ann_id, image_id, category_id, x, y, w, h and ord, their
    order in the file. listing: file_name, width, height (null if it can't be read), sha256 of the files that exist;
    without it the rules on files are left out. Null references count as unknown; null boxes as without extent.
    """
    inside = images
    out = []
    if listing is not None:
        files = listing.select("file_name", F.col("width").alias("true_w"), F.col("height").alias("true_h"), "sha256", F.lit(True).alias("there"))
        j = images.join(files, "file_name", "left")
        out.append(_rows(j.where("there is null"), ERROR, "file_missing", "image", F.col("image_id"), F.col("file_name")))
        inside = j.where("there")
        out.append(_rows(inside.where("true_w is null or true_h is null"), ERROR, "file_unreadable", "image", F.col("image_id"), F.col("file_name")))
        off = inside.where("true_w is not null and not (true_w <=> width and true_h <=> height)")
        out.append(_rows(off, ERROR, "size_differs", "image", F.col("image_id"), F.concat_ws("x", "true_w", "true_h")))
        out.append(duplicate_content(inside.where("true_w is not null"), "image_id", "sha256"))
    out.append(_rows(inside.where("coalesce(width, 0) <= 0 or coalesce(height, 0) <= 0"), WARNING, "size_invalid", "image", F.col("image_id"), F.concat_ws("x", F.coalesce(F.col("width").cast("string"), F.lit("null")), F.coalesce(F.col("height").cast("string"), F.lit("null")))))
    names = images.where("file_name is not null").groupBy("file_name").agg(F.count("*").alias("n"))
    out.append(_rows(names.where("n > 1"), ERROR, "file_name_repeated", "image", F.col("file_name"), F.col("n")))
    seen = annotations.groupBy("ann_id").agg(F.count("*").alias("n"))
    repeats = seen.where("n > 1").select("ann_id", F.explode(F.sequence(F.lit(2).cast("bigint"), "n")).alias("k"))
    out.append(_rows(repeats, ERROR, "annotation_id_repeated", "annotation", F.col("ann_id"), F.col("k")))
    ids, cats = images.select("image_id").distinct(), categories.select(F.col("id").alias("category_id")).distinct()
    out.append(_rows(annotations.join(ids, "image_id", "left_anti"), ERROR, "image_unknown", "annotation", F.col("ann_id"), F.col("image_id")))
    out.append(_rows(annotations.join(cats, "category_id", "left_anti"), ERROR, "category_unknown", "annotation", F.col("ann_id"), F.col("category_id")))
    out.append(_rows(annotations.where("coalesce(w, 0) <= 0 or coalesce(h, 0) <= 0"), ERROR, "box_empty", "annotation", F.col("ann_id"), F.lit(None)))
    out.append(_rows(annotations.where("x < 0 or y < 0"), WARNING, "box_starts_outside", "annotation", F.col("ann_id"), F.lit(None)))
    size = images.groupBy("image_id").agg(F.max(F.struct("width", "height")).alias("s")).select("image_id", "s.width", "s.height")
    over = annotations.join(size, "image_id").where("x + w > width or y + h > height")
    out.append(_rows(over, WARNING, "box_exceeds", "annotation", F.col("ann_id"), F.lit(None)))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def duplicate_content(df: DataFrame, ident: str, digest: str) -> DataFrame:
    """A violation for each row whose content an earlier one, by ident, has; detail: the first owner."""
    first = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(ident).alias("owner"), F.count("*").alias("n")).where("n > 1")
    later = df.select(ident, digest).join(first, digest).where(F.col(ident) > F.col("owner"))
    return _rows(later, ERROR, "content_repeated", "image", F.col(ident), F.col("owner"))


def summary(found: DataFrame) -> DataFrame:
    """(severity, rule, n) of violations."""
    return found.groupBy("severity", "rule").agg(F.count("*").alias("n"))


def passes(found: DataFrame, strict: bool = False) -> bool:
    """Whether a dataset is fit: no error, and with strict no warning either."""
    return found.isEmpty() if strict else found.where(F.col("severity") == ERROR).isEmpty()


def messages(found: DataFrame, n: int = 50) -> DataFrame:
    """The first n violations of each severity, as shown to people."""
    w = Window.partitionBy("severity").orderBy("rule", "entity_id", "detail")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def leaking_groups(images: DataFrame, group: str = "source_group", split: str = "source_split") -> DataFrame:
    """(group, n_splits, n_images) of groups, or contents, that are in more than one split. Nulls are no group."""
    known = images.where(F.col(group).isNotNull() & F.col(split).isNotNull())
    per = known.groupBy(F.col(group).alias("grp"), F.col(split).alias("split")).agg(F.count("*").alias("n"))
    return per.groupBy("grp").agg(F.count("*").alias("n_splits"), F.sum("n").alias("n_images")).where("n_splits > 1")
