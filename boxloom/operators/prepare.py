"""From a raw export to cleaned splits that share no source."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.boxes import clip, out_of_bounds
from boxloom.operators.deal import dealt
from boxloom.plans.prefix import row_numbers
from boxloom.plans.shared import Scratch, bounded, small

SPLITS = ("train", "val", "test")
RATIOS = {"train": 0.75, "val": 0.15, "test": 0.10}
FOLD = 2_000_000  # groups that one task shuffles for order mt; each is a few numbers


def source_group(file_name: Column) -> Column:
    """Name of the photo an exported file was made from: no folder, export hash or doubled extension, lower case."""
    base = F.substring_index(file_name, "/", -1)
    plain = F.regexp_replace(base, r"(?i)\.rf\.[0-9a-f]+(?=\.[^.]+$)", "")
    return F.lower(F.regexp_replace(plain, r"(?i)_jpg\.jpg$", ""))


def own_group(file_name: Column, image_id: Column) -> Column:
    """The source group, or a group of its own for an image without a file name."""
    return F.coalesce(source_group(file_name), F.concat(F.lit("id:"), image_id.cast("string")))


def group_summaries(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(grp, n_images, first, classes): images: image_id, grp. classes: map of category to boxes; first: least image_id."""
    n = images.groupBy("grp").agg(F.count("*").alias("n_images"), F.min("image_id").alias("first"))
    c = annotations.join(images.select("image_id", "grp"), "image_id").groupBy("grp", "category_id").agg(F.count("*").alias("n"))
    m = c.groupBy("grp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category_id", "n")))).alias("classes"))
    return n.join(m, "grp", "left")


def group_strata(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(grp, n_images, rarest): the class of a group's boxes that has fewest in all, the least id of several; -1 without any."""
    n = images.groupBy("grp").agg(F.count("*").alias("n_images"))
    c = annotations.where("category_id is not null").join(images.select("image_id", "grp"), "image_id").groupBy("grp", "category_id").agg(F.count("*").alias("n"))
    c = Scratch(images.sparkSession, "classes").cut(c)  # read twice below
    rare = c.join(small(c.groupBy("category_id").agg(F.sum("n").alias("total"))), "category_id")
    rare = rare.groupBy("grp").agg(F.min(F.struct("total", "category_id")).alias("v")).select("grp", F.col("v.category_id").alias("rarest"))
    return n.join(rare, "grp", "left").select("grp", "n_images", F.coalesce("rarest", F.lit(-1).cast("bigint")).alias("rarest"))


def rarity(c: dict[int, int], total: dict[int, int]) -> float:
    return float(sum(v / max(total[k], 1) for k, v in c.items()))


def _checked(ratios: dict[str, float]) -> None:
    if abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("split ratios must sum to 1")


def least_full(groups: Iterable[tuple], ratios: dict[str, float] = RATIOS, seed: int = 42) -> list[tuple[str, str]]:
    """(group, split) of (group, images, first, classes) summaries: the seeded rule of order mt.

    The fixed rule: a seeded shuffle of the groups by first appearance, a stable sort by falling images and rarity, then
    each group to the split it leaves least full, 0.35 of the share of images and 0.65 of the mean share of its classes.
    """
    _checked(ratios)
    todo = pd.DataFrame([(g, int(n), f, {k: int(v) for k, v in dict(c or {}).items()}) for g, n, f, c in groups], columns=["g", "n", "first", "c"]).sort_values(["first", "g"])
    rows = list(todo.itertuples(index=False))
    random.Random(seed).shuffle(rows)
    total = Counter()
    for r in rows:
        total.update(r.c)
    cap = {s: (max(ratios[s] * sum(r.n for r in rows), 1), {k: max(v * ratios[s], 1) for k, v in total.items()}) for s in SPLITS}
    have, out = {s: [0, Counter()] for s in SPLITS}, []
    for r in sorted(rows, key=lambda r: (r.n, rarity(r.c, total)), reverse=True):
        def load(s: str, r=r) -> float:
            shares = [(have[s][1][k] + v) / cap[s][1][k] for k, v in r.c.items()]
            return 0.35 * (have[s][0] + r.n) / cap[s][0] + 0.65 * (sum(shares) / max(len(shares), 1))

        to = min(SPLITS, key=load)
        have[to][0] += r.n
        have[to][1].update(r.c)
        out.append((r.g, to))
    return out


def group_split(images: DataFrame, annotations: DataFrame, ratios: dict[str, float] = RATIOS, seed: int = 42, order: str = "hash", fold: int = FOLD) -> DataFrame:
    """(grp, split) of every group.

    By hash, at any size: groups are stratified by the band of their size and their rarest class, and dealt systematically
    (operators/deal.py); groups and classes come out in the ratios. Order mt gives the seeded result of a sequential rule
    (least_full) in one task; of more than fold groups it is refused. A null group is left out: see own_group.
    """
    _checked(ratios)
    images = images.where("grp is not null")
    if order != "mt":
        return dealt(group_strata(images, annotations), "grp", "n_images", ["rarest"], {n: ratios[n] for n in SPLITS}, seed)
    t = Scratch(images.sparkSession, "groups").cut(group_summaries(images, annotations))
    if not bounded(t, fold):
        raise ValueError(f"order mt shuffles all groups in one task, at most {fold} of them; take order hash")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(least_full(zip(pdf["grp"], pdf["n_images"], pdf["first"], pdf["classes"], strict=True), ratios, seed), columns=["grp", "split"])

    return t.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(run, "grp string, split string")


def clipped_boxes(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """(ann_id, image_id, category_id, x, y, w, h, was_outside): boxes cut to their image; what is empty then,
    or in an image of unknown size, has no row."""
    j = annotations.join(images.where("width is not null and height is not null").select("image_id", "width", "height"), "image_id")
    args = [F.col(c) for c in ("x", "y", "w", "h", "width", "height")]
    j = j.withColumn("was_outside", out_of_bounds(*args)).withColumn("c", clip(*args)).where("c.w > 0 and c.h > 0")
    return j.select("ann_id", "image_id", "category_id", "c.x", "c.y", "c.w", "c.h", "was_outside")


def clip_report(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """(clipped, dropped): boxes over the border, those dropped later among them; boxes that are empty when cut."""
    j = annotations.join(images.where("width is not null and height is not null").select("image_id", "width", "height"), "image_id")
    args = [F.col(c) for c in ("x", "y", "w", "h", "width", "height")]
    c = clip(*args)
    return j.agg(F.count_if(out_of_bounds(*args)).alias("clipped"), F.count_if(~((c["w"] > 0) & (c["h"] > 0))).alias("dropped"))


def reindexed_images(images: DataFrame) -> DataFrame:
    """images (image_id, split, grp, file_name, ...) with new_id: from 1 in each split, by group and name."""
    return row_numbers(images, ["split"], [F.col("grp"), F.col("file_name"), F.col("image_id")], "new_id")


def reindexed_annotations(clipped: DataFrame, images: DataFrame) -> DataFrame:
    """(split, id, image_id, ann_id, ...): annotations from 1 in each split, by new image and old id. images: as above."""
    j = clipped.join(images.select("image_id", "split", "new_id"), "image_id").drop("image_id").withColumnRenamed("new_id", "image_id")
    return row_numbers(j, ["split"], [F.col("image_id"), F.col("ann_id")], "id")


def unused_categories(categories: DataFrame, annotations: DataFrame) -> DataFrame:
    """(category_id, name) of the categories that no annotation names."""
    return categories.join(annotations.select("category_id"), "category_id", "left_anti").select("category_id", "name")


def split_summary(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(split, images, annotations) of reindexed tables."""
    a = images.groupBy("split").agg(F.count("*").alias("images"))
    return a.join(annotations.groupBy("split").agg(F.count("*").alias("annotations")), "split", "left").select("split", "images", F.coalesce("annotations", F.lit(0)).alias("annotations"))


def export_records(splits: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of all source splits with source_split and grp; the class maps must be the same."""
    from boxloom.operators.views import class_map_differences

    names = list(splits)
    for other in names[1:]:
        if not class_map_differences(splits[names[0]][2], splits[other][2]).isEmpty():
            raise ValueError(f"category mapping differs in split {other}")
    img = ann = None
    for name, (i, a, _) in splits.items():
        i, a = i.withColumn("source_split", F.lit(name)).withColumn("grp", own_group(F.col("file_name"), F.concat_ws(":", F.lit(name), "image_id"))), a.withColumn("source_split", F.lit(name))
        img, ann = (i, a) if img is None else (img.unionByName(i), ann.unionByName(a))
    return img, ann


def cleaned(images: DataFrame, annotations: DataFrame, categories: DataFrame, ratios: dict[str, float] = RATIOS, seed: int = 42, order: str = "hash") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of the cleaned dataset: split, clipped, with new ids; unused classes removed."""
    img = images.join(group_split(images, annotations, ratios, seed, order), "grp")
    new = reindexed_images(img)
    ext = F.lower(F.regexp_extract("file_name", r"(\.[^./]+)$", 1))
    named = new.withColumn("new_name", F.concat(F.when(F.col("new_id") < 1_000_000, F.lpad(F.col("new_id").cast("string"), 6, "0")).otherwise(F.col("new_id").cast("string")), ext))
    ann = reindexed_annotations(clipped_boxes(annotations, images), new)
    used = categories.join(annotations.select("category_id").distinct(), "category_id", "left_semi")
    return named, ann, used.select("category_id", "name", F.lit("defect").alias("supercategory"))


def early_stop(history: DataFrame, patience: int = 10) -> DataFrame:
    """(epoch, val_loss, best, is_best, stale, stop) of a training run's history, one row an epoch.

    is_best: below all before. stale: epochs since the best. stop: the first epoch with stale at patience, and all after.
    A history may be long, so it is no single window: ranges of epochs have their own least losses, of which each takes
    those of the ranges before it. Epochs are distinct.
    """
    s = Scratch(history.sparkSession, "early-stop")
    ranged = history.select("epoch", "val_loss").repartitionByRange("epoch").withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid").orderBy("epoch")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    least = F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "epoch"))  # with the epoch that had it first
    lost = F.when(F.col("val_loss").isNull(), F.col("epoch"))
    local = s.cut(ranged.withColumns({"_low": F.min(least).over(upto), "_was": F.min(least).over(before), "_lost": F.max(lost).over(upto)}))
    totals = local.groupBy("_pid").agg(F.min("_low").alias("_l"), F.max("_lost").alias("_n"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = totals.select("_pid", F.min("_l").over(earlier).alias("_l"), F.max("_n").over(earlier).alias("_n"))
    h = local.join(F.broadcast(offsets), "_pid")
    h = h.withColumns({"_best": F.least("_low", "_l"), "_prior": F.least("_was", "_l"), "_lost": F.greatest("_lost", "_n")})
    h = h.withColumn("is_best", F.coalesce(F.col("val_loss") < F.col("_prior.val_loss"), F.lit(True)))
    h = h.withColumn("stale", (F.col("epoch") - F.greatest("_best.epoch", "_lost")).cast("bigint"))
    stopped = h.where(F.col("stale") >= patience).agg(F.min("epoch").alias("_stop"))
    h = h.crossJoin(F.broadcast(stopped))
    return h.select("epoch", "val_loss", F.col("_best.val_loss").alias("best"), "is_best", "stale", F.coalesce(F.col("epoch") >= F.col("_stop"), F.lit(False)).alias("stop"))
