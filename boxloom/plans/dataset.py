"""Queries of profiling, checking, tiling and preparing datasets, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.operators import compare, deal, prepare, profile, quality, tiling, views
from boxloom.plans.detection import _round
from boxloom.plans.shared import table
from boxloom.sources import current as C


def _index(spark, d: str) -> DataFrame:
    return views.category_index(C.categories(spark, d).withColumnRenamed("category_id", "id"))


def _scale(spark, d: str) -> DataFrame:
    return profile.scales(C.annotations(spark, d), C.images(spark, d), _index(spark, d))


def relative_area_bins(spark, d: str) -> DataFrame:
    return _scale(spark, d)


def class_size_crosstab(spark, d: str) -> DataFrame:
    return profile.crosstab(_scale(spark, d))


def size_value_counts(spark, d: str) -> DataFrame:
    return profile.value_counts(_scale(spark, d))


def area_quantile_hist(spark, d: str) -> DataFrame:
    return profile.histogram(_scale(spark, d)).select("bin", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n")


def dataset_summary(spark, d: str) -> DataFrame:
    a, i = C.annotations(spark, d), C.images(spark, d)
    return profile.summary(a, i, profile.scales(a, i, _index(spark, d)))


def category_index(spark, d: str) -> DataFrame:
    return _index(spark, d)


def images_by_id(spark, d: str) -> DataFrame:
    return C.images(spark, d).na.fill(0, ["width", "height"])


def annotations_by_image(spark, d: str) -> DataFrame:
    """Of each image its number of annotations and their ids in order; images without any are there too."""
    a = C.annotations(spark, d).groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list("ann_id")), ",").alias("ann_ids"), F.count("*").alias("n"))
    return C.images(spark, d).select("image_id").join(a, "image_id", "left").select("image_id", F.coalesce("ann_ids", F.lit("")).alias("ann_ids"), F.coalesce("n", F.lit(0)).alias("n"))


def clip_boxes(spark, d: str) -> DataFrame:
    return _round(prepare.clipped_boxes(C.annotations(spark, d), C.images(spark, d)))


def clip_counts(spark, d: str) -> DataFrame:
    return prepare.clip_report(C.annotations(spark, d), C.images(spark, d))


def yolo_labels(spark, d: str) -> DataFrame:
    return views.yolo_labels(C.annotations(spark, d), C.images(spark, d), _index(spark, d))


def yolo_files(spark, d: str) -> DataFrame:
    return views.label_files(C.annotations(spark, d), C.images(spark, d), _index(spark, d)).select("image_id", "content")


def hflip_boxes(spark, d: str) -> DataFrame:
    return _round(views.flipped(C.annotations(spark, d), C.images(spark, d).where("width is not null")))


def train_view_xyxy(spark, d: str) -> DataFrame:
    return _round(views.clipped_view(C.annotations(spark, d), C.images(spark, d).where("width is not null and height is not null"), _index(spark, d)))


def train_view_plain(spark, d: str) -> DataFrame:
    return _round(views.plain_view(C.annotations(spark, d), _index(spark, d)))


def tile_positions(spark, d: str) -> DataFrame:
    return tiling.tiles(C.images(spark, d))


def tile_annotations(spark, d: str) -> DataFrame:
    return _round(tiling.tile_annotations(C.images(spark, d), C.annotations(spark, d)))


def tile_negative_sample(spark, d: str) -> DataFrame:
    return tiling.sampled_tiles(C.images(spark, d), C.annotations(spark, d))


def violations(spark, d: str) -> DataFrame:
    """Every row of the annotations is checked, also those that a later one of the same id replaces."""
    box = [F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")]
    ann = table(spark, d, "annotations").select(F.col("id").alias("ann_id"), "image_id", "category_id", *box)
    return quality.violations(C.images(spark, d), ann, C.categories(spark, d).withColumnRenamed("category_id", "id"))


def violation_counts(spark, d: str) -> DataFrame:
    return quality.summary(violations(spark, d))


def dup_content(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("image_id"), F.sha2("text", 256).alias("sha256"))
    return quality.duplicate_content(docs, "image_id", "sha256").select("entity_id", "detail")


def orphan_refs(spark, d: str) -> DataFrame:
    a = C.annotations(spark, d)
    i = a.join(C.images(spark, d).select("image_id"), "image_id", "left_anti").select("ann_id", F.lit("image_id").alias("ref_field"))
    c = a.join(C.categories(spark, d).select("category_id"), "category_id", "left_anti").select("ann_id", F.lit("category_id").alias("ref_field"))
    return i.unionByName(c)


def group_key(spark, d: str) -> DataFrame:
    return _grouped(spark, d).select("image_id", "grp")


def _grouped(spark, d: str) -> DataFrame:
    return C.images(spark, d).withColumn("grp", prepare.own_group(F.col("file_name"), F.col("image_id")))


def _given(spark, d: str) -> DataFrame:
    """The images with the split they came with, those without one as a split of their own."""
    return _grouped(spark, d).withColumn("split", F.coalesce(F.lower(F.trim("source_split")), F.lit("unknown")))


def group_split(spark, d: str) -> DataFrame:
    return prepare.group_split(_grouped(spark, d), C.annotations(spark, d))


def split_leakage(spark, d: str) -> DataFrame:
    i = C.images(spark, d).withColumn("source_split", F.lower(F.trim("source_split")))
    return quality.leaking_groups(i)


def reindex_ids(spark, d: str) -> DataFrame:
    return prepare.reindexed_images(_given(spark, d).select("split", "grp", "file_name", "image_id")).select("split", "image_id", "new_id")


def reindex_annotations(spark, d: str) -> DataFrame:
    new = prepare.reindexed_images(_given(spark, d).select("split", "grp", "file_name", "image_id"))
    return prepare.reindexed_annotations(prepare.clipped_boxes(C.annotations(spark, d), C.images(spark, d)), new).select("split", "id", "image_id", "ann_id")


def unused_categories(spark, d: str) -> DataFrame:
    return prepare.unused_categories(C.categories(spark, d), C.annotations(spark, d))


def prepared_summary(spark, d: str) -> DataFrame:
    img, ann, _ = prepare.cleaned(_grouped(spark, d), C.annotations(spark, d), C.categories(spark, d))
    return prepare.split_summary(img, ann)


def _events(spark, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("value").alias("seconds"))


def latency_stats(spark, d: str) -> DataFrame:
    a = profile.latency(_events(spark, d), "event_id", "seconds")
    return a.select("images", "warmup_images", F.round("latency_ms_mean", 4).alias("latency_ms_mean"), F.round("fps", 9).alias("fps"))


def early_stop(spark, d: str) -> DataFrame:
    h = table(spark, d, "events").select(F.col("event_id").alias("epoch"), F.round("value", 3).alias("val_loss"))
    return prepare.early_stop(h, 5)


def compare_runs(spark, d: str) -> DataFrame:
    e = table(spark, d, "events")
    m = e.select(F.col("event_type").alias("experiment"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("metric"), "value").groupBy("experiment", "metric").agg(F.max("value").alias("value"))
    return compare.compared(m, [f"m{i}" for i in range(5)])


def metric_sanitise(spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.lit("r").alias("run_id"), F.col("event_id").alias("step"), F.concat(F.lit(" "), "event_type", F.lit(":@ "), F.col("user_id").cast("string")).alias("metric"), F.when(F.col("event_id") % 7 == 0, "nan").when(F.col("event_id") % 7 == 1, "text").otherwise(F.col("value").cast("string")).alias("value"))
    return compare.loggable(e)


_Q = (relative_area_bins, class_size_crosstab, size_value_counts, area_quantile_hist, dataset_summary, category_index, images_by_id, annotations_by_image, clip_boxes, clip_counts, yolo_labels, yolo_files, hflip_boxes, train_view_xyxy, train_view_plain,
      tile_positions, tile_annotations, tile_negative_sample, violations, violation_counts, dup_content, orphan_refs, group_key, group_split, split_leakage, reindex_ids, reindex_annotations, unused_categories, prepared_summary, latency_stats, early_stop, compare_runs, metric_sanitise)
QUERIES = {f.__name__: f for f in _Q}

_W = f"with {C.SQL}"
_SCALE = f"""{_W},
sc as (select ann_id as annotation_id, an.image_id, name as class, w * h as bbox_area_px, case when width * height > 0 then w * h / (width * height)::double else 0 end as relative_area from an join im using (image_id) join ci using (category_id)),
scale as (select *, case when relative_area < 0.01::double then 'small' when relative_area < 0.05::double then 'medium' else 'large' end as size_bin from sc)"""
_CLIP = f"""{_W},
cl as (select ann_id, image_id, category_id, x < 0 or y < 0 or x + w > width or y + h > height as was_outside,
  least(greatest(x, 0), width) as x1, least(greatest(y, 0), height) as y1, least(greatest(x + w, 0), width) as x2, least(greatest(y + h, 0), height) as y2 from an join im using (image_id) where width is not null and height is not null)"""
_AXIS = "list_distinct(list_concat(case when {n} <= 640 then [0] else range(0, {n} - 640 + 1, 512) end, [greatest({n} - 640, 0)]))"
_TILES = f"""{_W},
tl as (select image_id, tx, ty, least(640, width - tx) as tw, least(640, height - ty) as th from (
  select image_id, width, height, unnest({_AXIS.format(n='width')}) as tx, ty from (select image_id, width, height, unnest({_AXIS.format(n='height')}) as ty from im where width > 0 and height > 0)))"""
_TANN = f"""{_TILES},
ov as (select tl.image_id, tx, ty, ann_id, category_id, greatest(x, tx) as x1, greatest(y, ty) as y1, least(x + w, tx + tw) as x2, least(y + h, ty + th) as y2, w, h from tl join an using (image_id)),
ta as (select image_id, tx, ty, ann_id, category_id, x1 - tx as x, y1 - ty as y, x2 - x1 as w, y2 - y1 as h, (x2 - x1) * (y2 - y1) / greatest(1e-9, w * h) as visible from ov where x2 > x1 and y2 > y1),
seen as (select * from ta where visible >= 0.3::double)"""
_LINE = "idx || ' ' || format('{:.8f} {:.8f} {:.8f} {:.8f}', (x + w / 2) / width, (y + h / 2) / height, w / width, h / height)"
_GRP = r"lower(regexp_replace(regexp_replace(regexp_extract(file_name, '([^/]*)$', 1), '(?i)\.rf\.[0-9a-f]+(\.[^.]+)$', '\1'), '(?i)_jpg\.jpg$', ''))"
_OWN = f"coalesce({_GRP}, 'id:' || image_id::varchar)"
_REIDX = f"""{_W}, ri as (select coalesce(lower(trim(source_split, ' ')), 'unknown') as split, image_id, row_number() over (partition by coalesce(lower(trim(source_split, ' ')), 'unknown') order by {_OWN}, file_name nulls first, image_id) as new_id from im)"""
_DEALT = f"""with recursive {C.SQL},
gi as (select image_id, {_OWN} as grp from im),
gc as (select grp, category_id, count(*) as n from an join gi using (image_id) group by all),
gr as (select grp, min(row(total, category_id)) as v from gc join (select category_id, sum(n)::bigint as total from gc group by 1) using (category_id) group by 1),
gs as (select grp, count(*) as n_images, any_value(coalesce(v[2], -1)) as rarest from gi left join gr using (grp) group by 1),
{deal.sql('gs', 'grp', 'n_images', 'rarest', {'train': 750000, 'val': 150000, 'test': 100000})}"""
_VIOL = f"""{_W},
a2 as (select id as ann_id, image_id, category_id, bbox[1] as x, bbox[2] as y, bbox[3] as w, bbox[4] as h from annotations),
v as (
select 'warning' as severity, 'size_invalid' as rule, 'image' as entity, image_id::varchar as entity_id, coalesce(width::varchar, 'null') || 'x' || coalesce(height::varchar, 'null') as detail from im where coalesce(width, 0) <= 0 or coalesce(height, 0) <= 0
union all select 'error', 'file_name_repeated', 'image', file_name, count(*)::varchar from im where file_name is not null group by file_name having count(*) > 1
union all select 'error', 'annotation_id_repeated', 'annotation', ann_id::varchar, k::varchar from (select ann_id, row_number() over (partition by ann_id) as k from a2) where k > 1
union all select 'error', 'image_unknown', 'annotation', ann_id::varchar, image_id::varchar from a2 where image_id is null or image_id not in (select image_id from im)
union all select 'error', 'category_unknown', 'annotation', ann_id::varchar, category_id::varchar from a2 where category_id is null or category_id not in (select category_id from ca)
union all select 'error', 'box_empty', 'annotation', ann_id::varchar, null from a2 where coalesce(w, 0) <= 0 or coalesce(h, 0) <= 0
union all select 'warning', 'box_starts_outside', 'annotation', ann_id::varchar, null from a2 where x < 0 or y < 0
union all select 'warning', 'box_exceeds', 'annotation', ann_id::varchar, null from a2 join im using (image_id) where x + w > width or y + h > height)"""

SQL = {
    "relative_area_bins": _SCALE + " select annotation_id, image_id, class, bbox_area_px, relative_area, size_bin from scale",
    "class_size_crosstab": _SCALE + " select class, count(*) filter (size_bin = 'large') as large, count(*) filter (size_bin = 'medium') as medium, count(*) filter (size_bin = 'small') as small from scale group by class",
    "size_value_counts": _SCALE + " select 'size_bin' as kind, size_bin as value, count(*) as n from scale group by 2 union all select 'class', class, count(*) from scale group by 2",
    "area_quantile_hist": _SCALE + """, q as (select quantile_cont(relative_area, 0.99) as q, min(relative_area) as lo from scale),
b as (select least(floor((least(relative_area, q) - lo) / ((q - lo) / 50)), 49)::int as bin, count(*) as n from scale, q group by 1)
select r.i::int as bin, round(lo + r.i * ((q - lo) / 50), 9) as lo, round(lo + (r.i + 1) * ((q - lo) / 50), 9) as hi, coalesce(b.n, 0) as n from range(50) r(i) cross join q left join b on b.bin = r.i""",
    "dataset_summary": _SCALE + " select 'images' as metric, count(*) as value from im union all select 'annotations', count(*) from an union all select 'size_bin:' || size_bin, count(*) from scale group by 1 union all select 'class:' || class, count(*) from scale group by 1",
    "category_index": _W + " select category_id, idx, name from ci",
    "images_by_id": _W + " select image_id, file_name, coalesce(width, 0) as width, coalesce(height, 0) as height, source_file_name, source_split, source_group from im",
    "annotations_by_image": _W + " select im.image_id, coalesce(string_agg(ann_id::varchar, ',' order by ann_id), '') as ann_ids, count(ann_id) as n from im left join an using (image_id) group by 1",
    "clip_boxes": _CLIP + " select ann_id, image_id, category_id, round(x1, 9) as x, round(y1, 9) as y, round(x2 - x1, 9) as w, round(y2 - y1, 9) as h, was_outside from cl where x2 > x1 and y2 > y1",
    "clip_counts": _W + ", j as (select * from an join im using (image_id)) select count(*) filter (x < 0 or y < 0 or x + w > width or y + h > height) as clipped, count(*) filter (least(x + w, width) <= greatest(x, 0) or least(y + h, height) <= greatest(y, 0)) as dropped from j",
    "train_view_xyxy": _CLIP + " select image_id, ann_id, round(x1, 9) as x1, round(y1, 9) as y1, round(x2, 9) as x2, round(y2, 9) as y2, round((x2 - x1) * (y2 - y1), 9) as area, idx + 1 as label from cl join ci using (category_id) where x2 > x1 and y2 > y1",
    "train_view_plain": _W + " select image_id, ann_id, x, y, w, h, round(coalesce(area, w * h), 9) as area, iscrowd, idx as label from an join ci using (category_id)",
    "yolo_labels": _W + " select image_id, ann_id, " + _LINE + " as line from an join im using (image_id) join ci using (category_id) where width > 0 and height > 0",
    "yolo_files": _W + ", l as (select image_id, string_agg(" + _LINE + ", chr(10) order by ann_id) || chr(10) as content from an join im using (image_id) join ci using (category_id) where width > 0 and height > 0 group by 1) select im.image_id, coalesce(content, '') as content from im left join l using (image_id)",
    "hflip_boxes": _W + " select image_id, ann_id, round(width - (x + w), 9) as x1, round(width - x, 9) as x2 from an join im using (image_id) where width is not null",
    "tile_positions": _TILES + " select image_id, tx::int as tx, ty::int as ty, tw::int as tw, th::int as th from tl",
    "tile_annotations": _TANN + " select image_id, tx::int as tx, ty::int as ty, ann_id, category_id, round(x, 9) as x, round(y, 9) as y, round(w, 9) as w, round(h, 9) as h, round(visible, 9) as visible from seen",
    "tile_negative_sample": _TANN + """, pt as (select distinct image_id, tx, ty from seen),
c as (select tl.*, pt.image_id is not null as positive, ('0x' || substr(md5(concat_ws(':', 42, tl.image_id, tl.tx, tl.ty)), 1, 15))::bigint as k from tl left join pt on pt.image_id = tl.image_id and pt.tx = tl.tx and pt.ty = tl.ty),
s as (select *, row_number() over (partition by positive order by k, image_id, ty, tx) as rn from c),
f as (select * from s where positive or rn <= ceil((select count(*) from pt) * 0.5))
select row_number() over (order by image_id, ty, tx) as patch_id, image_id, tx::int as tx, ty::int as ty, tw::int as tw, th::int as th, positive from f""",
    "violations": _VIOL + " select * from v",
    "violation_counts": _VIOL + " select severity, rule, count(*) as n from v group by all",
    "dup_content": "with d as (select doc_id, sha256(text) as h from documents where text is not null), f as (select h, min(doc_id) as owner from d group by h) select doc_id::varchar as entity_id, owner::varchar as detail from d join f using (h) where doc_id > owner",
    "orphan_refs": _W + " select ann_id, 'image_id' as ref_field from an where image_id is null or image_id not in (select image_id from im) union all select ann_id, 'category_id' from an where category_id is null or category_id not in (select category_id from ca)",
    "group_key": _W + f" select image_id, {_OWN} as grp from im",
    "group_split": _DEALT + " select grp, split from dealt",
    "prepared_summary": _DEALT + """, cx as (select image_id from an join im using (image_id) where width is not null and height is not null and least(greatest(x + w, 0), width) > least(greatest(x, 0), width) and least(greatest(y + h, 0), height) > least(greatest(y, 0), height)),
per as (select image_id, count(*) as n from cx group by 1)
select split, count(*) as images, coalesce(sum(n), 0)::bigint as annotations from gi join dealt using (grp) left join per using (image_id) group by 1""",
    "split_leakage": _W + ", p as (select source_group as grp, lower(trim(source_split, ' ')) as split, count(*) as n from im where source_group is not null and source_split is not null group by all) select grp, count(*) as n_splits, sum(n)::bigint as n_images from p group by grp having count(*) > 1",
    "reindex_ids": _REIDX + " select split, image_id, new_id from ri",
    "reindex_annotations": _REIDX + ", cx as (select ann_id, image_id from an join im using (image_id) where width is not null and height is not null and least(greatest(x + w, 0), width) > least(greatest(x, 0), width) and least(greatest(y + h, 0), height) > least(greatest(y, 0), height)) select split, row_number() over (partition by split order by new_id, ann_id) as id, new_id as image_id, ann_id from cx join ri using (image_id)",
    "unused_categories": _W + " select category_id, name from ca where category_id not in (select category_id from an where category_id is not null)",
    "latency_stats": "with e as (select value, row_number() over (order by event_id) as rn from events) select count(*) filter (rn > 10) as images, count(*) filter (rn <= 10) as warmup_images, round(avg(value) filter (rn > 10) * 1000, 4) as latency_ms_mean, round(count(*) filter (rn > 10) / sum(value) filter (rn > 10), 9) as fps from e",
    "early_stop": """with h as (select event_id as epoch, round(value, 3) as val_loss from events),
b as (select *, min(val_loss) over (order by epoch) as best, coalesce(val_loss < min(val_loss) over (order by epoch rows between unbounded preceding and 1 preceding), true) as is_best from h),
s as (select *, (epoch - max(case when is_best then epoch end) over (order by epoch))::bigint as stale from b)
select epoch, val_loss, best, is_best, stale, bool_or(stale >= 5) over (order by epoch) as stop from s""",
    "compare_runs": "select event_type as experiment, " + ", ".join(f"max(value) filter (user_id % 5 = {i}) as m{i}" for i in range(5)) + " from events group by 1",
    "metric_sanitise": "select 'r' as run_id, event_id as step, regexp_replace(trim(' ' || event_type || ':@ ' || user_id::varchar), '[^a-zA-Z0-9_./ -]', '_', 'g') as metric, value from events where event_id % 7 not in (0, 1)",
}
