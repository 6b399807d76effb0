"""Per-key results where a few keys hold most of the rows.

The rows are partitioned by sampled quantiles of a composite (key, secondary, id), so that a heavy key is spread over
as many partitions as its share of the rows asks for. Each partition streams its sorted rows into one partial state a
key; states of a key in neighbouring partitions are then stitched. Only states are shuffled after that: at most one for
each key and partition it touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.boxes import valid_box
from boxloom.plans.shared import Scratch, table

STATE = "pid int, none boolean, key bigint, n bigint, n_sub bigint, first_sub bigint, last_sub bigint, total double, n_total bigint"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (pid, none, key, sub, value) rows to states; a state is open until its key ends, so memory is constant."""
    names = [c.split()[0] for c in STATE.split(", ")]
    types = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    open_: list | None = None
    for b in batches:
        if not b.num_rows:
            continue
        pid = b.column(0)[0].as_py()
        none = b.column(1).to_numpy(zero_copy_only=False)
        key = b.column(2).to_numpy(zero_copy_only=False)
        has = ~np.asarray(b.column(3).is_null())
        sub = b.column(3).fill_null(0).to_numpy(zero_copy_only=False)
        some = ~np.asarray(b.column(4).is_null())
        value = b.column(4).fill_null(0.0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (none[1:] != none[:-1])])
        ends = np.r_[cuts[1:], len(key)]
        done = []
        for lo, hi in zip(cuts, ends, strict=True):
            if open_ is None or open_[1:3] != [none[lo], key[lo]]:
                if open_ is not None:
                    done.append(open_)
                open_ = [pid, bool(none[lo]), int(key[lo]), 0, 0, None, None, 0.0, 0]
            s = sub[lo:hi][has[lo:hi]]  # nulls sort first and are no sub key
            if len(s):
                new = int((s[1:] != s[:-1]).sum()) + int(open_[6] is None or open_[6] != s[0])
                open_[4] += new
                open_[5] = int(s[0]) if open_[5] is None else open_[5]
                open_[6] = int(s[-1])
            open_[3] += int(hi - lo)
            open_[7] += float(value[lo:hi].sum())
            open_[8] += int(some[lo:hi].sum())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(open_, types, strict=True)], names)


def ranged_states(rows: DataFrame, key: str, sub: str, value: Column, ident: str) -> DataFrame:
    """Partial states by range partition. key, sub and ident are bigint columns; rows with a null key have states with none set."""
    slim = rows.select(
        F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("key"), F.col(sub).cast("bigint").alias("sub"), F.col(ident).alias("ident"), value.cast("double").alias("value")
    )
    ranged = slim.repartitionByRange("none", "key", "sub", "ident").sortWithinPartitions("none", "key", "sub", "ident")
    return ranged.select(F.spark_partition_id().alias("pid"), "none", "key", "sub", "value").mapInArrow(_fold, STATE)


def stitch(states: DataFrame) -> DataFrame:
    """One row a key: n, distinct sub keys, and the mean of value over the rows that have one (null if none has).

    A sub key that lies on a border is counted by both partitions; where a state's first sub key is the last one seen
    before it, one is taken off again.
    """
    before = Window.partitionBy("key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    again = F.coalesce((F.last("last_sub", ignorenulls=True).over(before) == F.col("first_sub")).cast("bigint"), F.lit(0))
    return (
        states.where("not none")
        .withColumn("again", again)
        .groupBy("key")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n_sub") - F.col("again")).alias("n_sub"), F.sum("total").alias("total"), F.sum("n_total").alias("n_total"))
        .select("key", "n", "n_sub", F.when(F.col("n_total") > 0, F.col("total") / F.col("n_total")).alias("mean"))
    )


def latest_annotations(annotations: DataFrame) -> DataFrame:
    """The row of each annotation id with the greatest received_at; ties go to the greater category, image and area.

    Rows without an id are left out. The box area is w * h of a valid box, else null.
    """
    bbox = F.col("bbox")
    area = F.when(valid_box(bbox), F.get(bbox, F.lit(2)) * F.get(bbox, F.lit(3)))
    return (
        annotations.where("id is not null")
        .select("id", F.struct("received_at", "category_id", "image_id", area.alias("box_area")).alias("v"))
        .groupBy("id")
        .agg(F.max("v").alias("v"))
        .select("id", "v.category_id", "v.image_id", "v.box_area")
    )


def category_states(annotations: DataFrame) -> DataFrame:
    return ranged_states(latest_annotations(annotations), "category_id", "image_id", F.col("box_area"), "id")


def category_stats(annotations: DataFrame) -> DataFrame:
    """Annotations, images and mean box area of every category, each annotation id counted once by its latest row.

    A null category is no category; an empty table gives no rows; a category without any valid box has a null mean.
    """
    return _named(stitch(category_states(annotations)))


def _named(stats: DataFrame) -> DataFrame:
    return stats.select(F.col("key").alias("category_id"), F.col("n").alias("n_annotations"), F.col("n_sub").alias("n_images"), F.round("mean", 6).alias("mean_box_area"))


def heavy_categories(annotations: DataFrame, share: float = 0.08) -> DataFrame:
    """Categories that hold at least the share of all annotation ids, those without a category included in the total.

    The total is that of the states, a few rows for each partition, which are written once.
    """
    states = Scratch(annotations.sparkSession, "states").cut(category_states(annotations))
    total = states.agg(F.sum("n").alias("total"))
    return _named(stitch(states)).where(F.col("n_annotations") >= total.scalar() * F.lit(float(share))).select("category_id")


def p6_category_stats(spark, sf_dir: str) -> DataFrame:
    return category_stats(table(spark, sf_dir, "annotations"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    return heavy_categories(table(spark, sf_dir, "annotations"))


_LATEST = """with valid as (
  select id, category_id, image_id, received_at,
    case when len(bbox) = 4 and list_count(bbox) = 4 and isfinite(bbox[1]) and isfinite(bbox[2]) and isfinite(bbox[3]) and isfinite(bbox[4])
      and bbox[3] > 0 and bbox[4] > 0 then bbox[3] * bbox[4] end as box_area
  from annotations where id is not null),
latest as (select * from valid qualify row_number() over (partition by id order by received_at desc, category_id desc nulls last, image_id desc nulls last, box_area desc nulls last) = 1)
"""

SQL = {
    "p6_category_stats": _LATEST + "select category_id, count(*) as n_annotations, count(distinct image_id) as n_images, round(avg(box_area), 6) as mean_box_area from latest where category_id is not null group by category_id",
    "p6_found": _LATEST + "select category_id from latest where category_id is not null group by category_id having count(*) >= 0.08::double * (select count(*) from latest)",
}
QUERIES = {"p6_category_stats": p6_category_stats, "p6_found": p6_found}
