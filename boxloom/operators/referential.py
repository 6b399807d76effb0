"""Orphan references: direct ones, and those inherited down the graph of foreign keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.plans.shared import Scratch, table


@dataclass(frozen=True)
class Reference:
    """child.field names a row of parent by its id."""

    child: str
    field: str
    parent: str


def key_history(parent: DataFrame, key: str = "id") -> DataFrame:
    """Of each key: when its first row came, and the deleted_at of its latest row. Null keys are no keys.

    Of rows received together the one that is deleted later, or not at all, counts.
    """
    never = F.lit("9999-12-31").cast("timestamp")
    last = F.max(F.struct("received_at", F.coalesce("deleted_at", never).alias("deleted_at")))
    return (
        parent.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.min("received_at").alias("first_seen"), last.alias("last"))
        .select("key", "first_seen", F.nullif(F.col("last.deleted_at"), never).alias("deleted_at"))
    )


def earliest(child: DataFrame, ident: str, at: str, fields: Sequence[str]) -> DataFrame:
    """The earliest row of each id (of rows at the same time, that of the smallest references)."""
    v = F.min(F.struct(F.col(at).alias("at"), *fields))
    return child.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("id")).agg(v.alias("v")).select("id", "v.*")


def direct_orphans(child: DataFrame, field: str, history: DataFrame) -> DataFrame:
    """(id, at, ref_field, reason) of the rows whose reference has no valid counterpart at their time.

    reason is missing, else late, else deleted. A null reference is none. history has one row a key, so a hot key only
    makes the child's side of the join skewed, which adaptive execution splits.
    """
    j = child.where(F.col(field).isNotNull()).select("id", "at", F.col(field).alias("key")).join(history, "key", "left")
    reason = F.when(F.col("first_seen").isNull(), "missing").when(F.col("first_seen") > F.col("at"), "late").when(F.col("deleted_at") <= F.col("at"), "deleted")
    return j.select("id", "at", F.lit(field).alias("ref_field"), reason.alias("reason")).where(F.col("reason").isNotNull())


ORPHAN = ("id", "at", "ref_field", "reason", "level")


def cascade(spark: SparkSession, rows: dict[str, DataFrame], refs: Sequence[Reference], history: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Least fixpoint of "orphaned, or child of an orphan": for each table (id, at, ref_field, reason, level).

    rows has id, at and the reference fields of each table, one row an id; history the keys of each table referred to.
    Level 0 are the direct orphans, a row for each bad reference with its reason. Every round after that goes over all
    references with a semi-join of the children to the parents found in the round before, and keeps those not found yet,
    with the reason inherited and one of the references that it came by; it ends when a round finds none, so cycles and
    references of a table to itself end as well. Tables without orphans come out empty.
    """
    s = Scratch(spark, "orphans")
    found: dict[str, list[DataFrame]] = {t: [] for t in rows}
    front: dict[str, DataFrame] = {}
    for t, r in rows.items():
        direct = [direct_orphans(r, f.field, history[f.parent]) for f in refs if f.child == t and f.parent in history]
        if direct:
            front[t] = s.cut(_all(direct).withColumn("level", F.lit(0)).select(*ORPHAN))
    level = 0
    while front:
        for t, d in front.items():
            found[t].append(d)
        level += 1
        nxt: dict[str, DataFrame] = {}
        for child in rows:
            parts = [
                rows[child].where(F.col(r.field).isNotNull()).join(front[r.parent].select(F.col("id").alias(r.field)), r.field, "left_semi").select("id", "at", F.lit(r.field).alias("ref_field"))
                for r in refs
                if r.child == child and r.parent in front
            ]
            if not parts:
                continue
            new = _all(parts).groupBy("id", "at").agg(F.min("ref_field").alias("ref_field"))
            for old in found[child]:
                new = new.join(old.select("id"), "id", "left_anti")
            new = s.cut(new.withColumns({"reason": F.lit("inherited"), "level": F.lit(level)}).select(*ORPHAN))
            if not new.isEmpty():
                nxt[child] = new
        front = nxt
    empty = spark.createDataFrame([], "id bigint, at timestamp, ref_field string, reason string, level int")
    return {t: _all(parts) if parts else empty for t, parts in found.items()}


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


REFS = (
    Reference("annotations", "image_id", "images"), Reference("annotations", "category_id", "categories"),
    Reference("annotations_scale", "annotation_id", "annotations"), Reference("annotations_scale", "image_id", "images"),
)


def orphans(spark: SparkSession, annotations: DataFrame, images: DataFrame, categories: DataFrame, scale: DataFrame) -> DataFrame:
    """(table_name, ref_table, id, at, ref_field, reason, level) of all orphans down REFS; the earliest row of an id counts.

    A measurement's time is the end of the day it was measured on, and its id that of its annotation. Rows without an
    id, and null references, are none. Annotations are never deleted. Empty tables are tables without keys.
    """
    s = Scratch(spark, "first")
    first = s.cut(earliest(annotations, "id", "received_at", ["image_id", "category_id"]))
    measured = earliest(scale.withColumn("_at", F.timestamp_add("DAY", F.lit(1), F.col("measured_on").cast("timestamp"))), "annotation_id", "_at", ["image_id"])
    rows = {"annotations": first, "annotations_scale": s.cut(measured.withColumn("annotation_id", F.col("id")))}
    arrived = first.select(F.col("id").alias("key"), F.col("at").alias("first_seen"), F.lit(None).cast("timestamp").alias("deleted_at"))
    found = cascade(spark, rows, REFS, {"images": key_history(images), "categories": key_history(categories), "annotations": arrived})
    of = F.create_map(*[x for r in REFS for x in (F.lit(f"{r.child}.{r.field}"), F.lit(r.parent))])
    named = lambda t, d: d.select(F.lit(t).alias("table_name"), F.element_at(of, F.concat(F.lit(f"{t}."), "ref_field")).alias("ref_table"), *ORPHAN)
    return _all([named(t, d) for t, d in found.items()])


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, referenced table, month and reason, inherited ones with reason 'inherited'.

    A row with two bad references counts once for each. A measurement counts in the month it was first measured.
    """
    day = F.when(F.col("table_name") == "annotations_scale", F.timestamp_add("DAY", F.lit(-1), F.col("at"))).otherwise(F.col("at"))
    return found.groupBy("table_name", "ref_table", F.date_format(day, "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(spark, *(table(spark, sf_dir, t) for t in ("annotations", "images", "categories", "annotations_scale")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 0 of the cascade for the annotations."""
    a = _found(spark, sf_dir).where("table_name = 'annotations' and level = 0")
    return a.select(F.col("id").alias("annotation_id"), "ref_field", "reason")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_found(spark, sf_dir))


_FOUND = """with a as (select id, received_at as t, image_id, category_id from annotations where id is not null
  qualify row_number() over (partition by id order by received_at, image_id nulls first, category_id nulls first) = 1),
keys as (
  select 'image_id' as ref_field, id, received_at, deleted_at from images union all
  select 'category_id', id, received_at, deleted_at from categories),
seen as (select ref_field, id, min(received_at) as first_seen from keys group by 1, 2),
last as (select ref_field, id, deleted_at from keys qualify row_number() over (partition by ref_field, id order by received_at desc, deleted_at desc nulls first) = 1),
r as (select id, t, 'image_id' as ref_field, image_id as key from a where image_id is not null
  union all select id, t, 'category_id', category_id from a where category_id is not null),
o as (select r.id, r.t, r.ref_field,
  case when s.id is null then 'missing' when s.first_seen > r.t then 'late' when l.deleted_at <= r.t then 'deleted' end as reason
  from r left join seen s on s.ref_field = r.ref_field and s.id = r.key left join last l on l.ref_field = r.ref_field and l.id = r.key)
"""

_SCALE = """,
m as (select annotation_id as id, measured_on::timestamp + interval 1 day as t, image_id from annotations_scale where annotation_id is not null
  qualify row_number() over (partition by annotation_id order by measured_on, image_id nulls first) = 1),
d as (select m.id, m.t, 'images' as ref_table, case when s.id is null then 'missing' when s.first_seen > m.t then 'late' when l.deleted_at <= m.t then 'deleted' end as reason
  from m left join seen s on s.ref_field = 'image_id' and s.id = m.image_id left join last l on l.ref_field = 'image_id' and l.id = m.image_id where m.image_id is not null
  union all select m.id, m.t, 'annotations', case when a.id is null then 'missing' when a.t > m.t then 'late' end from m left join a on a.id = m.id),
w as (select id, t, ref_table, reason from d where reason is not null union all
  select id, t, 'annotations', 'inherited' from m where id in (select id from o where reason is not null) and id not in (select id from d where reason is not null))
"""

SQL = {
    "p7_found": _FOUND + "select id as annotation_id, ref_field, reason from o where reason is not null",
    "p7_report": _FOUND
    + _SCALE
    + """select 'annotations' as table_name, case ref_field when 'image_id' then 'images' else 'categories' end as ref_table, strftime(t, '%Y-%m') as month, reason, count(*) as n
from o where reason is not null group by all
union all
select 'annotations_scale', ref_table, strftime(t - interval 1 day, '%Y-%m'), reason, count(*) from w group by all""",
}
QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
