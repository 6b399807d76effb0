"""Cutting oversized images into overlapping pieces at natural boundaries.

An axis longer than the limit is treated like a giant file: it is cut into ranges of RANGE pixels, and every range is cut
into pieces by itself, wherever it lies. For each range the workers detect its boundaries: of the boxes that end in it,
the least start for each end. Boxes are reduced to this table before anything is shuffled, so an image that holds most of
the boxes costs no more than its pixels. A box that reaches over the border of its range also gives the range before a
halo row. From its own table a range knows where its first piece starts, from the halo where the one of the next range
does; of its pieces it keeps those that start before that (see _range_pieces for why nothing is lost). The numbers of
pieces, a row for each range, are stitched by a prefix sum, and the pieces come out by offset. No axis, let alone an
image, goes to one task.

Within a range a piece starts as late as it may: the overlap before the end of the last one, but not after the start of
any box that isn't whole yet. So every box that is no longer than the limit is whole in some piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.boxes import clip, valid_box
from boxloom.plans.shared import table

LIMIT, OVERLAP, RANGE = 1280, 128, 8192


def latest_images(images: DataFrame) -> DataFrame:
    """(image_id, width, height) of the latest row of each image, if it isn't deleted and has both sides above zero."""
    last = F.max(F.struct("received_at", F.col("deleted_at").isNotNull().alias("gone"), "width", "height"))
    rows = images.where("id is not null").groupBy(F.col("id").alias("image_id")).agg(last.alias("v"))
    return rows.where("not v.gone and v.width > 0 and v.height > 0").select("image_id", "v.width", "v.height")


def latest_boxes(annotations: DataFrame) -> DataFrame:
    """(image_id, x, y, w, h) of the latest row of each annotation, if its box is valid."""
    last = F.max(F.struct("received_at", "image_id", "bbox"))
    rows = annotations.where("id is not null").groupBy("id").agg(last.alias("v")).select("v.image_id", "v.bbox")
    part = lambda i: F.get("bbox", F.lit(i))
    return rows.where(F.col("image_id").isNotNull() & valid_box(F.col("bbox"))).select("image_id", part(0).alias("x"), part(1).alias("y"), part(2).alias("w"), part(3).alias("h"))


def boundary_tables(images: DataFrame, boxes: DataFrame, limit: int = LIMIT, span: int = RANGE) -> DataFrame:
    """(image_id, axis, length, range, kind, stop, start) for each axis longer than limit.

    kind 0 is the row of the range itself (so that ranges without boxes come out too), kind 1 tells that a box is longer
    than the limit, kind 2 is a boundary: the least start and greatest end of the boxes that end in one pixel, kind 3 the
    halo: the least start of the boxes that end in the next range. Boxes that whole pixels can't hold within the limit,
    although their length allows it, keep a row for each extent, as each may need a piece of its own.
    """
    axes = images.select("image_id", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("width").alias("length")), F.struct(F.lit("y").alias("axis"), F.col("height").alias("length")))).alias("a"))
    axes = axes.select("image_id", "a.axis", F.col("a.length").cast("bigint").alias("length")).where(F.col("length") > limit)
    last = F.floor((F.col("length") - 1) / span)
    frame = axes.select("image_id", "axis", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("range"), F.lit(0).alias("kind"), F.lit(0.0).alias("stop"), F.lit(0.0).alias("start"))
    big = images.where((F.col("width") > limit) | (F.col("height") > limit))
    c = clip(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    inside = boxes.join(big, "image_id").withColumn("c", c).where("c.w > 0 and c.h > 0")
    extent = lambda name, side, at, size: F.struct(F.lit(name).alias("axis"), F.col(side).cast("bigint").alias("length"), F.col(at).alias("start"), (F.col(at) + F.col(size)).alias("stop"), F.col(size).alias("size"))
    ends = inside.select("image_id", F.explode(F.array(extent("x", "width", "c.x", "c.w"), extent("y", "height", "c.y", "c.h"))).alias("e"))
    ends = ends.select("image_id", "e.*").where(F.col("length") > limit)
    kind = F.when(F.col("size") > limit, 1).otherwise(2)
    held = F.ceil("stop") - F.floor("start") <= limit
    cell = F.when((kind == 2) & held, F.ceil("stop"))
    own = [F.when((kind == 2) & ~held, F.col(n)) for n in ("start", "stop")]
    place = F.when(kind == 2, F.least(F.floor((F.ceil("stop") - 1) / span), last)).otherwise(F.lit(0).cast("bigint"))
    edges = ends.groupBy("image_id", "axis", "length", place.alias("range"), kind.alias("kind"), cell.alias("cell"), own[0].alias("s"), own[1].alias("t"))
    edges = edges.agg(F.max("stop").alias("stop"), F.min("start").alias("start")).select("image_id", "axis", "length", "range", "kind", "stop", "start")
    # a boundary row is its own halo row too, if it starts before its range; only the first piece's start matters there
    over = (F.col("kind") == 2) & (F.col("start") < F.col("range") * span) & (F.col("range") > 0)
    two = F.when(over, F.array(F.struct("range", "kind"), F.struct((F.col("range") - 1).alias("range"), F.lit(3).alias("kind")))).otherwise(F.array(F.struct("range", "kind")))
    edges = edges.select("image_id", "axis", "length", F.explode(two).alias("r"), "stop", "start").select("image_id", "axis", "length", "r.range", "r.kind", "stop", "start")
    return frame.unionByName(edges)


def _first(border: int, length: int, crossing: list[tuple[float, float]], limit: int, overlap: int) -> float:
    """Where the first piece of the range that begins at border starts. crossing: (start, stop) of boxes that end in it."""
    if border == 0:
        return 0.0
    start = float(min(border - overlap, length - limit))
    near = min((e for e in crossing if e[0] < start), default=None)
    return start if near is None else _whole(near, limit)


def _whole(box: tuple[float, float], limit: int) -> float:
    """The start of a piece for a box: its pixel, or the box's own start if whole pixels can't hold it."""
    start = float(math.floor(box[0]))
    return start if math.ceil(box[1]) <= start + limit else box[0]


def _range_pieces(border: int, length: int, edges: list[tuple[float, float]], halo: list[tuple[float, float]], limit: int, overlap: int, span: int) -> list[float]:
    """Starts of the pieces of the range that begins at border. edges: (stop, start) in order of stop; halo: (start, stop).

    A piece placed after the next range's first start f is left out: a box of this range that starts at f or later ends
    before f + limit, as the border is less than the limit after f, so the next range's first piece has it whole. And
    where pieces are left out, the last one kept reaches at least the overlap beyond f, as f isn't after the next one.
    """
    upto = min(border + span, length)
    stop_at = _first(upto, length, halo, limit, overlap) if upto < length else math.inf
    starts = [_first(border, length, [(s, t) for t, s in edges], limit, overlap)]
    k = 0
    open_: list[tuple[float, float]] = []  # (start, stop) not known to be whole
    while (end := starts[-1] + limit) < upto:
        start = min(end - overlap, float(length - limit))
        while k < len(edges) and edges[k][0] <= end + limit:  # later ones start after end
            open_.append((edges[k][1], edges[k][0]))
            k += 1
        open_ = [e for e in open_ if e[1] > end]
        near = min((e for e in open_ if e[0] < start), default=None)
        starts.append(start if near is None else _whole(near, limit))
    return [s for s in starts if s < stop_at]


_RANGES = "image_id bigint, axis string, length bigint, range bigint, n bigint, forced boolean, starts array<double>"


def _cut(limit: int, overlap: int, span: int):
    names = [c.split()[0] for c in _RANGES.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted boundary rows to a row for each range, one range at a time."""
        key, edges, halo, forced, out = None, [], [], False, []

        def close() -> None:
            starts = _range_pieces(key[3] * span, key[2], edges, halo, limit, overlap, span)
            out.append((*key, len(starts), forced, starts))

        for batch in batches:
            for *now, kind, stop, start in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if now != key:
                    if key is not None:
                        close()
                    key, edges, halo, forced = now, [], [], False
                if kind == 1:
                    forced = True
                elif kind == 2:
                    edges.append((stop, start))
                elif kind == 3:
                    halo.append((start, stop))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out.clear()
        if key is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def axis_pieces(images: DataFrame, annotations: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, span: int = RANGE) -> DataFrame:
    """The pieces of each axis longer than limit, by offset; cut is forced if a box is longer than limit along it.

    The latest rows count. Images that are deleted or lack a positive side, and boxes that are not four finite numbers,
    have no extent or lie outside, are left out. Consecutive pieces overlap by at least overlap pixels; starts are whole
    pixels unless only a fraction can hold a box. An axis without boxes gets the widest steps; empty tables give none.
    """
    if not 0 <= overlap < limit or span < 2 * limit:
        raise ValueError("overlap must be from 0 to below limit, span at least twice the limit")
    rows = boundary_tables(latest_images(images), latest_boxes(annotations), limit, span)
    by = ["image_id", "axis", "length", "range"]
    ranges = rows.repartition(*by).sortWithinPartitions(*by, "kind", "stop", "start").mapInArrow(_cut(limit, overlap, span), _RANGES)
    axis = Window.partitionBy("image_id", "axis")  # a row a range: a length is an int, so there are at most 2 ** 31 / span
    before = F.coalesce(F.sum("n").over(axis.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.withColumns({"before": before, "cut": F.when(F.max("forced").over(axis), "forced").otherwise("clean")})
    out = placed.select("image_id", "axis", "length", "before", "cut", F.posexplode("starts").alias("i", "start"))
    return out.select("image_id", "axis", "length", (F.col("before") + F.col("i")).alias("piece"), "start", F.least(F.col("start") + limit, F.col("length").cast("double")).alias("stop"), "cut")


def image_pieces(images: DataFrame, annotations: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, span: int = RANGE) -> DataFrame:
    """(image_id, x, y, width, height) of the pieces of each oversized image: every piece of one axis by every of the other."""
    p = axis_pieces(images, annotations, limit, overlap, span).select("image_id", "axis", "start", "stop")
    side = latest_images(images).where((F.col("width") > limit) | (F.col("height") > limit))
    short = lambda axis, n: side.where(F.col(n) <= limit).select("image_id", F.lit(axis).alias("axis"), F.lit(0.0).alias("start"), F.col(n).cast("double").alias("stop"))
    every = p.unionByName(short("x", "width")).unionByName(short("y", "height"))
    along = lambda a: every.where(F.col("axis") == a).select("image_id", F.col("start").alias(a), (F.col("stop") - F.col("start")).alias("width" if a == "x" else "height"))
    return along("x").join(along("y"), "image_id").select("image_id", "x", "y", "width", "height")


def p1_found(spark, sf_dir: str) -> DataFrame:
    return axis_pieces(table(spark, sf_dir, "images"), table(spark, sf_dir, "annotations")).where("piece = 0").select("image_id", "axis", "cut")


def p1_pieces(spark, sf_dir: str) -> DataFrame:
    return image_pieces(table(spark, sf_dir, "images"), table(spark, sf_dir, "annotations"))


_BASE = """i as (select * from images where id is not null qualify row_number() over (partition by id order by received_at desc) = 1),
img as (select id as image_id, width, height from i where deleted_at is null and width > 0 and height > 0),
a as (select * from annotations where id is not null qualify row_number() over (partition by id order by received_at desc) = 1),
b as (select image_id, bbox[1] as x, bbox[2] as y, bbox[3] as w, bbox[4] as h from a
  where len(bbox) = 4 and list_count(bbox) = 4 and isfinite(bbox[1]) and isfinite(bbox[2]) and isfinite(bbox[3]) and isfinite(bbox[4]) and bbox[3] > 0 and bbox[4] > 0)"""
_WHOLE = "case when ceil({e}.t) <= floor({e}.s) + 1280 then floor({e}.s) else {e}.s end"
SQL = {
    "p1_found": f"""with {_BASE},
c as (select image_id, least(x + w, width) - greatest(x, 0) as cw, least(y + h, height) - greatest(y, 0) as ch from b join img using (image_id)),
m as (select image_id, max(cw) as cw, max(ch) as ch from c where cw > 0 and ch > 0 group by 1),
axes as (select image_id, 'x' as axis, width as length from img union all select image_id, 'y', height from img)
select image_id, axis, case when (axis = 'x' and cw > 1280) or (axis = 'y' and ch > 1280) then 'forced' else 'clean' end as cut
from axes left join m using (image_id) where length > 1280""",
    # the pieces of each range one after the other, from the boxes themselves
    "p1_pieces": f"""with recursive {_BASE},
c as (select image_id, width, height, least(greatest(x, 0), width) as x1, least(greatest(y, 0), height) as y1, least(greatest(x + w, 0), width) as x2, least(greatest(y + h, 0), height) as y2 from b join img using (image_id)),
k as (select * from c where x2 > x1 and y2 > y1),
axes as (select * from (select image_id, 'x' as axis, width::bigint as length from img union all select image_id, 'y', height from img) where length > 1280),
e as (select image_id, axis, greatest(0, ceil(t)::bigint - 1) // {RANGE} as r, list(struct_pack(s := s, t := t) order by s, t) as boxes
  from (select image_id, 'x' as axis, x1 as s, x1 + (x2 - x1) as t, x2 - x1 as z from k union all select image_id, 'y', y1, y1 + (y2 - y1), y2 - y1 from k) where z <= 1280 group by all),
ranges as (select image_id, axis, length, r, r * {RANGE} as lo, least((r + 1) * {RANGE}, length) as hi from (select *, unnest(range(0, (length - 1) // {RANGE} + 1)) as r from axes)),
f as (select ranges.*, boxes, case when lo = 0 then 0.0::double else least(lo - 128, length - 1280)::double end as soonest from ranges left join e using (image_id, axis, r)),
g as (select *, case when r = 0 then null else list_filter(boxes, lambda b: b.s < soonest)[1] end as near from f),
h as (select *, coalesce({_WHOLE.format(e='near')}, soonest) as first from g),
n as (select *, lead(first) over (partition by image_id, axis order by r) as next from h),
p as (select image_id, axis, length, r, hi, next, boxes, first as start from n
  union all
  select image_id, axis, length, r, hi, next, boxes, coalesce({_WHOLE.format(e='near')}, soonest) from (
    select *, list_filter(boxes, lambda b: b.t > start + 1280 and b.s < soonest)[1] as near from (select *, least(start + 1152, length - 1280) as soonest from p where start + 1280 < hi))),
q as (select image_id, axis, start, least(start + 1280, length) as stop from p where next is null or start < next
  union all select image_id, 'x', 0, width from img where width <= 1280 and height > 1280
  union all select image_id, 'y', 0, height from img where height <= 1280 and width > 1280)
select v.image_id, v.start::double as x, w.start::double as y, (v.stop - v.start)::double as width, (w.stop - w.start)::double as height from q v join q w on w.image_id = v.image_id where v.axis = 'x' and w.axis = 'y'""",
}
QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
