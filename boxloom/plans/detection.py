"""Queries of matching, measures and suppression over the derived boxes, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.operators import matching as M
from boxloom.operators import nms
from boxloom.plans.shared import Scratch
from boxloom.sources import current as C
from boxloom.sources import fixture as X


def _load(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    gt = X.truth(spark, d)
    return gt, X.detections(gt), X.images(spark, d)


def _real(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The annotations and predictions tables as they are now, with the image that holds a tenth of the detections."""
    a = C.annotations(spark, d).withColumn("area", F.coalesce("area", F.col("w") * F.col("h")))
    return a, C.predictions(spark, d), C.images(spark, d).select("image_id", "width", "height")


def iou_pairs(spark, d: str) -> DataFrame:
    gt, pred, img = _load(spark, d)
    p = M.pairs(M.with_bins(gt, img), pred, 0.5)
    return p.select("image_id", "category_id", "det_id", "ann_id", F.round("v", 9).alias("iou"))


def match_records(spark, d: str) -> DataFrame:
    return M.match_records(*_load(spark, d))


def match_ignore_small(spark, d: str) -> DataFrame:
    return M.match_records(*_load(spark, d), bin_="small")


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def prf_overall(spark, d: str) -> DataFrame:
    return _round(M.counts(*_load(spark, d), bins=[M.ALL], by_class=False).drop("bin"))


def prf_per_class(spark, d: str) -> DataFrame:
    return _round(M.counts(*_load(spark, d), bins=[M.ALL]).drop("bin"))


def prf_by_size(spark, d: str) -> DataFrame:
    return _round(M.counts(*_load(spark, d), bins=M.BINS, by_class=False))


def pr_curve(spark, d: str) -> DataFrame:
    return _round(M.curve(*_load(spark, d)).select("category_id", "det_id", "n_tp", "n_fp", "recall", "precision"))


def ap101(spark, d: str) -> DataFrame:
    return _round(M.relative_ap(*_load(spark, d), [0.5], [M.ALL]).select("category_id", "ap"))


def relative_map50(spark, d: str) -> DataFrame:
    return _round(M.relative_ap(*_load(spark, d), [0.5]).groupBy("bin").agg(F.avg("ap").alias("map50")))


def relative_map5095(spark, d: str) -> DataFrame:
    return _round(M.relative_map(*_load(spark, d)))


def coco_ap(spark, d: str) -> DataFrame:
    gt, pred, _ = _load(spark, d)
    return _round(M.coco_metrics(gt.withColumn("area", F.col("w") * F.col("h")), pred))


def real_match_records(spark, d: str) -> DataFrame:
    return M.match_records(*_real(spark, d))


def real_prf_per_class(spark, d: str) -> DataFrame:
    return _round(M.counts(*_real(spark, d)).where(F.col("bin") == M.ALL).drop("bin"))


def real_ap(spark, d: str) -> DataFrame:
    return _round(M.relative_ap(*_real(spark, d), [0.5, 0.75], [M.ALL, *M.BINS]).select("category_id", "t", "bin", "ap"))


def real_coco_ap(spark, d: str) -> DataFrame:
    gt, pred, _ = _real(spark, d)
    return _round(M.coco_metrics(gt, pred))


def real_nms(spark, d: str) -> DataFrame:
    return nms.suppress(C.predictions(spark, d), 0.5, 300)


def evaluate(gt: DataFrame, pred: DataFrame, images: DataFrame, conf: float = 0.25, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """(metric, value) of a whole evaluation, under the names of its report.

    The inputs are written once, as all parts read them. One pass of matching gives the relative measures and the counts,
    another one the COCO measures. strict: boxes and detections of unknown images are errors.
    """
    s, bins = Scratch(gt.sparkSession, "evaluate"), [M.ALL, *M.BINS]
    gt, pred, images = s.cut(gt), s.cut(pred), s.cut(images)
    coco = M.coco_metrics(gt.withColumn("area", F.col("w") * F.col("h")) if "area" not in gt.columns else gt, pred, images=images if strict else None)
    grid = [threshold, *(t for t in M.GRID if t != threshold)]  # the first one is counted
    rec, boxes = M.relative_records(gt, pred.where(F.col("score") >= F.lit(0.0)), images, grid, bins, strict=strict)
    rec, boxes = s.cut(rec), s.cut(boxes)
    by = M.counted(rec, boxes, bins, conf, by_class=False)
    values = ["tp", "fp", "fn", "precision", "recall", "f1"]
    prefix = F.when(F.col("bin") == M.ALL, "overall_").otherwise(F.concat(F.lit("relative_"), "bin", F.lit("_")))
    long = by.select("bin", *[F.col(v).cast("double").alias(v) for v in values]).unpivot(["bin"], values, "m", "value").select(F.concat(prefix, "m").alias("metric"), "value")
    ap = M.average_precision(rec, M.bin_totals(boxes, bins).where(F.col("bin") != M.ALL), len(grid), bins)
    place = F.element_at(F.array(*[F.lit(M.GRID.index(t) if t in M.GRID else -1) for t in grid]), F.col("t") + 1)
    maps = M.mean_ap(ap.withColumn("t", place).where("t >= 0")).unpivot(["bin"], ["map50", "map5095"], "m", "value").select(F.concat(F.lit("relative_"), "bin", F.lit("_"), "m").alias("metric"), "value")
    return coco.unionByName(long).unionByName(maps)


def evaluate_all(spark, d: str) -> DataFrame:
    return _round(evaluate(*_load(spark, d)))


def nms_merge(spark, d: str) -> DataFrame:
    gt, pred, img = _load(spark, d)
    return nms.merge_patches(X.patch_detections(pred), X.patches(img))


def nms_capped(spark, d: str) -> DataFrame:
    gt, pred, img = _load(spark, d)
    return nms.suppress(pred, 0.5, 4)


def nms_top_k(spark, d: str) -> DataFrame:
    gt, pred, img = _load(spark, d)
    return nms.suppress(pred, 0.5, 4, cap="top_k")


def patch_project(spark, d: str) -> DataFrame:
    gt, pred, img = _load(spark, d)
    return nms.project(X.patch_detections(pred), X.patches(img))


QUERIES = {f.__name__: f for f in (iou_pairs, match_records, match_ignore_small, prf_overall, prf_per_class, prf_by_size, pr_curve, ap101, relative_map50, relative_map5095, coco_ap, real_match_records, real_prf_per_class, real_ap, real_coco_ap, real_nms, evaluate_all, nms_merge, nms_capped, nms_top_k, patch_project)}

_BIN = "case when {a} < 0.01::double then 'small' when {a} < 0.05::double then 'medium' else 'large' end"
_REL = "case when img.width * img.height > 0 then greatest({b}.w, 0) * greatest({b}.h, 0) / (img.width * img.height)::double else 0 end"
_COVER = "greatest(0, least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x)) * greatest(0, least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y)) / (p.w * p.h)"
_DERIVED = X.SQL + """,
truth as (select *, w * h as area, false as crowd from gt)"""
_REAL = C.SQL + """,
img as (select image_id, width, height from im),
truth as (select ann_id, image_id, category_id, x, y, w, h, coalesce(area, w * h) as area, iscrowd = 1 as crowd from an),
pred as (select * from pr)"""
# the relative measures know images and no crowds, the COCO ones have crowds and any image
_KNOWN = f"""g as (select gt.*, {_BIN.format(a=_REL.format(b='gt'))} as bin from (select * from truth where not crowd) gt join img using (image_id)),
p as (select pred.*, {_BIN.format(a=_REL.format(b='pred'))} as bin from pred join img using (image_id))"""
_ANY = "g as (select *, 'all' as bin from truth), p as (select *, 'all' as bin from pred)"


def _boxes(base: str, known: bool = True) -> str:
    v = f"case when g.crowd then {_COVER} else {X.IOU.format(a='p', b='g')} end"
    return f"""{base},
{_KNOWN if known else _ANY},
cand as (select * from (select p.image_id, p.category_id, p.det_id, p.score, g.ann_id, g.bin as gbin, g.area as garea, g.crowd, {v} as v
  from p join g on g.image_id = p.image_id and g.category_id = p.category_id) where v >= 0.5::double)"""


_MATCH = """,
dc as (select image_id, category_id, det_id, score, t, bin, list(struct_pack(ann := ann_id, valid := {valid}, crowd := crowd) order by ({valid}) desc, v desc, ann_id {tie}) as c
  from {src} cross join cells where v >= thr group by all),
ord as (select *, row_number() over (partition by image_id, category_id, t, bin order by score desc, det_id) as rn from dc),
m as (select image_id, category_id, t, bin, rn, det_id, score, c[1] as pick, case when c[1].crowd then []::bigint[] else [c[1].ann] end as used from ord where rn = 1
  union all
  select image_id, category_id, t, bin, rn, det_id, score, pick, case when pick is null or pick.crowd then used else list_append(used, pick.ann) end from (
    select o.image_id, o.category_id, o.t, o.bin, o.rn, o.det_id, o.score, list_filter(o.c, lambda x: x.crowd or not list_contains(m.used, x.ann))[1] as pick, m.used
    from m join ord o on o.image_id = m.image_id and o.category_id = m.category_id and o.t = m.t and o.bin = m.bin and o.rn = m.rn + 1)),
hit as (select image_id, category_id, t, bin, det_id, score, pick.valid::int as tp from m where pick is not null)"""


def _match_sql(cells: str, src: str = "cand", valid: str = "bin = 'all' or gbin = bin", tie: str = "", base: str = _DERIVED, known: bool = True) -> str:
    return f"with recursive {_boxes(base, known)},\ncells(t, thr, bin) as ({cells})" + _MATCH.format(valid=valid, src=src, tie=tie)


def _cells(grid, bins) -> str:
    return "select * from (values " + ", ".join(f"({i}, {t!r}::double)" for i, t in enumerate(grid)) + ") a(t, thr) cross join (values " + ", ".join(f"('{b}')" for b in bins) + ") b(bin)"


def _records(bin_: str, base: str = _DERIVED) -> str:
    return _match_sql(_cells([0.5], [bin_]), base=base) + f""" select p.det_id, p.image_id, p.category_id, p.score, coalesce(hit.tp, 0)::int as tp, (hit.tp is null and ({bin_ == 'all'} or p.bin = '{bin_}'))::int as fp
from p left join hit on hit.det_id = p.det_id"""


def _prf(bins, keys: str, base: str = _DERIVED) -> str:
    select = ", ".join(filter(None, [keys]))
    return _match_sql(_cells([0.5], bins), "(select * from cand where score >= 0.25::double)", base=base) + f""",
frame as (select category_id, bin from (select category_id from g union select category_id from p where score >= 0.25::double) cross join (values {', '.join(f"('{b}')" for b in bins)}) b(bin)),
c as (select f.category_id, f.bin, (select count(*) from hit where hit.category_id = f.category_id and hit.bin = f.bin and hit.tp = 1) as tp,
  (select count(*) from p where p.category_id = f.category_id and p.score >= 0.25::double and (f.bin = 'all' or p.bin = f.bin) and p.det_id not in (select det_id from hit where hit.bin = f.bin)) as fp,
  (select count(*) from g where g.category_id = f.category_id and (f.bin = 'all' or g.bin = f.bin)) as n from frame f),
s as (select {select + ',' if select else ''} sum(tp)::bigint as tp, sum(fp)::bigint as fp, (sum(n) - sum(tp))::bigint as fn from c {'group by ' + select if select else ''}),
r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end::double as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end::double as recall from s)
select {select + ',' if select else ''} tp, fp, fn, round(precision, 9) as precision, round(recall, 9) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 9) as f1 from r"""


_CURVE = """,
ev as (select c.t, c.bin, p.category_id, p.image_id, p.det_id, p.score, coalesce(h.tp, 0) as tp, (h.tp is null and ({own}))::int as fp
  from {p} p cross join cells c left join hit h on h.det_id = p.det_id and h.t = c.t and h.bin = c.bin where h.tp = 1 or (h.tp is null and ({own}))),
run as (select *, sum(tp) over w as n_tp, sum(fp) over w as n_fp from ev window w as (partition by category_id, t, bin order by score desc, image_id, det_id rows unbounded preceding)),
total as (select category_id, y.bin, count(*) as total from (select * from g where not crowd) g cross join (select distinct bin from cells) y where {inbin} group by all),
pts as (select run.*, n_tp / total as recall, n_tp / (n_tp + n_fp) as precision from run join total using (category_id, bin) where tp = 1)"""
_AP = """,
lev as (select i, i * 0.01::double as r from range(101) x(i)),
ap as (select c.category_id, c.t, c.bin, avg(best) as ap, max(last) as last from (
  select k.category_id, k.t, k.bin, lev.i, coalesce(max(pts.precision), 0) as best, max(pts.recall) as last
  from (select total.category_id, total.bin, cells.t from total join cells using (bin)) k cross join lev
  left join pts on pts.category_id = k.category_id and pts.t = k.t and pts.bin = k.bin and pts.recall >= lev.r group by all) c group by all)"""


def _curve_sql(grid, bins, **kw) -> str:
    own, inbin = kw.get("own", "c.bin = 'all' or p.bin = c.bin"), kw.get("inbin", "y.bin = 'all' or g.bin = y.bin")
    return _match_sql(_cells(grid, bins), kw.get("src", "cand"), kw.get("valid", "bin = 'all' or gbin = bin"), kw.get("tie", ""), kw.get("base", _DERIVED), kw.get("known", True)) + _CURVE.format(own=own, p=kw.get("p", "p"), inbin=inbin)


def _area(col: str, b: str) -> str:
    return f"(case {b} when 'all' then {col} between 0 and 1e10 when 'small' then {col} between 0 and 1024 when 'medium' then {col} between 1024 and 9216 else {col} between 9216 and 1e10 end)"


_TOP = "(select * from p qualify row_number() over (partition by image_id, category_id order by score desc, det_id) <= 100)"


def _coco(base: str) -> str:
    return _curve_sql(
        M.COCO_GRID, M.COCO_AREAS, own=_area("p.w * p.h", "c.bin"), inbin=_area("g.area", "y.bin"), valid="not crowd and " + _area("garea", "bin"), tie="desc", p=_TOP,
        src=f"(select cand.* from cand where det_id in (select det_id from {_TOP}))", base=base, known=False,
    ) + _AP


_METRICS = """select 'coco_map5095' as metric, avg(ap) as value from ap where bin = 'all' union all select 'coco_map50', avg(ap) from ap where bin = 'all' and t = 0
union all select 'coco_map75', avg(ap) from ap where bin = 'all' and t = 5 union all select 'coco_ap_small', avg(ap) from ap where bin = 'small'
union all select 'coco_ap_medium', avg(ap) from ap where bin = 'medium' union all select 'coco_ap_large', avg(ap) from ap where bin = 'large'
union all select 'coco_ar100', avg(coalesce(last, 0)) from ap where bin = 'all'"""


def _nms_sql(src: str, cap: int, order: str, base: str = X.SQL) -> str:
    return f"""with recursive {base},
src as ({src}),
ord as (select *, row_number() over (partition by image_id, category_id order by score desc, det_id) as rn, min(det_id) over (partition by image_id, category_id) as first from src),
r as (select *, true as keep, [struct_pack(x := x, y := y, w := w, h := h)] as kept from ord where rn = 1
  union all
  select o.*, len(list_filter(r.kept, lambda k: {X.IOU.format(a='k', b='o')} >= 0.5::double)) = 0,
    case when len(list_filter(r.kept, lambda k: {X.IOU.format(a='k', b='o')} >= 0.5::double)) = 0 then list_append(r.kept, struct_pack(x := o.x, y := o.y, w := o.w, h := o.h)) else r.kept end
  from r join ord o on o.image_id = r.image_id and o.category_id = r.category_id and o.rn = r.rn + 1)
select det_id, image_id, category_id, x, y, w, h, score from r where keep qualify row_number() over (partition by image_id order by {order}) <= {cap}"""


SQL = {
    "iou_pairs": f"with {_boxes(_DERIVED)} select image_id, category_id, det_id, ann_id, round(v, 9) as iou from cand",
    "match_records": _records("all"),
    "match_ignore_small": _records("small"),
    "prf_overall": _prf(["all"], ""),
    "prf_per_class": _prf(["all"], "category_id"),
    "prf_by_size": _prf(M.BINS, "bin"),
    "pr_curve": _curve_sql([0.5], ["all"]) + " select category_id, det_id, n_tp::bigint as n_tp, n_fp::bigint as n_fp, round(recall, 9) as recall, round(precision, 9) as precision from pts",
    "ap101": _curve_sql([0.5], ["all"]) + _AP + " select category_id, round(ap, 9) as ap from ap",
    "relative_map50": _curve_sql([0.5], M.BINS) + _AP + " select bin, round(avg(ap), 9) as map50 from ap group by bin",
    "relative_map5095": _curve_sql(M.GRID, M.BINS) + _AP + " select b.bin, coalesce(round(max(case when t = 0 then ap end), 9), 0) as map50, coalesce(round(avg(ap), 9), 0) as map5095 from (values ('small'), ('medium'), ('large')) b(bin) left join (select bin, t, avg(ap) as ap from ap group by all) a using (bin) group by b.bin",
    "coco_ap": _coco(_DERIVED) + f" select metric, round(value, 9) as value from ({_METRICS})",
    "nms_merge": _nms_sql("select * from pred", 300, "first, rn"),
    "nms_capped": _nms_sql("select * from pred", 4, "first, rn"),
    "nms_top_k": _nms_sql("select * from pred", 4, "score desc, det_id"),
    "real_match_records": _records("all", _REAL),
    "real_prf_per_class": _prf(["all"], "category_id", _REAL),
    "real_ap": _curve_sql([0.5, 0.75], ["all", *M.BINS], base=_REAL) + _AP + " select category_id, t::int as t, bin, round(ap, 9) as ap from ap",
    "real_coco_ap": _coco(_REAL) + f" select metric, round(value, 9) as value from ({_METRICS})",
    "real_nms": _nms_sql("select * from pr", 300, "first, rn", C.SQL),
    "patch_project": f"with {X.SQL} select det_id, image_id, category_id, x, y, w, h, score from pred",
}


def _unpivoted(sql: str, prefix: str, columns: str, key: str = "") -> str:
    cast = ", ".join(f"{c}::double as {c}" for c in columns.split(", "))
    return f"select {prefix} || m as metric, value from (unpivot (select {key + ',' if key else ''} {cast} from ({sql})) on {columns} into name m value value)"


_RATES = "tp, fp, fn, precision, recall, f1"
SQL["evaluate_all"] = " union all ".join([
    f"select metric, value from ({SQL['coco_ap']})",
    _unpivoted(SQL["prf_overall"], "'overall_'", _RATES),
    _unpivoted(SQL["prf_by_size"], "'relative_' || bin || '_'", _RATES, "bin"),
    _unpivoted(SQL["relative_map5095"], "'relative_' || bin || '_'", "map50, map5095", "bin"),
])
