"""Greedy matching of detections to ground truth by score and IoU, for many thresholds and size bins at once.

Boxes and detections of an image and class are brought together by one shuffle, sorted by falling score, and stream
through one pass that holds the boxes of one image and class, never its detections. IoU is computed once for each pair;
every combination of threshold and bin (a cell) is then settled on the same pairs, many images at once, in numpy: of the
detections whose best free box nobody before them can take, all are settled in one round. A detection comes out with
two bit masks, the cells in which it is a true and in which it is a false positive, so counts and curves of all cells
follow from one row each.

Curves need ranks within a class, and there may be only a few classes: rows are partitioned by sampled quantiles of
class and score and packed into chunks with their sums; offsets come from the chunks, and each chunk reports its best
precision at each of the 101 recall levels. No task sees a class as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import arrays as A
from boxloom.functions.boxes import iou, num, relative_area, size_bin
from boxloom.plans.prefix import running_sums
from boxloom.plans.shared import Scratch

ALL, BINS = "all", ("small", "medium", "large")
GRID = tuple(0.5 + i * ((0.5 + 0.05) - 0.5) for i in range(10))
COCO_GRID = tuple(float(t) for t in np.linspace(0.5, 0.95, 10))
COCO_AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
CHUNK = 65_536  # rows packed together for the curves


def _box(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in "xywh")


def with_bins(boxes: DataFrame, images: DataFrame, small_max: float = 0.01, medium_max: float = 0.05, strict: bool = False) -> DataFrame:
    """boxes with the bin of their share of the image. Boxes of unknown images are left out, or with strict an error."""
    known = images.select("image_id", "width", "height")
    if strict:
        b = boxes.join(known.withColumn("_known", F.lit(True)), "image_id", "left")
        bad = F.raise_error(F.concat(F.lit("annotation references unknown image_id="), F.coalesce(F.col("image_id").cast("string"), F.lit("null"))))
        b = b.withColumn("width", F.when(F.col("_known").isNull(), bad.cast("int")).otherwise(F.col("width"))).drop("_known")
    else:
        b = boxes.join(known, "image_id")
    return b.withColumn("bin", size_bin(relative_area(F.col("w"), F.col("h"), F.col("width"), F.col("height")), small_max, medium_max)).drop("width", "height")


def pairs(gt: DataFrame, pred: DataFrame, cut: float) -> DataFrame:
    """(image_id, category_id, det_id, score, ann_id, v): pairs of one image and class with IoU v of at least cut."""
    g = gt.select("image_id", "category_id", "ann_id", *[F.col(c).alias(f"g{c}") for c in "xywh"])
    p = pred.select("image_id", "category_id", "det_id", "score", *[F.col(c).alias(f"p{c}") for c in "xywh"])
    j = g.join(p, ["image_id", "category_id"]).withColumn("v", iou(_box("p"), _box("g"))).where(F.col("v") >= num(cut))
    return j.select("image_id", "category_id", "det_id", "score", "ann_id", "v")


def no_crowds(gt: DataFrame) -> DataFrame:
    """gt without its crowd boxes, as the relative measures have it."""
    return gt.where(F.coalesce("iscrowd", F.lit(0)) == 0) if "iscrowd" in gt.columns else gt


def bin_bits(bins: Sequence[str], own: Column) -> Column:
    """Bits of the bins that a box with the bin own counts in: all, and its own."""
    bits = [F.lit(1 << i) if b == ALL else F.when(own == b, 1 << i).otherwise(0) for i, b in enumerate(bins)]
    return sum(bits[1:], bits[0]).cast("bigint")


def area_bits(v: Column) -> Column:
    """Bits of the COCO ranges that a box of area v counts in."""
    bits = [F.when((v >= num(lo)) & (v <= num(hi)), 1 << i).otherwise(0) for i, (lo, hi) in enumerate(COCO_AREAS.values())]
    return sum(bits[1:], bits[0]).cast("bigint")


class Boxes:
    """Boxes of the image and class at hand, and the cells in which each is used up."""

    def __init__(self, ident: np.ndarray, box: np.ndarray, bits: np.ndarray, crowd: np.ndarray, used: np.ndarray) -> None:
        self.ident, self.box, self.bits, self.crowd, self.used = ident, box, bits, crowd, used

    def take(self, rows: np.ndarray | slice) -> Boxes:
        return Boxes(self.ident[rows], self.box[rows], self.bits[rows], self.crowd[rows], self.used[rows])

    def then(self, other: Boxes) -> Boxes:
        return Boxes(*(np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("ident", "box", "bits", "crowd", "used")))


def _candidates(box: np.ndarray, group: np.ndarray, g: Boxes, g_group: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(detection, box, IoU) of all pairs of a group with at least cut, by detection."""
    n_groups = int(max(group.max(initial=-1), g_group.max(initial=-1))) + 1
    count = np.bincount(g_group, minlength=n_groups)
    begin = np.cumsum(count) - count
    few = count[group] <= A.FLAT
    rows = np.flatnonzero(few)
    n = count[group[rows]]
    d, k = [np.repeat(rows, n)], [A.spread(begin[group[rows]], n)]
    for many in np.unique(group[~few]):
        own = np.flatnonzero(group == many)
        i, j = A.meeting(box[own], g.box[begin[many] : begin[many] + count[many]])
        d.append(own[i])
        k.append(begin[many] + j)
    d, k = np.concatenate(d), np.concatenate(k)
    v = A.iou(box[d], g.box[k])
    c = g.crowd[k]
    if c.any():
        v[c] = A.cover(box[d[c]], g.box[k[c]])
    ok = v >= cut
    return d[ok], k[ok], v[ok]


def _settle(idx: np.ndarray, d: np.ndarray, k: np.ndarray, valid: np.ndarray, crowd: np.ndarray, used: np.ndarray, n: int) -> np.ndarray:
    """The pairs of one cell that become matches. idx: the cell's pairs, by detection and preference; used is brought up to date."""
    best, first, over = np.empty(n, np.int64), np.empty(len(used), np.int64), np.zeros(n, bool)
    out = []
    while len(idx := idx[~used[k[idx]]]):
        own, back = d[idx], idx[::-1]
        who = own[np.r_[True, own[1:] != own[:-1]]]
        first[k[back]] = d[back]  # the last one written is the first detection that could take the box
        best[d[back]] = back
        fit = back[valid[back]]
        best[d[fit]] = fit  # boxes that count in the bin go before others
        pick = best[who]
        box = k[pick]
        ok = crowd[box] | (first[box] == who)
        out.append(pick[ok])
        used[box[ok & ~crowd[box]]] = True
        over[who[ok]] = True
        idx = idx[~over[own]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


_RECORD = "image_id bigint, category_id bigint, det_id bigint, score double, tp bigint, fp bigint, ann_id bigint"


def _match(grid: Sequence[float], n_bins: int, last_wins: bool, max_det: int | None):
    cut, names = min(grid), [c.split()[0] for c in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen = None, None, 0  # the group that may go on: its boxes, its detections so far
        for b in batches:
            if not b.num_rows:
                continue
            img, cat, tag, ident, bits = A.whole(b, "image_id", "category_id", "tag", "ident", "bits")
            score, *xywh = A.numbers(b, "score", "x", "y", "w", "h")
            box, crowd = np.stack(xywh, axis=1), b.column("crowd").to_numpy(zero_copy_only=False).astype(bool)
            new = np.r_[True, (img[1:] != img[:-1]) | (cat[1:] != cat[:-1])]
            grp = np.cumsum(new) - 1
            is_box = tag == 0
            g = Boxes(ident[is_box], box[is_box], bits[is_box], crowd[is_box], np.zeros(int(is_box.sum()), np.int64))
            g_grp = grp[is_box]
            goes_on = key == (img[0], cat[0])
            if goes_on:
                g, g_grp = held.then(g), np.r_[np.zeros(len(held.ident), np.int64), g_grp]
            rows = np.flatnonzero(~is_box)
            own = grp[rows]
            n_own = np.bincount(own, minlength=int(grp[-1]) + 1)
            if max_det is not None:
                pos = np.arange(len(rows)) - (np.cumsum(n_own) - n_own)[own] + np.where(own == 0, seen if goes_on else 0, 0)
                rows, own = rows[pos < max_det], own[pos < max_det]
            d, k, v = _candidates(box[rows], own, g, g_grp, cut)
            tie = g.ident[k]
            order = np.lexsort((-tie if last_wins else tie, -v, d))
            d, k, v = d[order], k[order], v[order]
            tp, hit, ann = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
            for t, thr in enumerate(grid):
                reach = np.flatnonzero(v >= thr)
                for s in range(n_bins):
                    cell = np.int64(t * n_bins + s)
                    valid = (g.bits[k] >> s & 1).astype(bool)
                    used = (g.used >> cell & 1).astype(bool)
                    m = _settle(reach, d, k, valid, g.crowd, used, len(rows))
                    g.used |= used.astype(np.int64) << cell
                    hit[d[m]] |= np.int64(1) << cell
                    tp[d[m]] |= valid[m].astype(np.int64) << cell
                    if cell == 0:
                        ann[d[m]] = g.ident[k[m]]
            fp = np.zeros(len(rows), np.int64)
            for t in range(len(grid)):
                fp |= bits[rows] << np.int64(t * n_bins)
            fp &= ~hit
            last = int(grp[-1])
            held = g.take(g_grp == last)
            seen = (seen if goes_on and last == 0 else 0) + int(n_own[last])
            key = (img[-1], cat[-1])
            if len(rows):
                cols = [pa.array(c) for c in (img[rows], cat[rows], ident[rows], score[rows], tp, fp)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ann, mask=ann < 0)], names)

    return run


def records(gt: DataFrame, pred: DataFrame, grid: Sequence[float], n_bins: int, last_wins: bool = False, max_det: int | None = None) -> DataFrame:
    """(image_id, category_id, det_id, score, tp, fp, ann_id) of each detection; tp and fp are bit masks of cells.

    The cell of threshold t and bin s is bit t * n_bins + s; neither bit is set where a detection is to be ignored.
    gt: image_id, category_id, ann_id, x, y, w, h, bits (of the bins a box counts in; elsewhere it is ignored, but used up
    by a match) and crowd (ignored, never used up). pred: image_id, category_id, det_id, score, x, y, w, h and bits (of
    the bins in which it is false if nothing matches it). ann_id: what it is matched with in the first cell.

    Detections go by falling score, equal ones by det_id; each takes the free box of greatest IoU, of those that count in
    the bin if any, else of the others; of equal boxes the first by ann_id, or the last with last_wins. With max_det only
    the best of an image and class count. Detections without image, class, id, score (nan included) or a number of their
    box are left out; boxes without image, class or id are too. Empty tables give no rows.
    """
    if len(grid) * n_bins > 62:
        raise ValueError("at most 62 combinations of thresholds and bins")
    slim = lambda d, tag, ident, score, crowd: d.select(
        F.col("image_id").cast("bigint").alias("image_id"), F.col("category_id").cast("bigint").alias("category_id"), F.lit(tag).alias("tag"), F.col(ident).cast("bigint").alias("ident"),
        score.alias("score"), *[F.col(c).cast("double").alias(c) for c in "xywh"], F.col("bits"), crowd.alias("crowd"),
    )
    p = slim(pred, 1, "det_id", F.col("score").cast("double"), F.lit(False)).na.drop()
    g = slim(gt, 0, "ann_id", F.lit(0.0), F.col("crowd")).na.drop(subset=["image_id", "category_id", "ident"])
    both = g.unionByName(p).repartition("image_id", "category_id").sortWithinPartitions("image_id", "category_id", "tag", F.col("score").desc(), "ident")
    return both.mapInArrow(_match([float(t) for t in grid], n_bins, last_wins, max_det), _RECORD)


def relative_records(gt: DataFrame, pred: DataFrame, images: DataFrame, grid: Sequence[float], bins: Sequence[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The records, and (category_id, bits) of the boxes. Crowds, and whatever is in no known image, are left out."""
    g = with_bins(no_crowds(gt), images, strict=strict).withColumn("bits", bin_bits(bins, F.col("bin"))).withColumn("crowd", F.lit(False))
    p = with_bins(pred, images).withColumn("bits", bin_bits(bins, F.col("bin")))
    return records(g, p, grid, len(bins)), g.select("category_id", "bits")


def match_records(gt: DataFrame, pred: DataFrame, images: DataFrame, threshold: float = 0.5, bin_: str = ALL, conf: float = 0.0) -> DataFrame:
    """(det_id, image_id, category_id, score, tp, fp) of every detection from conf on: neither means that it is ignored."""
    r, _ = relative_records(gt, pred.where(F.col("score") >= num(conf)), images, [threshold], [bin_])
    return r.select("det_id", "image_id", "category_id", "score", F.col("tp").cast("int").alias("tp"), F.col("fp").cast("int").alias("fp"))


def _rates(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp and fn; 0 where there is nothing to divide by."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    pr = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(num(0))
    rc = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(num(0))
    df = df.withColumn("precision", pr).withColumn("recall", rc)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(num(0))
    return df.withColumn("f1", f1)


def _bit(mask: str, i: int) -> Column:
    return F.shiftright(mask, i).bitwiseAND(F.lit(1).cast("bigint"))


def counted(rec: DataFrame, boxes: DataFrame, bins: Sequence[str], conf: float, by_class: bool) -> DataFrame:
    """tp, fp, fn and rates of each bin, and class if asked for, at the records' first threshold.

    conf cuts a prefix of the greedy order, so records of all scores serve any conf. Only classes of which there is a box
    or a detection from conf on come out, with all bins.
    """
    zero = F.lit(0).cast("bigint")
    r = rec.where(F.col("score") >= num(conf)).groupBy("category_id").agg(*[F.sum(_bit(m, i)).alias(f"{m}{i}") for i in range(len(bins)) for m in ("tp", "fp")])
    g = boxes.groupBy("category_id").agg(*[F.sum(_bit("bits", i)).alias(f"gt{i}") for i in range(len(bins))])
    both = r.join(g, "category_id", "full")
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("bin"), *[F.coalesce(f"{m}{i}", zero).alias(m) for m in ("tp", "fp", "gt")]) for i, b in enumerate(bins)])).alias("v")
    keys = ["category_id", "bin"] if by_class else ["bin"]
    s = both.select("category_id", rows).select("category_id", "v.*").groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("gt").alias("gt"))
    return _rates(s.select(*keys, "tp", "fp", (F.col("gt") - F.col("tp")).alias("fn")))


def counts(gt: DataFrame, pred: DataFrame, images: DataFrame, threshold: float = 0.5, conf: float = 0.25, bins: Sequence[str] = (ALL, *BINS), by_class: bool = True) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of each bin, and class if asked for."""
    return counted(*relative_records(gt, pred.where(F.col("score") >= num(conf)), images, [threshold], bins), bins, conf, by_class)


def curve(gt: DataFrame, pred: DataFrame, images: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(category_id, score, image_id, det_id, n_tp, n_fp, recall, precision) at each true positive, by falling score.

    Precision only rises at a true positive, so these points hold all of its maxima. Negative scores are left out.
    """
    rec, boxes = relative_records(gt, pred.where(F.col("score") >= num(0)), images, [threshold], [ALL])
    total = boxes.groupBy("category_id").agg(F.count("*").alias("total"))
    rec = Scratch(gt.sparkSession, "curve").cut(rec.where("tp > 0 or fp > 0").select("category_id", "score", "image_id", "det_id", "tp", "fp"))  # the ranges are sampled from it
    run = running_sums(rec, ["category_id"], [F.col("score").desc(), F.col("image_id"), F.col("det_id")], {"n_tp": F.col("tp"), "n_fp": F.col("fp")})
    pts = run.where("tp = 1").join(total, "category_id")
    return pts.select("category_id", "score", "image_id", "det_id", "n_tp", "n_fp", (F.col("n_tp") / F.col("total")).alias("recall"), (F.col("n_tp") / (F.col("n_tp") + F.col("n_fp"))).alias("precision"))


def _unpacked(masks: np.ndarray, cells: int) -> np.ndarray:
    """A row for each mask, a column for each cell."""
    return np.unpackbits(masks.astype("<i8").view(np.uint8).reshape(len(masks), 8), axis=1, bitorder="little")[:, :cells]


_CHUNK = "category_id bigint, seq bigint, tp array<bigint>, fp array<bigint>, sums array<bigint>"


def _pack(cells: int):
    """Sorted (category_id, tp, fp) rows to chunks of one class, with the sums of all cells."""
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tps, fps, n, seq = None, [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal tps, fps, n, seq
            tp, fp = np.concatenate(tps), np.concatenate(fps)
            sums = np.r_[_unpacked(tp, cells).sum(axis=0, dtype=np.int64), _unpacked(fp, cells).sum(axis=0, dtype=np.int64)]
            row = [[key], [seq], [tp], [fp], [sums]]
            tps, fps, n, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in _CHUNK.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            cat, tp, fp = A.whole(b, "category_id", "tp", "fp")
            cuts = np.flatnonzero(np.r_[True, cat[1:] != cat[:-1]])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(cat)], strict=True):
                if n and key != cat[lo]:
                    yield close()
                key = int(cat[lo])
                while lo < hi:
                    to = min(hi, lo + CHUNK - n)
                    tps.append(tp[lo:to])
                    fps.append(fp[lo:to])
                    n, lo = n + to - lo, to
                    if n == CHUNK:
                        yield close()
        if n:
            yield close()

    return run


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each class in order to what comes before each: a row a chunk, one class open at a time."""
    key, acc = None, None
    for b in batches:
        out = []
        for cat, sums in zip(b.column(0).to_pylist(), b.column(3), strict=True):
            now = sums.values.to_numpy()
            if cat != key:
                key, acc = cat, np.zeros(len(now), np.int64)
            out.append(acc)
            acc = acc + now
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.int64()))], ["category_id", "pid", "seq", "before"])


def _levels(cells: int, n_bins: int):
    names, types = ["category_id", "cell", "level", "p", "r"], [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                cat = b.column("category_id")[k].as_py()
                tp, fp, before, total = (b.column(n)[k].values.to_numpy() for n in ("tp", "fp", "before", "total"))
                tp, fp = _unpacked(tp, cells), _unpacked(fp, cells)
                out = []
                for c in np.flatnonzero(tp.any(axis=0)):
                    if not total[c % n_bins]:
                        continue  # a bin that nobody asked for
                    at = np.flatnonzero(tp[:, c])
                    n_tp, n_fp = before[c] + np.arange(1, len(at) + 1), before[cells + c] + np.cumsum(fp[:, c], dtype=np.int64)[at]
                    rc, pr = n_tp / total[c % n_bins], n_tp / (n_tp + n_fp)
                    i = np.floor(rc * 100)  # how many of the 101 levels i * 0.01 are at most rc
                    i = np.where((i + 1) * 0.01 <= rc, i + 1, np.where(i * 0.01 > rc, i - 1, i))
                    level = np.minimum(i, 100).astype(np.int64) + 1
                    cut = np.flatnonzero(np.r_[True, level[1:] != level[:-1]])
                    ends = np.r_[cut[1:], len(level)] - 1
                    out.append((np.full(len(cut), cat), np.full(len(cut), c), level[cut], np.maximum.reduceat(pr, cut), rc[ends]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def average_precision(rec: DataFrame, totals: DataFrame, n_grid: int, bins: Sequence[str]) -> DataFrame:
    """(category_id, t, bin, ap, last_recall): mean over 101 recall levels of the best precision at that recall or more.

    rec as from records, written or cheap to compute twice, as its ranges are sampled; totals: (category_id, bin, total).
    Cells are those that have a box; those without a true positive have 0. Detections go by (score desc, image_id, det_id).
    """
    n_bins = len(bins)
    cells = n_grid * n_bins
    s = Scratch(rec.sparkSession, "chunks")
    per = totals.groupBy("category_id").agg(*[F.coalesce(F.max(F.when(F.col("bin") == b, F.col("total"))), F.lit(0)).alias(f"t{i}") for i, b in enumerate(bins)])
    per = per.select("category_id", F.array(*[F.col(f"t{i}").cast("bigint") for i in range(n_bins)]).alias("total"))
    by = [F.col("category_id"), F.col("score").desc(), F.col("image_id"), F.col("det_id")]
    ordered = rec.where("tp <> 0 or fp <> 0").select("category_id", "score", "image_id", "det_id", "tp", "fp").repartitionByRange(*by).sortWithinPartitions(*by)
    chunks = s.cut(ordered.select("category_id", "tp", "fp").mapInArrow(_pack(cells), _CHUNK).withColumn("pid", F.spark_partition_id()))
    sums = chunks.select("category_id", "pid", "seq", "sums").repartition("category_id").sortWithinPartitions("category_id", "pid", "seq")
    before = sums.mapInArrow(_offsets, "category_id bigint, pid int, seq bigint, before array<bigint>")
    full = chunks.join(before, ["category_id", "pid", "seq"]).join(per, "category_id").select("category_id", "tp", "fp", "before", "total")
    level = full.mapInArrow(_levels(cells, n_bins), "category_id bigint, cell int, level int, p double, r double")
    key = ["category_id", "cell"]
    level = level.groupBy(*key, "level").agg(F.max("p").alias("p"), F.max("r").alias("r"))
    best = F.max("p").over(Window.partitionBy(*key).orderBy(F.col("level").desc()))  # at most 101 rows each
    below = F.coalesce(F.lag("level").over(Window.partitionBy(*key).orderBy("level")), F.lit(0))
    ap = level.withColumn("area", best * (F.col("level") - below)).groupBy(*key).agg((F.sum("area") / 101).alias("ap"), F.max("r").alias("last_recall"))
    number = F.element_at(F.create_map(*[x for i, b in enumerate(bins) for x in (F.lit(b), F.lit(i))]), F.col("bin"))
    grid = totals.where(F.col("total") > 0).select("category_id", "bin", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("t"))
    grid = grid.withColumn("cell", (F.col("t") * n_bins + number).cast("int"))
    return grid.join(ap, key, "left").select("category_id", "t", "bin", F.coalesce("ap", num(0)).alias("ap"), F.coalesce("last_recall", num(0)).alias("last_recall"))


def bin_totals(boxes: DataFrame, bins: Sequence[str]) -> DataFrame:
    """(category_id, bin, total) of (category_id, bits)."""
    g = boxes.groupBy("category_id").agg(*[F.sum(_bit("bits", i)).alias(f"t{i}") for i in range(len(bins))])
    return g.select("category_id", F.explode(F.array(*[F.struct(F.lit(b).alias("bin"), F.col(f"t{i}").alias("total")) for i, b in enumerate(bins)])).alias("v")).select("category_id", "v.*")


def relative_ap(gt: DataFrame, pred: DataFrame, images: DataFrame, grid: Sequence[float] = GRID, bins: Sequence[str] = BINS) -> DataFrame:
    """AP of each class, threshold and bin that has a box. Negative scores are left out."""
    s = Scratch(gt.sparkSession, "relative")
    rec, boxes = relative_records(gt, pred.where(F.col("score") >= num(0)), images, grid, bins)
    return average_precision(s.cut(rec), s.cut(bin_totals(boxes, bins)), len(grid), bins)


def mean_ap(ap: DataFrame) -> DataFrame:
    """(bin, map50, map5095) of each size bin; 0 where no class has a box in it."""
    by = ap.groupBy("bin", "t").agg(F.avg("ap").alias("ap")).groupBy("bin").agg(F.max(F.when(F.col("t") == 0, F.col("ap"))).alias("map50"), F.avg("ap").alias("map5095"))
    names = ap.sparkSession.createDataFrame([(b,) for b in BINS], "bin string")
    return names.join(by, "bin", "left").na.fill(0.0)


def relative_map(gt: DataFrame, pred: DataFrame, images: DataFrame) -> DataFrame:
    return mean_ap(relative_ap(gt, pred, images))


def _known(pred: DataFrame, images: DataFrame) -> DataFrame:
    """pred, where a detection of an unknown image is an error."""
    j = pred.join(images.select("image_id").distinct().withColumn("_known", F.lit(True)), "image_id", "left")
    bad = F.raise_error(F.concat(F.lit("prediction references unknown image_id="), F.coalesce(F.col("image_id").cast("string"), F.lit("null"))))
    return j.withColumn("det_id", F.when(F.col("_known").isNull(), bad.cast("bigint")).otherwise(F.col("det_id"))).drop("_known")


def coco_metrics(gt: DataFrame, pred: DataFrame, max_det: int = 100, images: DataFrame | None = None) -> DataFrame:
    """(metric, value): mAP at 0.50:0.95, 0.50 and 0.75, AP by pixel area, AR at max_det.

    gt has area, and iscrowd if there are crowds. Boxes outside an area range and crowds are ignored, a crowd may be
    matched again; the last of equal boxes wins; max_det detections of an image and class count. Without a box -1,
    without any detection 0 for all. With images a detection of an image that isn't in it is an error.
    """
    s, names = Scratch(gt.sparkSession, "coco"), list(COCO_AREAS)
    crowd = F.coalesce(F.col("iscrowd"), F.lit(0)) == 1 if "iscrowd" in gt.columns else F.lit(False)
    g = gt.withColumn("crowd", crowd).withColumn("bits", F.when(F.col("crowd"), F.lit(0).cast("bigint")).otherwise(area_bits(F.col("area"))))
    p = (pred if images is None else _known(pred, images)).withColumn("bits", area_bits(F.col("w") * F.col("h")))
    rec = s.cut(records(g, p, COCO_GRID, len(names), last_wins=True, max_det=max_det))
    ap = s.cut(average_precision(rec, s.cut(bin_totals(g.where(~F.col("crowd")), names)), len(COCO_GRID), names))
    mean = lambda c, keep: F.coalesce(F.avg(F.when(keep, F.col(c))), num(-1))
    b, t = F.col("bin"), F.col("t")
    out = ap.agg(
        mean("ap", b == "all").alias("coco_map5095"), mean("ap", (b == "all") & (t == 0)).alias("coco_map50"), mean("ap", (b == "all") & (t == 5)).alias("coco_map75"),
        mean("ap", b == "small").alias("coco_ap_small"), mean("ap", b == "medium").alias("coco_ap_medium"), mean("ap", b == "large").alias("coco_ap_large"), mean("last_recall", b == "all").alias("coco_ar100"),
    )
    long = out.unpivot([], out.columns, "metric", "value")
    return long.withColumn("value", num(0)) if rec.isEmpty() else long
