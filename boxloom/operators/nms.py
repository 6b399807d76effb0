"""Detections of tiles brought back to their image, and overlapping ones of a class suppressed.

Suppression is sequential within an image and class, so detections are sorted there and stream through one pass that
holds what it has kept so far: at most the cap of an image. Groups are not collected, and many small ones are settled
at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import arrays as A

STEP = 512  # detections of a large group that are taken at once


def project(patch_pred: DataFrame, patches: DataFrame, strict: bool = True) -> DataFrame:
    """Detections in the pixels of the source image: image_id becomes its id.

    A detection of an unknown tile is an error; with strict off it is left out.
    """
    j = patch_pred.join(patches.select("image_id", "source_image_id", "patch_x", "patch_y"), "image_id", "left" if strict else "inner")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("prediction references unknown patch image_id="), F.coalesce(F.col("image_id").cast("string"), F.lit("null"))))
        j = j.withColumn("source_image_id", F.when(F.col("source_image_id").isNull(), unknown.cast("bigint")).otherwise(F.col("source_image_id")))
    moved = {"image_id": F.col("source_image_id"), "x": F.col("x") + F.col("patch_x"), "y": F.col("y") + F.col("patch_y")}
    return j.withColumns(moved).select(*patch_pred.columns)


def _in_order(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which of n rows stay, if a row that stays drops all later ones it is paired with. Pairs: i before j."""
    undecided, keep = np.ones(n, bool), np.zeros(n, bool)
    while True:
        held = np.zeros(n, bool)
        held[j] = True  # some earlier row that is kept or undecided is in its way
        new = undecided & ~held
        if not new.any():
            return keep
        keep |= new
        undecided &= ~new
        undecided[j[keep[i]]] = False
        live = undecided[j] & (undecided[i])
        i, j = i[live], j[live]


def _large(box: np.ndarray, kept: np.ndarray, thr: float, room: int) -> np.ndarray:
    """Rows of one group that stay, some at a time, after those in kept; at most room of them."""
    out: list[int] = []
    for lo in range(0, len(box), STEP):
        if len(out) >= room:
            break
        part = box[lo : lo + STEP]
        free = np.ones(len(part), bool)
        if len(kept):
            i, j = A.meeting(part, kept)
            free[i[A.iou(kept[j], part[i]) >= thr]] = False
        rows = np.flatnonzero(free)
        i, j = A.meeting(part[rows], part[rows])
        i, j = i[i < j], j[i < j]
        close = A.iou(part[rows[i]], part[rows[j]]) >= thr
        mine = rows[_in_order(i[close], j[close], len(rows))]
        out += (lo + mine).tolist()
        kept = np.concatenate([kept, part[mine]])
    return np.array(out[: max(room, 0)], np.int64)


_OUT = "det_id bigint, image_id bigint, category_id bigint, x double, y double, w double, h double, score double, first bigint, p bigint"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _stream(thr: float, cap: int | None):
    most = np.iinfo(np.int64).max if cap is None else cap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, first, open_ = None, np.empty((0, 4)), 0, []  # of the group that may go on; open_: its rows to send

        def batch(parts: list[tuple]) -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _NAMES)

        for b in batches:
            if not b.num_rows:
                continue
            img, cat, det = A.whole(b, "image_id", "category_id", "det_id")
            score, *xywh = A.numbers(b, "score", "x", "y", "w", "h")
            box = np.stack(xywh, axis=1)
            new = np.r_[True, (img[1:] != img[:-1]) | (cat[1:] != cat[:-1])]
            begin = np.flatnonzero(new)
            size = np.diff(np.r_[begin, len(img)])
            goes_on = key == (img[0], cat[0])
            done = []
            if not goes_on and open_:
                done += open_
                open_ = []
            if not goes_on:
                kept, count = np.empty((0, 4)), 0
            else:
                count = len(kept)
            grp = np.repeat(np.arange(len(begin)), size)
            pos = np.arange(len(img)) - begin[grp]
            keep = np.zeros(len(img), bool)
            plain = size <= A.FLAT
            plain[0] &= not goes_on
            at = np.flatnonzero(plain[grp])
            j = np.repeat(at, pos[at])
            i = A.spread(begin[grp[at]], pos[at])
            close = A.iou(box[i], box[j]) >= thr
            few = np.zeros(len(img), np.int64)
            few[at] = np.arange(len(at))
            keep[at[_in_order(few[i[close]], few[j[close]], len(at))]] = True
            for g in np.flatnonzero(~plain):
                lo = begin[g]
                old = kept if g == 0 else np.empty((0, 4))
                keep[lo + _large(box[lo : lo + size[g]], old, thr, most - len(old))] = True
            rank = np.cumsum(keep) - keep
            rank = rank - rank[begin][grp] + np.where(grp == 0, count, 0)
            keep &= rank < most
            least = np.minimum.reduceat(det, begin)
            if goes_on:
                least[0] = min(least[0], first)
            rows = np.flatnonzero(keep)
            part = lambda r: (det[r], img[r], cat[r], *box[r].T, score[r], least[grp[r]], rank[r])
            last = len(begin) - 1
            if cap is None:
                done.append(part(rows))
            else:
                if goes_on and open_:  # what was kept of the group before learns its least id
                    open_ = [(*o[:8], np.full(len(o[0]), least[0]), o[9]) for o in open_]
                    if last > 0:
                        done += open_
                        open_ = []
                ends = rows[grp[rows] == last]
                done.append(part(rows[grp[rows] < last]))
                open_.append(part(ends))
            mine = box[rows[grp[rows] == last]]
            kept = np.concatenate([kept, mine]) if goes_on and last == 0 else mine
            key, first = (img[-1], cat[-1]), int(least[last])
            if done:
                yield batch(done)
        if open_:
            yield batch(open_)

    return run


def suppress(pred: DataFrame, threshold: float = 0.5, max_detections: int | None = 300, cap: str = "shared") -> DataFrame:
    """Greedy suppression within image and class by falling score (equal ones by det_id), then the cap of an image.

    cap shared: classes are filled one after the other, by the least det_id of each, until the image is full; top_k:
    the best of all classes. No class can give more than the cap, so the pass over it keeps no more than that; without
    a cap it holds what is kept of one image and class. Detections without an image, class, id, score (nan included) or
    four numbers as a box are left out; an empty table gives no rows.
    """
    if cap not in ("shared", "top_k"):
        raise ValueError("cap must be shared or top_k")
    d = scored(pred)
    d = d.repartition("image_id", "category_id").sortWithinPartitions("image_id", "category_id", F.col("score").desc(), "det_id")
    kept = d.mapInArrow(_stream(float(threshold), max_detections), _OUT)
    if max_detections is not None:
        order = ["first", "p"] if cap == "shared" else [F.col("score").desc(), F.col("det_id")]
        kept = kept.withColumn("rn", F.row_number().over(Window.partitionBy("image_id").orderBy(*order))).where(F.col("rn") <= max_detections)
    return kept.select("det_id", "image_id", "category_id", "x", "y", "w", "h", "score")


def scored(pred: DataFrame) -> DataFrame:
    """The detections that have an image, class, id, score and four numbers as a box, in the types used for them."""
    ids = [F.col(c).cast("bigint").alias(c) for c in ("image_id", "category_id", "det_id")]
    values = [F.col(c).cast("double").alias(c) for c in ("score", "x", "y", "w", "h")]
    return pred.select(*ids, *values).na.drop()  # drops nan as well


def merge_patches(patch_pred: DataFrame, patches: DataFrame, threshold: float = 0.5, max_detections: int = 300) -> DataFrame:
    return suppress(project(patch_pred, patches), threshold, max_detections)
