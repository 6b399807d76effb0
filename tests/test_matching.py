import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boxloom.operators import matching as M
from boxloom.operators import nms

GT = "ann_id long, image_id long, category_id long, x double, y double, w double, h double"
PRED = "det_id long, image_id long, category_id long, x double, y double, w double, h double, score double"


def iou(a, b):
    ix = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    iy = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    u = max(0.0, a[2]) * max(0.0, a[3]) + max(0.0, b[2]) * max(0.0, b[3]) - ix * iy
    return ix * iy / u if u > 0 else 0.0


def bin_of(b):
    r = max(b[2], 0) * max(b[3], 0) / 10000
    return "small" if r < 0.01 else "medium" if r < 0.05 else "large"


def holds(gt, pred, thr, counts, got, crowd=frozenset(), last=False):
    """Whether got, {det: (tp, fp, box or None)}, is what the rule says, looked at one detection at a time.

    A detection has a box if and only if one of its image and class that it overlaps enough was left by those before it,
    and there is none it would rather have: one that counts before one that doesn't, the greater overlap, the first id.
    """
    place = {d: (-s, d) for d, *_, s in pred}
    left = lambda a, d: a in crowd or not any(o != d and got[o][2] == a and place[o] < place[d] for o in got)
    for d, i, c, *b, _ in pred:
        if d not in got:
            continue
        tp, fp, mine = got[d]
        wish = {a: (counts(a, x), share(b, x) if a in crowd else iou(b, x), a if last else -a) for a, gi, gc, *x in gt if (gi, gc) == (i, c)}
        free = {a: w for a, w in wish.items() if w[1] >= thr and left(a, d)}
        if mine is None:
            assert not free and not tp, d
        else:
            assert mine in free and free[mine] == max(free.values()), d
            assert (tp, fp) == (int(wish[mine][0]), 0), d
    boxes = [m for _, _, m in got.values() if m is not None and m not in crowd]
    assert len(boxes) == len(set(boxes))


def share(p, g):
    ix, iy = min(p[0] + p[2], g[0] + g[2]) - max(p[0], g[0]), min(p[1] + p[3], g[1] + g[3]) - max(p[1], g[1])
    return max(0.0, ix) * max(0.0, iy) / (p[2] * p[3])


def crowded(seed, n=120):
    r = random.Random(seed)
    gt = [(k, r.randrange(3), r.randrange(2), float(r.randrange(40)), float(r.randrange(40)), float(r.choice([8, 10, 20, 30])), float(r.choice([8, 10, 20]))) for k in range(n)]
    pred = []
    for k in range(2 * n):
        _, i, c, x, y, w, h = r.choice(gt)
        pred.append((k, i, c, x + r.randrange(-3, 4), y + r.randrange(-3, 4), w, h, r.randrange(20) / 20))
    return gt, pred


@pytest.fixture(scope="module")
def scene(spark):
    gt, pred = crowded(5)
    images = spark.createDataFrame([(i, 100, 100) for i in range(3)], "image_id long, width int, height int")
    return gt, pred, spark.createDataFrame(gt, GT), spark.createDataFrame(pred, PRED), images


@pytest.mark.parametrize(("thr", "want"), [(0.5, "all"), (0.5, "small"), (0.3, "medium")])
def test_matches_where_boxes_contend(scene, thr, want):
    gt, pred, g, p, images = scene
    rec, _ = M.relative_records(g, p, images, [thr], [want])
    got = {r.det_id: (r.tp, r.fp, r.ann_id) for r in rec.collect()}
    assert set(got) == {r[0] for r in pred}
    holds(gt, pred, thr, lambda a, x: want in ("all", bin_of(x)), got)
    for d, *_, in pred:
        if got[d][2] is None:
            assert got[d][1] == int(want in ("all", bin_of(pred[d][3:7])))
    assert {r.det_id: (r.tp, r.fp) for r in M.match_records(g, p, images, thr, want).collect()} == {d: v[:2] for d, v in got.items()}


def test_hand_worked_scene(spark):
    """Two boxes side by side; the best detection takes the left one, the next, which wants it too, has the right one to take."""
    images = spark.createDataFrame([(1, 100, 100)], "image_id long, width int, height int")
    g = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (2, 1, 1, 3.0, 0.0, 10.0, 10.0)], GT)
    p = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (2, 1, 1, 1.0, 0.0, 10.0, 10.0, 0.8), (3, 1, 1, 1.0, 0.0, 10.0, 10.0, 0.8), (4, 1, 2, 0.0, 0.0, 10.0, 10.0, 0.99), (5, 1, 1, 0.0, 0.0, 10.0, 10.0, None), (6, 1, 1, 0.0, 0.0, 10.0, 10.0, float("nan"))], PRED)
    rec, _ = M.relative_records(g, p, images, [0.5], ["all"])
    assert {r.det_id: (r.tp, r.fp, r.ann_id) for r in rec.collect()} == {1: (1, 0, 1), 2: (1, 0, 2), 3: (0, 1, None), 4: (0, 1, None)}
    with pytest.raises(Exception, match="unknown image_id"):
        M.with_bins(g.withColumn("image_id", F.lit(9)), images, strict=True).collect()
    with pytest.raises(Exception, match="unknown image_id"):
        M.coco_metrics(g.withColumn("area", F.lit(100.0)), p.withColumn("image_id", F.lit(9)), images=images)


@pytest.mark.parametrize("rows", [7, 100_000])
def test_one_image_over_many_batches(spark, rows):
    """What is held of an image and class from batch to batch changes nothing; neither does the search along x."""
    gt, pred = crowded(11, 300)
    gt, pred = [(a, 1, 1, *b) for a, _, _, *b in gt], [(d, 1, 1, *b) for d, _, _, *b in pred]
    g, p = spark.createDataFrame(gt, GT).withColumns({"bits": F.lit(1).cast("bigint"), "crowd": F.lit(False)}), spark.createDataFrame(pred, PRED).withColumn("bits", F.lit(1).cast("bigint"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = {r.det_id: (r.tp, r.fp, r.ann_id) for r in M.records(g, p, [0.4], 1).collect()}
        few = {r.det_id for r in M.records(g, p, [0.4], 1, max_det=50).collect()}
        kept = {r.det_id for r in nms.suppress(p, 0.5, 60).collect()}
        whole = [r.det_id for r in nms.suppress(p, 0.5, None).orderBy(F.col("score").desc(), "det_id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(pred)
    holds(gt, pred, 0.4, lambda a, x: True, got)
    order = sorted(pred, key=lambda r: (-r[-1], r[0]))
    assert few == {r[0] for r in order[:50]}
    box = {r[0]: r[3:7] for r in pred}
    assert all(iou(box[a], box[b]) < 0.5 for k, a in enumerate(whole) for b in whole[:k])
    rank = {r[0]: k for k, r in enumerate(order)}
    assert all(any(rank[k] < rank[d] and iou(box[d], box[k]) >= 0.5 for k in whole) for d in box if d not in set(whole))
    assert kept == set(whole[:60])


def test_counts_follow_records(scene):
    gt, pred, g, p, images = scene
    got = {r.bin: r for r in M.counts(g, p, images, 0.5, 0.25, by_class=False).collect()}
    for want in ("all", "small", "medium", "large"):
        rec = M.match_records(g, p, images, 0.5, want, 0.25).collect()
        tp, fp = sum(r.tp for r in rec), sum(r.fp for r in rec)
        total = sum(1 for x in gt if want == "all" or bin_of(x[3:]) == want)
        assert (got[want].tp, got[want].fp, got[want].fn) == (tp, fp, total - tp)


def ap_model(rows, total):
    """Interpolated AP over 101 levels by definition; rows: (score, image, det, tp, fp)."""
    if not total:
        return None
    tp = fp = 0
    pts = []
    for *_, t, f in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
        if t or f:
            tp, fp = tp + t, fp + f
            pts.append((tp / total, tp / (tp + fp)))
    return sum(max((p for rc, p in pts if rc >= i * 0.01), default=0.0) for i in range(101)) / 101


def test_average_precision(scene):
    gt, pred, g, p, images = scene
    got = {(r.category_id, r.t, r.bin): r.ap for r in M.relative_ap(g, p, images, [0.5, 0.75], ["all", "small", "large"]).collect()}
    seen = 0
    for t, thr in enumerate([0.5, 0.75]):
        for want in ("all", "small", "large"):
            m = {r.det_id: (r.tp, r.fp) for r in M.match_records(g, p, images, thr, want).collect()}
            for c in (0, 1):
                rows = [(r[-1], r[1], r[0], *m[r[0]]) for r in pred if r[2] == c]
                total = sum(1 for x in gt if x[2] == c and (want == "all" or bin_of(x[3:]) == want))
                expect = ap_model(rows, total)
                assert (got.get((c, t, want)) is None) == (expect is None)
                if expect is not None:
                    assert got[c, t, want] == pytest.approx(expect, abs=1e-12)
                    seen += 1
    assert seen >= 8


@pytest.mark.parametrize("crowds", [frozenset(), frozenset({3, 10, 17, 40})])
def test_coco_metrics(spark, scene, crowds):
    gt, pred, g, p, _ = scene
    g = g.withColumn("area", F.col("w") * F.col("h")).withColumn("iscrowd", F.col("ann_id").isin(list(crowds)).cast("int") if crowds else F.lit(0))
    got = {r.metric: r.value for r in M.coco_metrics(g, p).collect()}
    flags = g.withColumn("crowd", F.col("iscrowd") == 1)
    bit = {n: i for i, n in enumerate(M.COCO_AREAS)}
    every = {r.det_id: (r.tp, r.fp) for r in M.records(flags.withColumn("bits", F.when(F.col("crowd"), F.lit(0).cast("bigint")).otherwise(M.area_bits(F.col("area")))), p.withColumn("bits", M.area_bits(F.col("w") * F.col("h"))), M.COCO_GRID, 4, True, 100).collect()}

    def cell(thr, name):
        return {d: (tp >> (M.COCO_GRID.index(thr) * 4 + bit[name]) & 1, fp >> (M.COCO_GRID.index(thr) * 4 + bit[name]) & 1) for d, (tp, fp) in every.items()}

    for thr, name in ((0.5, "all"), (M.COCO_GRID[3], "small"), (0.75, "medium")):
        lo, hi = M.COCO_AREAS[name]
        inside = F.when(~F.col("crowd") & F.col("area").between(lo, hi), 1).otherwise(0).cast("bigint")
        one = {r.det_id: (r.tp, r.fp, r.ann_id) for r in M.records(flags.withColumn("bits", inside), p.withColumn("bits", (F.col("w") * F.col("h")).between(lo, hi).cast("bigint")), [thr], 1, True, 100).collect()}
        holds(gt, pred, thr, lambda a, x, lo=lo, hi=hi: a not in crowds and lo <= x[2] * x[3] <= hi, one, crowds, last=True)
        assert {d: v[:2] for d, v in one.items()} == cell(thr, name)

    def mean(name, grid):
        v, (lo, hi) = [], M.COCO_AREAS[name]
        for thr in grid:
            m = cell(thr, name)
            for c in (0, 1):
                total = sum(1 for x in gt if x[2] == c and x[0] not in crowds and lo <= x[5] * x[6] <= hi)
                a = ap_model([(r[-1], r[1], r[0], *m[r[0]]) for r in pred if r[2] == c and r[0] in m], total)
                if a is not None:
                    v.append(a)
        return sum(v) / len(v) if v else -1.0

    assert got["coco_map5095"] == pytest.approx(mean("all", M.COCO_GRID), abs=1e-9)
    assert got["coco_map50"] == pytest.approx(mean("all", [0.5]), abs=1e-9)
    assert got["coco_ap_small"] == pytest.approx(mean("small", M.COCO_GRID), abs=1e-9)
    assert got["coco_ap_large"] == -1.0


def test_prediction_over_the_bin_border_and_out_of_range(spark):
    images = spark.createDataFrame([(1, 100, 100)], "image_id long, width int, height int")
    g = spark.createDataFrame([(1, 1, 1, 10.0, 10.0, 5.0, 5.0)], GT)
    p = spark.createDataFrame([(1, 1, 1, 9.0, 9.0, 10.0, 10.0, 0.9)], PRED)
    r = M.counts(g, p, images, 0.20, 0.25, ["small"], by_class=False).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (1, 0, 0, 1.0, 1.0, 1.0)
    far = spark.createDataFrame([(1, 1, 1, 50.0, 50.0, 30.0, 30.0, 0.9)], PRED)
    assert [(x.score, x.tp, x.fp) for x in M.match_records(g, far, images, 0.5, "small").collect()] == [(0.9, 0, 0)]
    none = p.limit(0)
    assert {x.metric: x.value for x in M.coco_metrics(g.withColumn("area", F.lit(25.0)), none).collect()} == dict.fromkeys(["coco_map5095", "coco_map50", "coco_map75", "coco_ap_small", "coco_ap_medium", "coco_ap_large", "coco_ar100"], 0.0)


def test_patches_merge(spark):
    patches = spark.createDataFrame([(1, 10, 0, 0), (2, 10, 32, 0)], "image_id long, source_image_id long, patch_x int, patch_y int")
    p = spark.createDataFrame([(1, 1, 1, 40.0, 10.0, 10.0, 10.0, 0.9), (2, 2, 1, 8.0, 10.0, 10.0, 10.0, 0.8)], PRED)
    got = nms.merge_patches(p, patches).collect()
    assert [(r.image_id, r.x, r.y, r.w, r.h) for r in got] == [(10, 40.0, 10.0, 10.0, 10.0)]
    stray = spark.createDataFrame([(3, 9, 1, 0.0, 0.0, 1.0, 1.0, 0.5)], PRED)
    with pytest.raises(Exception, match="unknown patch"):
        nms.project(stray, patches).collect()
    assert nms.project(stray, patches, strict=False).count() == 0


def test_suppression_and_cap(spark):
    _, pred = crowded(9, 60)
    p = spark.createDataFrame(pred, PRED)
    kept = defaultdict(list)
    by = defaultdict(list)
    for r in pred:
        by[r[1], r[2]].append(r)
    order = sorted(by, key=lambda k: (k[0], min(r[0] for r in by[k])))
    for k in order:
        for r in sorted(by[k], key=lambda r: (-r[-1], r[0])):
            mine = [o for o in kept[k[0]] if o[2] == k[1]]
            if len(kept[k[0]]) < 25 and all(iou(r[3:7], o[3:7]) < 0.5 for o in mine):
                kept[k[0]].append(r)
    got = {r.det_id for r in nms.suppress(p, 0.5, 25).collect()}
    assert got == {r[0] for v in kept.values() for r in v}
