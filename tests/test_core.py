import random
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boxloom.operators import heavy_keys, prepare, profile, quality, referential, tiling
from boxloom.plans.prefix import running_sums

T = [datetime(2025, 1, d) for d in range(1, 29)]
ANN = "id long, image_id long, category_id long, bbox array<double>, area double, iscrowd int, received_at timestamp, id_extra long"


def test_heavy_keys(spark):
    r = random.Random(1)
    rows, want = [], defaultdict(lambda: [0, set(), []])
    for i in range(4000):
        cat = None if r.random() < 0.1 else 1 if r.random() < 0.7 else r.randrange(2, 9)
        img = None if r.random() < 0.05 else 7 if r.random() < 0.5 else r.randrange(50)
        box = r.choice([[0.0, 0.0, 2.0, float(r.randrange(1, 9))], None, [1.0], [0.0, 0.0, -1.0, 2.0], [0.0, 0.0, float("nan"), 1.0]])
        rows.append((i, 99, 5, [0.0, 0.0, 1.0, 1.0], None, 0, T[0], 1))
        rows.append((i, img, cat, box, None, 0, T[1], 2))
        if cat is not None:
            w = want[cat]
            w[0] += 1
            w[1] |= {img} - {None}
            if box and len(box) == 4 and box[2] > 0:
                w[2].append(box[2] * box[3])
    rows.append((None, 1, 1, None, None, 0, T[0], 3))
    df = spark.createDataFrame(rows + rows[:50], ANN).repartition(7)
    got = {x.category_id: (x.n_annotations, x.n_images, x.mean_box_area) for x in heavy_keys.category_stats(df).collect()}
    assert set(got) == set(want)
    for k, (n, images, areas) in want.items():
        assert got[k][:2] == (n, len(images))
        assert got[k][2] == pytest.approx(sum(areas) / len(areas), abs=1e-6)
    assert {x.category_id for x in heavy_keys.heavy_categories(df).collect()} == {k for k, v in want.items() if v[0] >= 0.08 * 4000}
    assert heavy_keys.category_stats(df.limit(0)).count() == 0


def test_states_stitch_over_borders(spark):
    s = spark.createDataFrame([(0, False, 1, 5, 2, 10, 11, 3.0, 2), (1, False, 1, 4, 1, 11, 11, 1.0, 1), (2, False, 1, 2, 2, 11, 12, 0.0, 0), (2, False, 2, 1, 0, None, None, 0.0, 0), (2, True, 0, 9, 0, None, None, 0.0, 0)], heavy_keys.STATE)
    assert {tuple(r) for r in heavy_keys.stitch(s).collect()} == {(1, 11, 3, 4.0 / 3), (2, 1, 0, None)}


def test_orphans(spark):
    images = spark.createDataFrame([(1, T[0], None), (1, T[5], T[8]), (2, T[6], None), (None, T[0], None)], "id long, received_at timestamp, deleted_at timestamp")
    cats = spark.createDataFrame([(7, T[0], None)], "id long, received_at timestamp, deleted_at timestamp")
    ann = spark.createDataFrame(
        [(1, 1, 7, None, None, 0, T[4], 0), (1, 9, 9, None, None, 0, T[5], 0), (2, 2, 7, None, None, 0, T[3], 0), (3, 3, 8, None, None, 0, T[3], 0), (4, 1, None, None, None, 0, T[9], 0), (5, None, 7, None, None, 0, T[9], 0), (6, 1, 7, None, None, 0, T[8], 0)],
        ANN,
    )
    day = lambda k: T[k].date()
    # of one measured on the day its annotation came; orphaned by its annotation; of an unknown annotation and image; before its annotation came
    scale = spark.createDataFrame([(3, day(3), 1), (3, day(4), 9), (1, day(4), 1), (None, day(1), 1), (50, day(3), 9), (6, day(3), 1)], "annotation_id long, measured_on date, image_id long")
    found = referential.orphans(spark, ann, images, cats, scale)
    got = {(r.table_name, r.id, r.ref_table, r.reason, r.level) for r in found.collect()}
    assert got == {
        ("annotations", 2, "images", "late", 0), ("annotations", 3, "images", "missing", 0), ("annotations", 3, "categories", "missing", 0), ("annotations", 4, "images", "deleted", 0), ("annotations", 6, "images", "deleted", 0),
        ("annotations_scale", 3, "annotations", "inherited", 1), ("annotations_scale", 50, "annotations", "missing", 0), ("annotations_scale", 50, "images", "missing", 0), ("annotations_scale", 6, "annotations", "late", 0),
    }
    report = {(r.table_name, r.ref_table, r.month, r.reason): r.n for r in referential.orphan_report(found).collect()}
    assert report["annotations_scale", "annotations", "2025-01", "inherited"] == 1 and report["annotations", "images", "2025-01", "deleted"] == 2
    assert referential.orphans(spark, ann.limit(0), images, cats, scale.limit(0)).count() == 0
    assert referential.orphans(spark, ann, images.limit(0), cats, scale).where("table_name = 'annotations' and reason = 'missing'").count() == 6


def test_cascade_ends_on_cycles(spark):
    rows = {"a": spark.createDataFrame([(1, None, 8), (2, 1, None), (3, 2, None), (4, 9, None), (5, 5, 8), (6, 7, None), (7, 6, None)], "id long, up long, other long").withColumn("at", F.lit(T[1]))}
    refs = [referential.Reference("a", "up", "a"), referential.Reference("a", "other", "b")]
    history = {"b": spark.createDataFrame([(9, T[0], None)], "key long, first_seen timestamp, deleted_at timestamp")}
    found = referential.cascade(spark, rows, refs, history)
    assert {(r.id, r.level) for r in found["a"].collect()} == {(1, 0), (2, 1), (3, 2), (5, 0)}
    assert referential.cascade(spark, rows, refs, {})["a"].count() == 0


def test_running_sums(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(1000), i, r.randrange(3)) for i in range(3000)]
    got = running_sums(spark.createDataFrame(rows, "g string, o int, i int, v int"), ["g"], [F.col("o"), F.col("i")], {"n": F.lit(1), "s": F.col("v")}).collect()
    by = defaultdict(list)
    for g, o, i, v in rows:
        by[g].append((o, i, v))
    want = {}
    for g, x in by.items():
        s = 0
        for n, (_, i, v) in enumerate(sorted(x), 1):
            s += v
            want[i] = (n, s)
    got = {x.i: (x.n, x.s) for x in got if x.g is not None}
    assert got == {i: w for i, w in want.items() if i in got} and len(got) == sum(len(x) for g, x in by.items() if g is not None)
    assert running_sums(spark.createDataFrame([], "g string, o int"), ["g"], [F.col("o")], {"n": F.lit(1)}).count() == 0


def test_group_key_and_split(spark):
    names = ["sample_jpg.rf." + "a" * 32 + ".jpg", "dir/Sample_jpg.rf." + "B" * 32 + ".jpg", "other.png"]
    got = [x.g for x in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(prepare.source_group(F.col("n")).alias("g")).collect()]
    assert got == ["sample", "sample", "other.png"]
    images = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other-a"), (4, "other-b")], "image_id long, grp string")
    ann = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 3, 2)], "ann_id long, image_id long, category_id long")
    for order in ("hash", "mt"):
        s = {x.grp: x.split for x in prepare.group_split(images, ann, {"train": 0.5, "val": 0.25, "test": 0.25}, 42, order).collect()}
        assert set(s) == {"same", "other-a", "other-b"} and s["same"] == "train"
    many = spark.createDataFrame([(i, f"g{i}") for i in range(400)], "image_id long, grp string")
    split = [x.split for x in prepare.group_split(many, ann.limit(0)).collect()]
    assert len(split) == 400 and abs(split.count("train") / 400 - 0.75) < 0.03
    with pytest.raises(ValueError):
        prepare.group_split(many, ann, {"train": 0.5, "val": 0.2, "test": 0.2})


def test_tiles_equal_nested_loop(spark):
    r = random.Random(4)
    images = [(i, r.choice([300, 640, 641, 1280, 1999]), r.choice([100, 640, 1000])) for i in range(12)] + [(99, None, 5), (98, 0, 5)]
    boxes = [(k, r.randrange(13), 1, r.uniform(-50, 1900), r.uniform(-50, 900), r.uniform(1, 700), r.uniform(1, 700)) for k in range(150)]
    got_img = {(t.image_id, t.tx, t.ty) for t in tiling.tiles(spark.createDataFrame(images, "image_id long, width int, height int")).collect()}

    def pos(n):
        if n <= 640:
            return [0]
        x = list(range(0, n - 640 + 1, 512))
        return x if x[-1] == n - 640 else [*x, n - 640]

    want, seen = set(), set()
    for i, w, h in images[:12]:
        for ty in pos(h):
            for tx in pos(w):
                want.add((i, tx, ty))
                for k, j, _, x, y, bw, bh in boxes:
                    if j == i:
                        ix = min(x + bw, tx + min(640, w - tx)) - max(x, tx)
                        iy = min(y + bh, ty + min(640, h - ty)) - max(y, ty)
                        if ix > 0 and iy > 0 and ix * iy / (bw * bh) >= 0.3:
                            seen.add((i, tx, ty, k))
    df = spark.createDataFrame(images, "image_id long, width int, height int")
    ann = spark.createDataFrame(boxes, "ann_id long, image_id long, category_id long, x double, y double, w double, h double")
    assert got_img == want
    assert {(t.image_id, t.tx, t.ty, t.ann_id) for t in tiling.tile_annotations(df, ann).collect()} == seen
    sample = tiling.sampled_tiles(df, ann).collect()
    pos_n = len({s[:3] for s in seen})
    assert sum(t.positive for t in sample) == pos_n
    assert sum(not t.positive for t in sample) == min(len(want) - pos_n, -(-pos_n // 2))
    assert sorted(t.patch_id for t in sample) == list(range(1, len(sample) + 1))
    with pytest.raises(ValueError):
        tiling.stride_of(640, 1.0)


def test_violations(spark):
    images = spark.createDataFrame([(1, "a.jpg", 100, 100), (2, "a.jpg", 0, None), (3, "b.jpg", 50, 50)], "image_id long, file_name string, width int, height int")
    ann = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, -1.0, 0.0, 200.0, 0.0), (2, 9, 8, 0.0, 0.0, 1.0, 1.0)], "ann_id long, image_id long, category_id long, x double, y double, w double, h double")
    cats = spark.createDataFrame([(1, "x")], "id long, name string")
    listing = spark.createDataFrame([("a.jpg", 100, 100, "h1"), ("c.jpg", 1, 1, "h2")], "file_name string, width int, height int, sha256 string")
    v = quality.violations(images, ann, cats, listing)
    got = {(r.rule, r.entity_id) for r in v.collect()}
    assert {("file_missing", "3"), ("size_invalid", "2"), ("size_differs", "2"), ("content_repeated", "2"), ("file_name_repeated", "a.jpg"), ("annotation_id_repeated", "1"), ("image_unknown", "2"), ("category_unknown", "2"), ("box_empty", "1"), ("box_starts_outside", "1"), ("box_exceeds", "1")} == got
    assert not quality.passes(v) and quality.passes(v.limit(0), strict=True)


def test_histogram_and_early_stop(spark):
    s = spark.createDataFrame([(float(v),) for v in range(101)], "relative_area double")
    h = profile.histogram(s, bins=10, upper=0.99).orderBy("bin").collect()
    assert sum(x.n for x in h) == 101 and h[0].lo == 0.0 and h[-1].hi == pytest.approx(99.0)
    e = prepare.early_stop(spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 2.0, 2.0, 2.5, 1.0, 1.5, 1.2, 1.1])], "epoch long, val_loss double"), 3).orderBy("epoch").collect()
    assert [x.is_best for x in e] == [True, True, False, False, True, False, False, False]
    assert [x.stop for x in e] == [False] * 7 + [True]
