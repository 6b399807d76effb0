"""Queries over all rows of their tables, against the rule written anew."""

import math
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boxloom import catalog
from boxloom.operators import prepare
from boxloom.sources import current


def stops(rows, patience):
    """(epoch, val_loss, best, is_best, stale, stop) of (epoch, val_loss), one epoch after the other."""
    out, best, at, stop = [], None, None, False
    for epoch, loss in sorted(rows):
        is_best = best is None or loss is None or loss < best
        at = epoch if is_best else at
        best = loss if best is None or (loss is not None and loss < best) else best
        stop = stop or epoch - at >= patience
        out.append((epoch, loss, best, is_best, epoch - at, stop))
    return out


@pytest.mark.parametrize("kind", ["random", "falling", "never", "nulls"])
def test_early_stop_over_ranges(spark, kind):
    r = random.Random(kind)
    make = {"random": lambda i: round(r.expovariate(1) * 100, 1), "falling": lambda i: float(4000 - i // 3), "never": lambda i: float(-i), "nulls": lambda i: None if i < 3 or r.random() < 0.02 else float(r.randrange(50))}[kind]
    rows = [(2 * i + 5, make(i)) for i in range(3000)]
    r.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        got = prepare.early_stop(spark.createDataFrame(rows, "epoch long, val_loss double").repartition(5), 9).orderBy("epoch").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(x) for x in got] == stops(rows, 9)


def test_early_stop_takes_all_events(spark, data):
    rows = [(x.event_id, x.v) for x in spark.read.parquet(f"{data}/events.parquet").selectExpr("event_id", "round(value, 3) v").collect()]
    got = catalog.QUERIES["early_stop"](spark, data).orderBy("epoch").collect()
    assert len(got) == len(rows) > 201
    assert [tuple(x) for x in got] == stops(rows, 5)


def breaches(images, annotations, categories):
    """(rule, entity_id, detail) of the rules on annotations, row by row; images: id to (width, height)."""
    out, seen = Counter(), Counter()
    for ident, image, category, box in annotations:
        x, y, w, h = [*(box or []), None, None, None, None][:4]
        seen[ident] += 1
        if seen[ident] > 1:
            out["annotation_id_repeated", str(ident), str(seen[ident])] += 1
        if image not in images:
            out["image_unknown", str(ident), None if image is None else str(image)] += 1
        if category not in categories:
            out["category_unknown", str(ident), None if category is None else str(category)] += 1
        if any(v is None or v <= 0 for v in (w, h)):
            out["box_empty", str(ident), None] += 1
        if any(v is not None and v < 0 for v in (x, y)):
            out["box_starts_outside", str(ident), None] += 1
        # a number that is none is above all others, as in SQL
        if any(a is not None and b is not None and size is not None and (math.isnan(a + b) or a + b > size) for a, b, size in zip((x, y), (w, h), images.get(image, (None, None)), strict=True)):
            out["box_exceeds", str(ident), None] += 1
    return out


def test_violations_check_every_row(spark, data):
    images = {r.image_id: (r.width, r.height) for r in current.images(spark, data).collect()}
    categories = {r.category_id for r in current.categories(spark, data).collect()}
    raw = [(r.id, r.image_id, r.category_id, r.bbox) for r in spark.read.parquet(f"{data}/annotations.parquet").collect()]
    want = breaches(images, raw, categories)
    got = catalog.QUERIES["violations"](spark, data).where("entity = 'annotation'").collect()
    assert Counter((r.rule, r.entity_id, r.detail) for r in got) == want
    counts = {r.rule: r.n for r in catalog.QUERIES["violation_counts"](spark, data).collect()}
    by = Counter()
    for (rule, _, _), n in want.items():
        by[rule] += n
    assert {k: v for k, v in counts.items() if k not in ("size_invalid", "file_name_repeated")} == by


def test_violations_of_superseded_rows(spark, tmp_path):
    at = [datetime(2025, 1, k) for k in (1, 2, 3)]
    images = "id long, file_name string, width int, height int, source_file_name string, source_split string, source_group string, received_at timestamp, deleted_at timestamp"
    tables = {
        "images": ([(1, "a.jpg", 100, 100, "a", "train", "g", at[0], None)], images),
        "categories": ([(1, "x", at[0], None)], "id long, name string, received_at timestamp, deleted_at timestamp"),
        "annotations": ([(5, 1, 1, None, at[0]), (5, 9, 1, [-1.0, 0.0, 5.0, 5.0], at[1]), (5, 1, 1, [0.0, 0.0, 500.0, 5.0], at[2])], "id long, image_id long, category_id long, bbox array<double>, received_at timestamp"),
    }
    for name, (rows, schema) in tables.items():
        extra = {"area": F.lit(None).cast("double"), "iscrowd": F.lit(0)} if name == "annotations" else {}
        spark.createDataFrame(rows, schema).withColumns(extra).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted((r.rule, r.entity_id, r.detail or "") for r in catalog.QUERIES["violations"](spark, str(tmp_path)).collect())
    assert got == [("annotation_id_repeated", "5", "2"), ("annotation_id_repeated", "5", "3"), ("box_empty", "5", ""), ("box_exceeds", "5", ""), ("box_starts_outside", "5", ""), ("image_unknown", "5", "9")]


def test_split_of_groups(spark):
    """Every group has one split; images and each class come out in the ratios, whatever the sizes of the groups."""
    r = random.Random(8)
    images = [(i, f"g{min(int(r.expovariate(0.003)), 1500)}") for i in range(6000)] + [(i, "hot") for i in range(6000, 9000)]
    ann = [(k, r.randrange(9000), r.choice([1, 1, 1, 2, 2, 3, 4])) for k in range(20000)]
    of = dict(images)
    a, b = spark.createDataFrame(images, "image_id long, grp string").repartition(5), spark.createDataFrame(ann, "ann_id long, image_id long, category_id long")
    got = {x.grp: x.split for x in prepare.group_split(a, b).collect()}
    assert set(got) == set(of.values()) and {x.grp: x.split for x in prepare.group_split(a.repartition(3), b).collect()} == got
    n = Counter(got[g] for _, g in images)
    per = {c: Counter(got[of[i]] for _, i, k in ann if k == c) for c in (1, 2, 3, 4)}
    for split, share in prepare.RATIOS.items():
        assert abs(n[split] / len(images) - share) < 0.01
        assert all(abs(v[split] / sum(v.values()) - share) < 0.08 for v in per.values())
    assert prepare.group_split(a.limit(0), b).count() == 0


def test_seeded_order_is_bounded(spark):
    images = [(i, f"g{i % 40}") for i in range(300)]
    a, b = spark.createDataFrame(images, "image_id long, grp string"), spark.createDataFrame([(1, 5, 2)], "ann_id long, image_id long, category_id long")
    groups = [(f"g{k}", sum(1 for i, g in images if g == f"g{k}"), k, {2: 1} if k == 5 else {}) for k in range(40)]
    assert {tuple(x) for x in prepare.group_split(a, b, order="mt").collect()} == set(prepare.least_full(groups))
    with pytest.raises(ValueError):
        prepare.group_split(a, b, order="mt", fold=20)


def test_apportionment_adds_up():
    from boxloom.operators import deal

    r = random.Random(1)
    for _ in range(300):
        want = [r.randrange(-5, 10**9) for _ in range(3)]
        m = r.randrange(1, 10**6)
        n = deal.apportion(m, m * r.randrange(1, 50), want)
        assert sum(n) == m and min(n) >= 0 and math.gcd(deal.stride(m), m) == 1
