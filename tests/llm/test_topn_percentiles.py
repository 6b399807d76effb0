import math
import random
from collections import defaultdict
from datetime import date, datetime

import numpy as np
from pyspark.sql import functions as F

from boxloom.llm import percentiles, topn


def test_top_n_of_hot_and_small_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None, "c"]), r.randrange(50) / 50, i, "x") for i in range(20000)]
    df = spark.createDataFrame(rows, "g string, s double, id long, new string").repartition(6)
    got = defaultdict(list)
    for x in topn.top_n(df, ["g"], [F.col("s").desc(), F.col("id")], 7).collect():
        got[x.g].append((-x.s, x.id))
    want = defaultdict(list)
    for g, s, i, _ in rows:
        want[g].append((-s, i))
    assert {g: sorted(v) for g, v in got.items()} == {g: sorted(v)[:7] for g, v in want.items()}
    assert topn.top_n(df.limit(0), ["g"], [F.col("id")], 3).count() == 0


def test_detections_count_by_their_latest_row(spark):
    t = [datetime(2025, 1, d) for d in (1, 2)]
    rows = [(1, 5, 0.9, t[0]), (1, 5, 0.1, t[1]), (2, 5, 0.5, t[0]), (3, 5, float("nan"), t[0]), (4, 5, 1.5, t[0]), (5, 5, None, t[0]), (6, None, 0.9, t[0]), (7, 5, 0.5, t[0]), (8, 6, 1.0, t[0]), (9, 5, -0.1, t[0]), (None, 5, 0.99, t[0]), (10, 6, float("inf"), t[0]), (11, 6, 0.0, t[0])]
    df = spark.createDataFrame(rows + rows, "det_id long, image_id long, score double, received_at timestamp")
    assert {(x.image_id, x.det_id) for x in topn.top_detections(df, 2).collect()} == {(5, 2), (5, 7), (6, 8), (6, 11)}


def test_sketch_within_bound():
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=200_000), rng.integers(0, 10, 150_000).astype(float), np.sort(rng.random(100_000))):
        s = percentiles.Sketch(1, 512)
        for part in np.array_split(values, 37):
            s.add(part)
        assert sum(len(x) << h for h, x in enumerate(s.levels)) == s.n == len(values)
        assert sum(map(len, s.levels)) < 4 * 512
        true = np.sort(values)
        for p, q in zip(percentiles.PROBS, s.quantiles(percentiles.PROBS), strict=True):
            lo, hi = np.searchsorted(true, q, "left") / s.n, np.searchsorted(true, q, "right") / s.n
            assert lo - s.rank_error() - 1 / s.n <= p <= hi + s.rank_error() + 1 / s.n


def test_merged_sketches():
    rng = np.random.default_rng(6)
    values = rng.exponential(size=300_000)
    whole = percentiles.Sketch(0, 512)
    for k, part in enumerate(np.array_split(values, 100)):
        s = percentiles.Sketch(k, 512)
        s.add(part)
        n, sq, lo, hi, sizes, items = s.state()
        whole.merge(n, sq, lo, hi, np.array(sizes), items)
    assert whole.n == len(values) and sum(len(x) << h for h, x in enumerate(whole.levels)) == whole.n and whole.rank_error() < 0.02
    assert (whole.lo, whole.hi) == (values.min(), values.max())


def test_class_percentiles(spark):
    r = random.Random(2)
    rows, want = [], defaultdict(list)
    for i in range(30000):
        v = r.choice([r.random() ** 3] * 8 + [None, float("nan"), float("inf"), -0.1, 7.0, 0.0, 1.0])
        c = r.choice(["Rust", " rust ", "RUST\t", "dent", None, "", "  "])
        rows.append((c, v, r.choice([date(2025, 1, 1), date(2025, 1, 2), None]), "z"))
        if v is not None and 0 <= v <= 1 and c and c.strip():
            want[c.strip().lower()].append(v)
    df = spark.createDataFrame(rows, "class string, relative_area double, measured_on date, grp string").repartition(5)
    got = {x["class"]: x for x in percentiles.class_percentiles(df, 256).collect()}
    assert set(got) == {"rust", "dent"}
    for c, v in want.items():
        v = np.sort(v)
        assert got[c].n == len(v) and 0 < got[c].rank_error < 0.1
        for p, name in ((0.01, "p01"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"), (0.99, "p99")):
            at = np.searchsorted(v, got[c][name], "left") / len(v), np.searchsorted(v, got[c][name], "right") / len(v)
            assert at[0] - got[c].rank_error - 0.001 <= p <= at[1] + got[c].rank_error + 0.001
    assert percentiles.class_percentiles(df.limit(0)).count() == 0
    few = {x["class"]: x for x in percentiles.class_percentiles(df.limit(40)).collect()}
    assert all(x.rank_error == 0 and not math.isnan(x.p50) for x in few.values())
