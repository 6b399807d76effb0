from pyspark.sql import functions as F

from boxloom.functions import boxes as B


def _one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def _box(x, y, w, h):
    return tuple(F.lit(float(v)) for v in (x, y, w, h))


def test_iou_and_area(spark):
    r = _one(spark, a=B.iou(_box(0, 0, 10, 10), _box(5, 5, 10, 10)), b=B.iou(_box(0, 0, 0, 0), _box(0, 0, 0, 0)), c=B.relative_area(F.lit(10.0), F.lit(5.0), F.lit(100), F.lit(100)), d=B.relative_area(F.lit(-1.0), F.lit(5.0), F.lit(100), F.lit(100)), e=B.relative_area(F.lit(1.0), F.lit(5.0), F.lit(0), F.lit(100)))
    assert (r.a, r.b, r.c, r.d, r.e) == (25 / 175, 0.0, 0.005, 0.0, 0.0)


def test_size_bins_are_strict(spark):
    r = _one(spark, **{n: B.size_bin(F.lit(v)) for n, v in {"a": 0.005, "b": 0.01, "c": 0.02, "d": 0.05, "e": 0.1}.items()})
    assert tuple(r) == ("small", "medium", "medium", "large", "large")


def test_intersection_touching_is_empty(spark):
    r = _one(spark, a=B.intersection(_box(0, 0, 10, 10), _box(10, 0, 5, 5)), b=B.intersection(_box(-5, -5, 10, 10), _box(0, 0, 8, 8)))
    assert r.a is None and tuple(r.b) == (0.0, 0.0, 5.0, 5.0)


def test_fixed8_rounds_binary_value_half_even(spark):
    import random

    r = random.Random(1)
    near = [round(r.random() * 3, 9) for _ in range(3000)] + [k / 2**r.randrange(1, 30) for k in range(1, 2000)] + [-0.3, 7.0, 12345.678901234]
    values = [*near, 0.5, 1 / 3, 2 / 3, 0.000000005, 0.123456785, 1e-9, 0.29296875, 0.999999995]
    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(B.fixed8(F.col("v")).alias("s")).collect()]
    assert got == [f"{v:.8f}" for v in values]


def test_valid_box_never_null(spark):
    rows = [([1.0, 2.0, 3.0, 4.0],), ([1.0, 2.0, 3.0],), (None,), ([1.0, 2.0, float("nan"), 4.0],), ([1.0, float("inf"), 3.0, 4.0],), ([1.0, 2.0, 0.0, 4.0],), ([1.0, 2.0, None, 4.0],), ([],), ([1.0, 2.0, 3.0, 4.0, 5.0],)]
    got = [r.v for r in spark.createDataFrame(rows, "b array<double>").select(B.valid_box(F.col("b")).alias("v")).collect()]
    assert got == [True] + [False] * 8
