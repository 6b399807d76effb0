"""Detectors run over images as a partition-wise function, and their output brought to one form."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.boxes import num
from boxloom.plans.shared import small

RAW = "image_id bigint, label int, x1 double, y1 double, x2 double, y2 double, score double, seconds double"


def predict(images: DataFrame, load: Callable[[], Callable[[pd.DataFrame], list[list[tuple]]]]) -> DataFrame:
    """Raw detections of each image. load is called once a task and gives the model: frame to a list of
    (label, x1, y1, x2, y2, score) for each row. seconds: the model's time, spread over the rows of a batch. An image
    without any detection has one row with a null label, so that none is lost to the timing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            began = time.perf_counter()
            found = model(f)
            each = (time.perf_counter() - began) / max(len(f), 1)
            rows = [(i, *d, each) for i, ds in zip(f["image_id"], found, strict=True) for d in (ds or [(None,) * 6])]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])
            yield out.astype({"label": "Int32", **{c: "float64" for c in ("x1", "y1", "x2", "y2", "score", "seconds")}})

    return images.mapInPandas(run, RAW)


def normalised(raw: DataFrame, index: DataFrame, conf: float = 0.001, max_detections: int | None = 300, unknown: str = "drop") -> DataFrame:
    """(image_id, category_id, x, y, w, h, score) from conf on, the best max_detections of an image, labels as categories.

    index: (idx, category_id). A label that isn't in it is dropped, or with unknown raise an error.
    """
    from pyspark.sql import Window

    d = raw.where(F.col("label").isNotNull() & (F.col("score") >= num(conf)))
    if unknown == "raise":
        d = d.join(small(index.select(F.col("idx").alias("label"), "category_id")), "label", "left")
        bad = F.raise_error(F.concat(F.lit("unknown label "), F.col("label").cast("string")))
        d = d.withColumn("category_id", F.when(F.col("category_id").isNull(), bad.cast("bigint")).otherwise(F.col("category_id")))
    else:
        d = d.join(small(index.select(F.col("idx").alias("label"), "category_id")), "label")
    if max_detections is not None:
        w = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "x1", "y1", "x2", "y2", "label")
        d = d.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_detections)
    return d.select("image_id", "category_id", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), "score")


def stub_model() -> Callable[[pd.DataFrame], list[list[tuple]]]:
    """A deterministic stand-in: one box in the middle of each image, its label by the id."""
    return lambda f: [[(int(r.image_id % 3), r.width * 0.25, r.height * 0.25, r.width * 0.75, r.height * 0.75, 0.5)] for r in f.itertuples()]
