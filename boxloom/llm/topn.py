"""The N best rows of every group by secondary sort, in constant memory however large a group is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.plans.shared import table


def _first_n(n: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the first n rows of each run of equal values in the first width columns of a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        seen = 0  # rows of the open run in earlier batches
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for c in b.columns[:width]:
                a, z = c.slice(1), c.slice(0, len(c) - 1)
                differs = pc.fill_null(pc.not_equal(a, z), pc.xor(pc.is_null(a), pc.is_null(z)))
                new[1:] |= differs.to_numpy(zero_copy_only=False)
            head = [c[0].as_py() for c in b.columns[:width]]
            new[0] = head != last
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            rank = np.arange(len(new)) - start
            if not new[0]:
                rank[start == 0] += seen
            last, seen = [c[-1].as_py() for c in b.columns[:width]], int(rank[-1]) + 1
            keep = rank < n
            if keep.any():
                yield b.filter(pa.array(keep))

    return run


def top_n(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group under order, which must be total for a result that never varies.

    Two passes of the same stream. The first runs within the partitions as they lie and leaves at most n rows of a
    group in each, so a group that holds a third of all rows is cut down where it lies, and only those rows are
    shuffled by group. Null is a group like any other; leave such rows out before if they are none. Of groups smaller
    than n all rows come out; an empty table gives none.
    """
    rest = [c for c in df.columns if c not in groups]
    df = df.select(*groups, *rest)
    by = [F.col(g) for g in groups] + order
    cut = _first_n(n, len(groups))
    near = df.sortWithinPartitions(*by).mapInArrow(cut, df.schema)
    return near.repartition(*groups).sortWithinPartitions(*by).mapInArrow(cut, df.schema)


def valid_detections(predictions: DataFrame) -> DataFrame:
    """The latest row of each det_id, if its score is a number from 0 to 1 and its image_id is not null.

    Of rows received together the one with the greater score, then the greater image_id counts.
    """
    v = F.max(F.struct("received_at", "score", "image_id"))
    latest = predictions.where("det_id is not null").groupBy("det_id").agg(v.alias("v")).select("v.image_id", "det_id", "v.score")
    # NaN is greater than any number in Spark, so the upper bound excludes it
    return latest.where("image_id is not null and score >= 0.0D and score <= 1.0D")


def top_detections(predictions: DataFrame, n: int = 5) -> DataFrame:
    """The n best detections of every image: highest score first, equal scores by the smaller det_id."""
    return top_n(valid_detections(predictions), ["image_id"], [F.col("score").desc(), F.col("det_id")], n)


def p3_found(spark, sf_dir: str) -> DataFrame:
    return top_detections(table(spark, sf_dir, "predictions")).select("image_id", "det_id")


def p3_top5(spark, sf_dir: str) -> DataFrame:
    return top_detections(table(spark, sf_dir, "predictions")).select("image_id", "det_id", "score")


_TOP = """with latest as (select * from predictions where det_id is not null
  qualify row_number() over (partition by det_id order by received_at desc, score desc nulls last, image_id desc nulls last) = 1),
ranked as (select image_id, det_id, score, row_number() over (partition by image_id order by score desc, det_id) as rn
  from latest where image_id is not null and score between 0 and 1 and not isnan(score))
"""
SQL = {"p3_found": _TOP + "select image_id, det_id from ranked where rn <= 5", "p3_top5": _TOP + "select image_id, det_id, score from ranked where rn <= 5"}
QUERIES = {"p3_found": p3_found, "p3_top5": p3_top5}
