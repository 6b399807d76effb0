"""Running sums over an order of all rows of a group, without one task for a group.

A window ordered within a group runs in one task for each group, which a few large classes make a bottleneck. Here the
rows are partitioned by sampled quantiles of group and order, summed up within the partitions as they stream by, and
the partitions' totals, one row for each group and partition, are summed up to give each its offset.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.plans.shared import Scratch, bounded

OFFSETS = 200_000  # rows of offsets that are broadcast; with more the join is by shuffle


def _local(groups: int, values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, np.zeros(values, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for c in b.columns[:groups]:
                a, z = c.slice(1), c.slice(0, len(c) - 1)
                new[1:] |= pc.fill_null(pc.not_equal(a, z), pc.xor(pc.is_null(a), pc.is_null(z))).to_numpy(zero_copy_only=False)
            head = [c[0].as_py() for c in b.columns[:groups]]
            new[0] = head != last
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            keep, cols = b.num_columns - values, []
            for k in range(values):
                v = b.column(keep + k).to_numpy(zero_copy_only=False).astype(np.int64)
                s = np.cumsum(v)
                s = s - (s - v)[first]
                if not new[0]:
                    s[first == 0] += carry[k]
                carry[k] = s[-1]
                cols.append(pa.array(s))
            last = [c[-1].as_py() for c in b.columns[:groups]]
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], *cols], b.schema.names)

    return run


def running_sums(df: DataFrame, groups: Sequence[str], order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """df with a bigint column for each of values: its sum over the rows of the group up to and with this one.

    values are not negative. order must be total within a group, or rows that tie have no defined order. An empty table
    stays empty. The partitioned rows are written to the shared folder, so that both passes see the same partitions.
    """
    s = Scratch(df.sparkSession, "prefix")
    rest = [c for c in df.columns if c not in groups]
    slim = df.select(*groups, *rest, *[v.cast("bigint").alias(n) for n, v in values.items()])
    by = [F.col(g) for g in groups] + list(order)
    ranged = slim.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    local = s.cut(ranged.mapInArrow(_local(len(groups), len(values)), schema).withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy(*groups, "_pid").agg(*[F.max(n).alias(n) for n in values])
    before = s.cut(totals.select(*groups, "_pid", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_b_{n}") for n in values]))
    j = local.join(F.broadcast(before) if bounded(before, OFFSETS) else before, [*groups, "_pid"])
    return j.select(*groups, *rest, *[(F.col(n) + F.col(f"_b_{n}")).alias(n) for n in values])


def row_numbers(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df with name: the row's place in its group from 1 on, as running_sums has it of ones, but without leaving the JVM.

    order must be total within a group, or rows that tie have no defined order. An empty table stays empty.
    """
    s = Scratch(df.sparkSession, "rows")
    by = [F.col(g) for g in groups] + list(order)
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # of the row in its partition
    local = s.cut(ranged.select("*", F.spark_partition_id().alias("_pid"), place.alias("_i")))
    w = Window.partitionBy(*groups, F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    counts = local.groupBy(*groups, "_pid").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = s.cut(counts.select(*groups, "_pid", (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first") + 1).alias("_add")))
    right = F.broadcast(before) if bounded(before, OFFSETS) else before
    right = right.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_pid").alias("_rpid"), "_add")
    on = local["_pid"] == right["_rpid"]
    for i, g in enumerate(groups):
        on = on & local[g].eqNullSafe(right[f"_g{i}"])
    return local.join(right, on).select(*df.columns, (F.col("_i") + F.col("_add")).alias(name))
