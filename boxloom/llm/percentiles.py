"""Percentiles with a bounded error from mergeable sketches: randomized compactor hierarchies.

A sketch is a list of levels; an item on level h stands for 2**h values. A level that holds too many items is sorted
and every other one, from a random start, moves up a level. One such compaction changes the rank of any value by at
most 2**h, with mean zero, however many items it sorts. A sketch carries the sum of the squares 4**h of its compactions,
so its error bound is that of its own history (Hoeffding), not a worst case.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.plans.shared import table

K = 2048  # items of the top level; lower ones hold geometrically fewer
DELTA = 0.001  # the error bound holds with probability 1 - DELTA for each percentile
PROBS = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)


class Sketch:
    def __init__(self, seed: int, k: int = K) -> None:
        self.k, self.n, self.squares, self.levels = k, 0, 0.0, [np.empty(0)]
        self.lo, self.hi = math.inf, -math.inf
        self.rng = np.random.Generator(np.random.Philox(seed & 0xFFFFFFFF))

    def room(self, h: int) -> int:
        return max(8, math.ceil(self.k * (2 / 3) ** (len(self.levels) - 1 - h)))

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.n += len(values)
            self.lo, self.hi = min(self.lo, float(values.min())), max(self.hi, float(values.max()))
            self.levels[0] = np.concatenate([self.levels[0], values])
            self._compact()

    def merge(self, n: int, squares: float, lo: float, hi: float, sizes: np.ndarray, items: np.ndarray) -> None:
        if not n:
            return
        self.n, self.squares = self.n + int(n), self.squares + squares
        self.lo, self.hi = min(self.lo, lo), max(self.hi, hi)
        at = 0
        for h, size in enumerate(sizes):
            if h == len(self.levels):
                self.levels.append(np.empty(0))
            self.levels[h] = np.concatenate([self.levels[h], items[at : at + size]])
            at += size
        self._compact()

    def _compact(self) -> None:
        h = 0
        while h < len(self.levels):
            if len(self.levels[h]) > self.room(h):
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                a = np.sort(self.levels[h])
                left = a[:0]
                if len(a) % 2:  # an item without a partner stays
                    left, a = (a[:1], a[1:]) if self.rng.integers(2) else (a[-1:], a[:-1])
                up = a[int(self.rng.integers(2)) :: 2]
                self.levels[h], self.levels[h + 1] = left, np.concatenate([self.levels[h + 1], up])
                self.squares += 4.0**h
            h += 1

    def state(self) -> tuple:
        return self.n, self.squares, self.lo, self.hi, [len(x) for x in self.levels], np.concatenate(self.levels)

    def quantiles(self, probs: tuple[float, ...]) -> list[float]:
        """Of each p the smallest item whose weighted rank reaches p * n."""
        items = np.concatenate(self.levels)
        weight = np.concatenate([np.full(len(x), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        o = np.argsort(items, kind="stable")
        rank = np.cumsum(weight[o])
        at = np.searchsorted(rank, np.maximum(1, np.ceil(np.array(probs) * self.n - 1e-9)))
        return [float(items[o[min(i, len(o) - 1)]]) for i in at]

    def rank_error(self, delta: float = DELTA) -> float:
        """Bound on the error of a rank, as a share of n."""
        return math.sqrt(2 * math.log(2 / delta) * self.squares) / max(self.n, 1)


STATE = "grp string, part string, slot int, n bigint, squares double, lo double, hi double, sizes array<int>, items array<double>"
_FIELDS = [("grp", pa.string()), ("part", pa.string()), ("slot", pa.int32()), ("n", pa.int64()), ("squares", pa.float64()), ("lo", pa.float64()), ("hi", pa.float64()), ("sizes", pa.list_(pa.int32())), ("items", pa.list_(pa.float64()))]
SLOTS = 16


def _rows(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*done, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def _build(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sketches of each (grp, part) that the partition holds, in memory bounded by BUSY sketches."""
        busy, open_, pid = 4096, {}, 0

        def close() -> pa.RecordBatch:
            out = _rows([(g, p, pid % SLOTS, *s.state()) for (g, p), s in sorted(open_.items())])
            open_.clear()
            return out

        for b in batches:
            if not b.num_rows:
                continue
            pid = b.column(3)[0].as_py()
            f = pd.DataFrame({"g": b.column(0).to_pandas(), "p": b.column(1).to_pandas(), "v": b.column(2).to_pandas()})
            for (g, p), v in f.groupby(["g", "p"], sort=True)["v"]:
                if (g, p) not in open_:
                    open_[g, p] = Sketch(zlib.crc32(f"{g}|{p}|{pid}".encode()), k)
                open_[g, p].add(v.to_numpy(np.float64))
            if len(open_) > busy:
                yield close()
        if open_:
            yield close()

    return run


def _merge(width: int, k: int):
    """Merges the sorted states of equal keys (grp; grp and part; or these and slot), one open sketch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, s = None, None
        out = lambda: _rows([(key[0], key[1], key[2], *s.state())])
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            n, sq, lo, hi = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7))
            for i, full in enumerate(keys):
                cut = (*full[:width], *("", "", 0)[width:])
                if cut != key:
                    if s is not None:
                        yield out()
                    key, s = cut, Sketch(zlib.crc32(repr(cut).encode()), k)
                s.merge(n[i], float(sq[i]), float(lo[i]), float(hi[i]), b.column(7)[i].values.to_numpy(), b.column(8)[i].values.to_numpy())
        if s is not None:
            yield out()

    return run


def sketches(df: DataFrame, group: Column, part: Column, value: Column, k: int = K) -> DataFrame:
    """A mergeable sketch of value for each (group, part): the table to keep, for instance a part for each day.

    Sketches are built where the rows lie, without a shuffle; then merged levelwise, first SLOTS ways, so that no task
    merges all sketches of a part that holds most of the rows. Nulls in group or part are left out.
    """
    slim = df.select(group.alias("grp"), part.alias("part"), value.cast("double").alias("v"), F.spark_partition_id().alias("pid")).where("grp is not null and part is not null and v is not null")
    built = slim.mapInArrow(_build(k), STATE)
    for width, keys in ((3, ["grp", "part", "slot"]), (2, ["grp", "part"])):
        built = built.repartition(*keys).sortWithinPartitions(*keys, "slot", "n", "lo", "hi", "squares").mapInArrow(_merge(width, k), STATE)
    return built


def combined(parts: DataFrame, k: int = K) -> DataFrame:
    """One sketch a group from those of its parts, whichever parts are given."""
    return parts.repartition("grp").sortWithinPartitions("grp", "part", "slot").mapInArrow(_merge(1, k), STATE)


def read_out(states: DataFrame, probs: tuple[float, ...] = PROBS, k: int = K) -> DataFrame:
    """(grp, n, one column for each percentile, rank_error) of each sketch."""
    names = [f"p{round(p * 100):02d}" for p in probs]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                s = Sketch(0, k)
                s.n, s.squares, at, s.levels = int(r.n), float(r.squares), 0, []
                for size in r.sizes:
                    s.levels.append(np.asarray(r.items[at : at + size], float))
                    at += size
                rows.append((r.grp, s.n, *s.quantiles(probs), s.rank_error()))
            yield pd.DataFrame(rows, columns=["grp", "n", *names, "rank_error"])

    return states.mapInPandas(run, "grp string, n bigint, " + ", ".join(f"{n} double" for n in names) + ", rank_error double")


def class_percentiles(scale: DataFrame, k: int = K) -> DataFrame:
    """Percentiles of relative_area for each class, case and outer blanks of its name disregarded.

    Every row counts whose value lies from 0 to 1, repeated rows as often as they stand there. A null or blank class is
    no class; measured_on null is a part of its own. rank_error: the share of the rows by which the rank of a value
    given may be off, exceeded with a probability of at most DELTA; 0 where no compaction took place.
    """
    name = F.nullif(F.lower(F.regexp_replace("class", r"^\s+|\s+$", "")), F.lit(""))
    day = F.coalesce(F.col("measured_on").cast("string"), F.lit("none"))
    inside = scale.where("relative_area >= 0.0D and relative_area <= 1.0D")  # not for NaN, which Spark takes as greatest
    return read_out(combined(sketches(inside, name, day, F.col("relative_area"), k), k), k=k).withColumnRenamed("grp", "class")


def p4_percentiles(spark, sf_dir: str) -> DataFrame:
    return class_percentiles(table(spark, sf_dir, "annotations_scale"))


SQL: dict[str, str] = {}
QUERIES = {"p4_percentiles": p4_percentiles}
