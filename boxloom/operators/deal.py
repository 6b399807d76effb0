"""Whole sets dealt to splits in given proportions: stratified by size band, systematically within each stratum.

One rule at every size. Strata go from the largest sets down; each gets as many sets for a split as that split still
lacks, by largest remainder, so what a few huge sets leave uneven is made up by the smaller ones. Within a stratum sets
are numbered in the order of a hash, and the numbers are dealt by a stride that visits every place once. Only the strata,
at most eight bands for each power of two and class, go through one task, as a sorted stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.plans.prefix import row_numbers
from boxloom.plans.shared import Scratch, small

MILLION = 1_000_000  # shares are taken in millionths
STRIDE = 618_034  # of a stratum of a million sets or more; golden ratio


def band(size: Column) -> Column:
    """Eight bands for each power of two, in whole numbers: sets of one band differ by an eighth at most."""
    size = size.cast("bigint")
    e = F.length(F.bin(size)) - 1
    return (e * 8 + F.floor(size * 8 / F.pow(F.lit(2.0), e)) - 8).cast("int")


def apportion(m: int, rows: int, want: list[int]) -> list[int]:
    """How many of m sets with so many rows together each split gets; want, in millionths of a row, is brought up to date."""
    lack = [max(w, 0) for w in want]
    whole = sum(lack)
    if not whole:
        lack, whole = [1] + [0] * (len(want) - 1), 1
    n = [m * w // whole for w in lack]
    order = sorted(range(len(want)), key=lambda i: (-(m * lack[i] % whole), i))
    for i in order[: m - sum(n)]:
        n[i] += 1
    for i, k in enumerate(n):
        want[i] -= MILLION * k * rows // m
    return n


def stride(m: int) -> int:
    g = max(1, STRIDE if m >= MILLION else m * 618 // 1000)
    while math.gcd(g, m) != 1:
        g += 1
    return g


def dealt(sets: DataFrame, key: str, size: str, strata: list[str], shares: dict[str, float], seed: int = 42) -> DataFrame:
    """(key, split) of every set. sets: key, size (rows of the set, at least 1) and the columns to stratify by after the
    band of the size. Keys are distinct; an empty table gives no rows."""
    names = list(shares)
    s = Scratch(sets.sparkSession, "deal")
    by = ["_band", *[f"_s{i}" for i in range(len(strata))]]
    slim = s.cut(sets.select(F.col(key).alias("_key"), F.col(size).cast("bigint").alias("_n"), band(F.col(size)).alias("_band"), *[F.col(c).alias(by[i + 1]) for i, c in enumerate(strata)]))
    total = slim.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    count = slim.groupBy(*by).agg(F.count("*").alias("_m"), F.sum("_n").alias("_rows")).repartition(1).sortWithinPartitions(F.desc("_band"), *by[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = [round(x * MILLION) * int(total) for x in shares.values()]
        for b in batches:
            out = []
            for m, rows in zip(b.column("_m").to_pylist(), b.column("_rows").to_pylist(), strict=True):
                n = apportion(m, rows, want)
                out.append([sum(n[: i + 1]) for i in range(len(n))])
            g = pa.array([stride(m) for m in b.column("_m").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in by], b.column("_m"), g, pa.array(out, pa.list_(pa.int64()))], [*by, "_m", "_g", "_upto"])

    kinds = ", ".join(f"{c} {t}" for c, t in count.select(*by).dtypes)
    plan = s.cut(count.mapInArrow(run, f"{kinds}, _m bigint, _g bigint, _upto array<bigint>"))
    rank = row_numbers(slim.select("_key", *by).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_key").cast("string")))), by, [F.col("_h"), F.col("_key")], "_r")
    on = [rank[c].eqNullSafe(plan[c]) for c in by]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    spot = F.pmod((F.col("_r") - 1) * F.col("_g"), F.col("_m"))
    to = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        to = F.when(spot < F.element_at("_upto", i + 1), names[i]).otherwise(to)
    return rank.join(small(plan), cond).select(F.col("_key").alias(key), to.alias("split"))


def sql(groups: str, key: str, size: str, stratum: str, shares: dict[str, int], seed: int = 42) -> str:
    """CTEs that end with dealt(key, split), for the SQL that checks. groups: name of a CTE with key, size and stratum."""
    a, b, c = (f"{x}::hugeint" for x in shares.values())
    return f"""banded as (select {key} as k, {size}::bigint as n, {stratum} as st, ((length(bin({size}::bigint)) - 1) * 8 + ({size}::bigint * 8) // (1::bigint << (length(bin({size}::bigint)) - 1)) - 8)::int as band from {groups}),
strata as (select *, row_number() over (order by band desc, st) as o from (select band, st, count(*) as m, sum(n) as t from banded group by 1, 2)),
walk as (select 0::bigint as o, {a} * total as wa, {b} * total as wb, {c} * total as wc, 0::hugeint as na, 0::hugeint as nb, 0::hugeint as nc from (select coalesce(sum(n), 0)::hugeint as total from banded)
  union all
  select o, wa - 1000000 * na * t // m, wb - 1000000 * nb * t // m, wc - 1000000 * nc * t // m, na, nb, nc from (
    select *, fa + (ra <= left_)::int as na, fb + (rb <= left_)::int as nb, fc + (rc <= left_)::int as nc from (
      select *, m - fa - fb - fc as left_,
        1 + (qb > qa)::int + (qc > qa)::int as ra, 1 + (qa >= qb)::int + (qc > qb)::int as rb, 1 + (qa >= qc)::int + (qb >= qc)::int as rc from (
        select *, m * la // w as fa, m * lb // w as fb, m * lc // w as fc, m * la % w as qa, m * lb % w as qb, m * lc % w as qc from (
          select s.o, s.m::hugeint as m, s.t::hugeint as t, wa, wb, wc, case when ga + gb + gc = 0 then 1 else ga end as la, gb as lb, gc as lc, case when ga + gb + gc = 0 then 1 else ga + gb + gc end as w
          from (select *, greatest(wa, 0) as ga, greatest(wb, 0) as gb, greatest(wc, 0) as gc from walk) x join strata s on s.o = x.o + 1))))),
placed as (select b.k, s.m, s.o, row_number() over (partition by b.band, b.st order by md5('{seed}:' || b.k::varchar), b.k) - 1 as r from banded b join strata s on s.band = b.band and s.st = b.st),
strides as (select o, list_filter(range(greatest(1, case when m >= 1000000 then 618034 else m * 618 // 1000 end), greatest(1, m * 618 // 1000) + 1000), lambda g: gcd(g, m) = 1)[1] as g from strata),
dealt as (select p.k as {key}, case when (p.r * g) % p.m < na then '{list(shares)[0]}' when (p.r * g) % p.m < na + nb then '{list(shares)[1]}' else '{list(shares)[2]}' end as split from placed p join walk using (o) join strides using (o))"""
