"""Global order without a single task: exact quantiles and row numbers."""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import written

#: Distinct values up to which they are counted outright, and buckets of a round.
FETCH, BUCKETS = 10_000, 4096


def _nth(values: DataFrame, k: int, lo: float, hi: float, below: int) -> float:
    """The k-th smallest (from 0) value; all values lie in [lo, hi] and ``below`` more lie under lo."""
    while lo < hi:
        width = (hi - lo) / BUCKETS
        inside = values.where((F.col("v") >= lo) & (F.col("v") <= hi))
        bucket = F.least(F.floor((F.col("v") - lo) / width), F.lit(BUCKETS - 1))
        rows = inside.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        for r in rows:  # at most BUCKETS rows
            if below + r["n"] > k:
                lo, hi = r["lo"], r["hi"]
                break
            below += r["n"]
        else:
            raise ValueError("k lies beyond the values")
    return lo


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """The linearly interpolated ``q`` quantile of the non-null values, None if there are none.

    Each round aggregates the surviving range into a bounded histogram and narrows it to the bucket that holds the
    wanted rank, so no task ever sees more than its share; a few rounds settle doubles of any spread.
    """
    values = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n, lo, hi, kinds = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v"), F.approx_count_distinct("v")).head()
    if not n:
        return None
    at = (n - 1) * q
    if kinds <= FETCH:  # few distinct values (days, say): their counts settle it in one more pass
        rows = sorted(map(tuple, values.groupBy("v").agg(F.count(F.lit(1))).limit(4 * FETCH).collect()))
        if sum(c for _, c in rows) == n:
            ends = list(accumulate(c for _, c in rows))
            a, b = (rows[bisect_right(ends, k)][0] for k in (math.floor(at), math.ceil(at)))
            return a + (b - a) * (at - math.floor(at))
    k = math.floor(at)
    a = _nth(values, k, lo, hi, 0)
    if at == k:
        return a
    more = values.where(F.col("v") <= a).count()
    b = a if more > k + 1 else values.where(F.col("v") > a).agg(F.min("v")).head()[0]
    return a + (b - a) * (at - k)


def row_numbers(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with 1-based row numbers in ``order`` (which must settle all ties): range partitions are numbered locally
    and shifted by the sizes of those before them, one row per partition."""
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mono", F.monotonically_increasing_id())
    placed = written(placed, "ranked")
    part, local = F.shiftright("__mono", 33), F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    shifts, total = [], 0
    for r in sizes:
        shifts.append((r["__part"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(shifts or [(0, 0)], "__part bigint, __shift bigint"))
    return placed.withColumn("__part", part).join(offsets, "__part").withColumn(name, local + F.col("__shift") + 1).drop("__part", "__shift", "__mono")
