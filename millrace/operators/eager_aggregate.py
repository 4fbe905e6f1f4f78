"""Eager aggregation through joins (problem 4).

``SELECT g, count(*), sum(l.x), sum(r.y) FROM l JOIN r USING (k) GROUP BY g`` without ever joining rows to rows: each
input is first aggregated by join key and the group columns it owns (combining on the map side, so a key that holds a
third of all rows leaves each task as one row), the compact states are joined, counts are multiplied and sums are
scaled by the other side's count, and the result is rolled up to the groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    left_groups: Sequence[str] = (),
    right_groups: Sequence[str] = (),
    left_sums: Mapping[str, str] | None = None,
    right_sums: Mapping[str, str] | None = None,
    keep_key: bool = True,
    how: str = "inner",
    count: str = "n",
) -> DataFrame:
    """Join aggregate by (key columns if ``keep_key``) + ``left_groups`` + ``right_groups``.

    ``left_sums`` and ``right_sums`` map output names to columns of that side. ``how`` is ``inner`` or ``left``.

    - A null key joins nothing: its rows vanish for ``inner`` and stay, unmatched, for ``left``.
    - A left row without partner counts once for ``left`` and has null right groups and null right sums.
    - Null values add nothing; a sum without any value is null. Null group values form a group of their own.
    - Repeated rows multiply, as in the plain join. Empty inputs give no rows.
    - Only the named columns are read, so further columns may share names across the sides. Group columns of the two
      sides and sum names must differ from each other and from the keys.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    left_sums, right_sums = dict(left_sums or {}), dict(right_sums or {})
    names = [*on, *left_groups, *right_groups, *left_sums, *right_sums, count]
    if len(set(names)) < len(names):
        raise ValueError(f"names clash: {names}")

    def state(df: DataFrame, groups: Sequence[str], sums: Mapping[str, str], n: str) -> DataFrame:
        src = df.select(*[F.col(c) for c in [*on, *groups]], *[F.col(c).alias(f"__v_{o}") for o, c in sums.items()])
        return src.groupBy(*on, *groups).agg(F.count(F.lit(1)).alias(n), *[F.sum(f"__v_{o}").alias(f"__s_{o}") for o in sums])

    a, b = state(left, left_groups, left_sums, "__na"), state(right, right_groups, right_sums, "__nb")
    # The optimizer may broadcast a side by its measured size (AQE); nothing here forces it.
    joined = a.join(b, list(on), how)
    nb = F.coalesce("__nb", F.lit(1))
    out = [*(on if keep_key else ()), *left_groups, *right_groups]
    scaled = joined.select(
        *out,
        (F.col("__na") * nb).alias(count),
        *[(F.col(f"__s_{o}") * nb).alias(o) for o in left_sums],
        *[(F.col(f"__s_{o}") * F.col("__na")).alias(o) for o in right_sums],
    )
    if keep_key and not left_groups and not right_groups:
        return scaled  # one row per key on each side: nothing is left to roll up
    return scaled.groupBy(*out).agg(*[F.sum(c).alias(c) for c in [count, *left_sums, *right_sums]])


def key_counts(events: DataFrame, dimensions: Mapping[str, DataFrame]) -> DataFrame:
    """``(key_field, key_id, n, known)``: complete counts for each value of each field of ``dimensions``, in one pass.

    The fields are unpivoted, the pairs pre-aggregated, and the states joined with the (deduplicated) keys of each
    dimension; ``known`` tells whether the dimension has the key. Null keys are left out.
    """
    fields = list(dimensions)
    parts = ", ".join(f"'{f}', `{f}`" for f in fields)
    long = events.select(F.expr(f"stack({len(fields)}, {parts}) AS (key_field, key_id)")).where("key_id IS NOT NULL")
    known = None
    for f, d in dimensions.items():
        one = d.select(F.lit(f).alias("key_field"), F.col(f).cast("bigint").alias("key_id"), F.lit(1).alias("__one")).where("key_id IS NOT NULL").distinct()
        known = one if known is None else known.unionByName(one)
    joined = eager_join_aggregate(long, known, ["key_field", "key_id"], right_sums={"__known": "__one"}, how="left")
    return joined.select("key_field", "key_id", "n", F.col("__known").isNotNull().alias("known"))


def heavy_keys(counts: DataFrame, part: int = 50) -> DataFrame:
    """The keys with at least 1/``part`` of all rows of their field; at most ``part`` keys a field."""
    totals = counts.groupBy("key_field").agg(F.sum("n").alias("__total"))
    # One row a field, so the broadcast is bounded by the number of fields.
    return counts.join(F.broadcast(totals), "key_field").where(F.col("n") * part >= F.col("__total")).drop("__total")
