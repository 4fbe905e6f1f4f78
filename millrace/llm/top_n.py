"""Top N items within every group, by descending score bands (problem 1).

The score range is cut at quantiles of the scores, and the rows are stored by band, so that a band is read alone. Bands are
worked from the top: groups that the higher bands already filled are removed by an anti join before anything is ranked, and
in the band where a group fills up, exact ranking with the tie rule picks what is missing. Bands below the one in which the
last group fills up aren't read at all. Groups that own much of a band are few; they are known from the counts, broadcast,
and ranked apart, with at most N rows of a group and task reaching the shuffle, so a group with millions of items never
gathers anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

#: Quantiles of the scores at which bands are cut. More bands read less of the low scores' rows per pass.
FRACTIONS = (0.999, 0.99, 0.9, 0.5)
#: A group is hot where it owns this share of all rows in a band: at most 1/HOT groups, which are broadcast.
HOT = 1 / 1024


def band_edges(scores: DataFrame, col: str, fractions: tuple[float, ...] = FRACTIONS) -> list[float]:
    """Descending, distinct lower edges of all bands but the lowest, which has none. One row reaches the driver."""
    got, low = scores.agg(F.percentile_approx(col, list(fractions), 1000), F.min(col)).head()
    return sorted({v for v in got or [] if v > low}, reverse=True)


def top_n_per_group(df: DataFrame, *, group: str, item: str, score: str, n: int = 10, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """``(group, item, score, rank)``: the ``n`` rows of each group with the highest score, ties by smaller item.

    - Rows with a null group belong to no group and are left out.
    - A null or NaN score is lower than any other, minus infinity included, and NaN comes before null (both are returned as
      they are); a null item comes last among equals.
    - Repeated rows count each. Groups with fewer rows give all of them. An empty table gives no rows.
    - Only the three columns are read, whatever others are called.

    The partial ranking before a shuffle is Spark's window group limit, which applies for n up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000); larger n stays right, without that early cut.
    """
    number = F.col("s").cast("double")
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s")).where("g IS NOT NULL")
    scored = written(rows.withColumn("b", F.when(~F.isnan(number), number)), "scored")  # null where there is no score
    edges = band_edges(scored, "b", fractions)
    bands = range(len(edges) + 1)
    number_of = reduce(lambda c, k: c.when(F.col("b") >= edges[k], k), bands[1:-1], F.when(F.col("b") >= edges[0], 0)).otherwise(len(edges)) if edges else F.lit(0)
    stored = written(scored.withColumn("band", number_of), "banded", "band")

    sizes = stored.groupBy("g", "band").agg(F.count(F.lit(1)).alias("c"))
    higher = Window.partitionBy("g").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per group and band; read once per band below.
    sizes = written(sizes.withColumn("above", F.coalesce(F.sum("c").over(higher), F.lit(0))), "sizes", "band")
    # Rows and the groups still open, by band: one row a band reaches the driver.
    held = {r["band"]: r for r in sizes.groupBy("band").agg(F.sum("c").alias("rows"), F.count_if(F.col("above") < n).alias("open")).collect()}
    total = sum(r["rows"] for r in held.values())

    # The score itself decides; a missing one is told apart first, because NaN counts as the largest number.
    rank = Window.partitionBy("g").orderBy(F.desc(F.col("b").isNotNull()), F.desc_nulls_last("s"), F.asc_nulls_last("i"))

    def best(left: DataFrame, above: Column) -> DataFrame:
        ranked = left.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= n)
        return ranked.withColumn("rank", (F.col("r") + above).cast("int")).where(F.col("rank") <= n).select("g", "i", "s", "rank")

    out = []
    for k in bands:
        if k not in held or not held[k]["open"]:
            continue  # every group in it was filled by higher bands
        band, mine = stored.where(F.col("band") == k).drop("band"), sizes.where(F.col("band") == k).drop("band")
        hot = F.broadcast(mine.where(F.col("c") >= max(2, int(total * HOT))).select("g", "above"))
        if k:
            out.append(best(band.join(hot.where(F.col("above") < n), "g"), F.col("above")))
            # Most groups have nothing above and are in neither join.
            cold = band.join(hot, "g", "left_anti").join(mine.where(F.col("above") >= n).select("g"), "g", "left_anti")
            cold = cold.join(mine.where((F.col("above") > 0) & (F.col("above") < n)).select("g", "above"), "g", "left")
            out.append(best(cold, F.coalesce("above", F.lit(0))))
        else:
            out.append(best(band, F.lit(0)))
    if not out:
        out = [best(stored.drop("band"), F.lit(0))]
    return reduce(DataFrame.unionByName, out).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
