"""Statistics of the train slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import row_numbers


def item_counts(train: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, n, mean_ts)`` for every item of the catalogue: its events and their mean time (0 without events)."""
    per = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.avg("ts").alias("mean_ts"))
    return items.select("item_id").distinct().join(per, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_ts", F.lit(0.0)).alias("mean_ts"))


def item_stats(train: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, n, prob, selfinfo, mean_ts)`` for every item of the catalogue: smoothed popularity, its -log2, and the
    mean time (0 without events)."""
    return smoothed(item_counts(train, items))


def smoothed(dense: DataFrame) -> DataFrame:
    """``item_counts`` with the smoothed popularity and its -log2."""
    total = dense.agg(F.sum(F.col("n") + 1)).head()[0] or 1
    prob = (F.col("n") + 1) / F.lit(float(total))
    return dense.select("item_id", "n", prob.alias("prob"), (-F.log2(prob)).alias("selfinfo"), "mean_ts")


def popularity_ranking(stats: DataFrame) -> DataFrame:
    """``(item_id, n, pop_rank)``: most to least popular, equal counts by smaller id."""
    return row_numbers(stats.select("item_id", "n"), [F.desc("n"), F.asc("item_id")], "pop_rank")


def logq(stats: DataFrame) -> DataFrame:
    """``(item_id, logq)``: log of the smoothed sampling probability."""
    return stats.select("item_id", F.log("prob").alias("logq"))


def category_histogram(train: DataFrame, items: DataFrame) -> DataFrame:
    """``(user_id, category, n)`` by the catalogue's category."""
    return train.select("user_id", "item_id").join(items.select("item_id", "category").distinct(), "item_id").groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"))


def dominant_category(histogram: DataFrame) -> DataFrame:
    """``(user_id, dom_cat)``: the category with most events, ties to the lowest."""
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), F.asc("category"))
    return histogram.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("user_id", F.col("category").alias("dom_cat"))


def user_stats(train: DataFrame, items: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """``(user_id, n, mean_ts, dom_cat)``; with ``users``, every user is there (0 events, mean 0, no category)."""
    per = train.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("ts").alias("mean_ts"))
    out = per.join(dominant_category(category_histogram(train, items)), "user_id", "left")
    if users is not None:
        out = users.select("user_id").distinct().join(out, "user_id", "left")
    return out.select("user_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_ts", F.lit(0.0)).alias("mean_ts"), "dom_cat")
