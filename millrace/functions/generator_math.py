"""Distributions of the synthetic event source as plans."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCHS = 128


def zipf_weights(spark: SparkSession, n: int, s: float) -> DataFrame:
    """``(rank, weight)``: 1/rank^s over ranks 1 to n, summing to 1. The total is one aggregated row."""
    raw = spark.range(1, n + 1).select(F.col("id").alias("rank"), F.pow(F.col("id").cast("double"), F.lit(-float(s))).alias("w"))
    total = raw.agg(F.sum("w")).head()[0]
    return raw.select("rank", (F.col("w") / total).alias("weight"))


def cumulative(weights: DataFrame, key: str, weight: str, within: list[str] | None = None) -> DataFrame:
    """``weights`` with ``lo`` and ``hi``: the half-open interval of each row in its running sum, per group ``within``.

    For dimension tables (categories, epochs), whose groups are small.
    """
    w = Window.partitionBy(*(within or [F.lit(0)])).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    hi = weights.withColumn("hi", F.sum(weight).over(w))
    return hi.withColumn("lo", F.col("hi") - F.col(weight))


def trend_table(categories: DataFrame, amplitude: float, epochs: int = EPOCHS) -> DataFrame:
    """``(epoch, category, weight, lo, hi)`` from ``(category, base, phase)``: seasonal weights, summing to 1 per epoch."""
    spark = categories.sparkSession
    mid = (F.col("epoch") + 0.5) / epochs
    raw = spark.range(epochs).select(F.col("id").cast("int").alias("epoch"), F.lit(1).alias("__j"))
    # A grid of two dimension tables: epochs is a parameter and categories are few.
    grid = categories.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).join(F.broadcast(raw.drop("__j")), "epoch")
    w = grid.withColumn("w", F.col("base") * (1 + amplitude * F.sin(2 * math.pi * (mid + F.col("phase")))))
    share = w.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("epoch")))
    return cumulative(share.select("epoch", "category", "weight"), "category", "weight", ["epoch"])
