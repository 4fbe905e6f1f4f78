"""Parquet, CSV and JSON ends of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions import vectors as V

LOG_SCHEMA = "event_id bigint, user_id bigint, item_id bigint, ts double, category int"


def write_log(log: DataFrame, path: str) -> int:
    """Writes zstd Parquet and returns the number of rows, counted on the way."""
    seen = Observation()
    log.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return int(seen.get["n"])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def write_metrics(metrics: list[DataFrame], path: str) -> None:
    """A CSV folder with one row per method."""
    out = metrics[0]
    for m in metrics[1:]:
        out = out.unionByName(m)
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a handful of rows


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)  # one row


def write_items(item_emb: DataFrame, items: DataFrame, stats: DataFrame, path: str) -> None:
    """``(item_id, vec_norm, category, item_count)``: the run's artefact."""
    out = item_emb.join(items.select("item_id", "category").distinct(), "item_id").join(stats.select("item_id", F.col("n").alias("item_count")), "item_id")
    out.select("item_id", V.normalise(F.col("vec")).cast("array<float>").alias("vec_norm"), "category", "item_count").write.mode("overwrite").parquet(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("item_id bigint, vec_norm array<float>, category int, item_count bigint").parquet(path)
