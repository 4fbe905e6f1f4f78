"""Bounded-memory aggregation of an unbounded log: state is one count per item and per category."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_dir


def counts(events: DataFrame, *keys: str) -> DataFrame:
    """``(field, key, n)`` over several key columns at once; works on batch and streaming frames alike."""
    parts = ", ".join(f"'{k}', CAST(`{k}` AS STRING)" for k in keys)
    return events.select(F.expr(f"stack({len(keys)}, {parts}) AS (field, key)")).groupBy("field", "key").agg(F.count(F.lit(1)).alias("n"))


def run_to_end(stream: DataFrame, *keys: str, checkpoint: str | None = None) -> DataFrame:
    """All available input of ``stream`` through a complete-mode query into a table of counts."""
    spark = stream.sparkSession
    name = f"counts_{uuid.uuid4().hex}"
    at = checkpoint or shared_dir(spark)
    query = (
        counts(stream, *keys).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{at}/{name}").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.table(name)


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over the files of ``path``, a folder or a single file (which the file source takes only as a pattern)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")


def windowed_popularity(stream: DataFrame, *, time: str, key: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """``(start, key, n)`` per tumbling window, with late events up to ``late``; an addition of this engine. NTZ times
    are cast, since watermarks need a time zone."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def head_share(item_counts: DataFrame, n_items: int, per: int = 100) -> DataFrame:
    """One row ``(n_events, n_touched, head_share)``: the share of events on the top ``max(1, n_items // per)`` items.

    The head is a sort with a limit, so tasks keep only that many rows each.
    """
    top = item_counts.orderBy(F.desc("n"), F.asc("key")).limit(max(1, n_items // per)).agg(F.sum("n").alias("__h")).withColumn("__k", F.lit(1))
    whole = item_counts.agg(F.sum("n").alias("n_events"), F.count(F.when(F.col("n") > 0, 1)).alias("n_touched")).withColumn("__k", F.lit(1))
    return whole.join(top, "__k").select("n_events", "n_touched", (F.col("__h") / F.greatest("n_events", F.lit(1))).alias("head_share"))
