"""Table access and the counted events that most operators start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted_events(interactions: DataFrame, category: bool = False) -> DataFrame:
    """One row per ``event_id``: its delivery with the earliest ``received_at``, where user and item are known and
    ``ts`` is set.

    All deliveries of an event agree on user, item and ts, so a filter before the aggregation drops whole events and
    the aggregation needs no ordering unless ``category`` is asked for. Rows with a null ``event_id`` form no event and
    are left out. A null ``received_at`` counts as later than any other.
    """
    known = interactions.where("event_id IS NOT NULL AND user_id >= 0 AND item_id >= 0 AND ts IS NOT NULL")
    aggs = [F.min("user_id").alias("user_id"), F.min("item_id").alias("item_id"), F.min("ts").alias("ts")]
    if category:
        at = F.coalesce("received_at", F.expr("TIMESTAMP_NTZ'9999-12-31 00:00:00'"))
        # Deliveries that share the earliest moment are identical, so which of them is taken doesn't matter. A plain
        # timestamp as ordering keeps the buffers fixed-width, hence a hash aggregate; a struct would sort.
        aggs.append(F.min_by("category", at).alias("category"))
    return known.groupBy("event_id").agg(*aggs)
