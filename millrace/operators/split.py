"""Temporal split without leakage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranking import exact_quantile


@dataclass(frozen=True)
class Split:
    """``train`` and ``test`` events (user_id, item_id, ts), and the distinct pairs made of them."""

    threshold: float
    train: DataFrame
    test: DataFrame
    history: DataFrame
    ground_truth: DataFrame

    @property
    def eval_users(self) -> DataFrame:
        return self.ground_truth.select("user_id").distinct()


def threshold_of(log: DataFrame, test_frac: float = 0.2) -> float:
    """The interpolated ``1 - test_frac`` quantile of ``ts``."""
    threshold = exact_quantile(log, "ts", 1.0 - test_frac)
    if threshold is None:
        raise ValueError("an empty log can't be split")
    return threshold


def temporal_split(log: DataFrame, test_frac: float = 0.2) -> Split:
    """Events before the interpolated ``1 - test_frac`` quantile of ``ts`` train, the rest (ties included) test.

    The threshold is collected to a literal, so the filters reach the scan. Ground truth is what users with a history
    take anew: a semi join, then an anti join on the pair.
    """
    threshold = threshold_of(log, test_frac)
    train, test = log.where(F.col("ts") < threshold), log.where(F.col("ts") >= threshold)
    history = train.select("user_id", "item_id").distinct()
    known = test.select("user_id", "item_id").distinct().join(history.select("user_id").distinct(), "user_id", "left_semi")
    return Split(threshold, train, test, history, known.join(history, ["user_id", "item_id"], "left_anti"))


def leak_check(split: Split) -> DataFrame:
    """One row: sizes, the latest train and earliest test moment, pairs both in history and ground truth, and ``ok``."""
    a = split.train.agg(F.count(F.lit(1)).alias("n_train"), F.max("ts").alias("max_train"))
    b = split.test.agg(F.count(F.lit(1)).alias("n_test"), F.min("ts").alias("min_test"))
    c = split.ground_truth.join(split.history, ["user_id", "item_id"]).agg(F.count(F.lit(1)).alias("n_leaked"))
    one = a.withColumn("__k", F.lit(1)).join(b.withColumn("__k", F.lit(1)), "__k").join(c.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return one.withColumn("ok", (F.col("n_train") > 0) & (F.col("n_test") > 0) & (F.col("max_train") < F.col("min_test")) & (F.col("n_leaked") == 0))
