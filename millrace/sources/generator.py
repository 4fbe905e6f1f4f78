"""Synthetic interaction log: every event is a function of its index, so any partitioning gives the same rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.generator_math import EPOCHS
from millrace.functions.hashing import with_uniforms

#: Multiplier that spreads users over primary categories.
USER_MULTIPLIER = 2654435761


@dataclass(frozen=True)
class GeneratorConfig:
    n_users: int = 50_000
    n_items: int = 5_000
    n_categories: int = 20
    pop_zipf: float = 1.03
    user_zipf: float = 0.75
    focus: float = 0.72
    trend_amp: float = 0.55
    seed: int = 42


def zipf(n: int, s: float) -> np.ndarray:
    w = np.arange(1, n + 1, dtype=np.float64) ** -s
    return w / w.sum()


class Catalogue:
    """The dimensions of a configuration, small enough for the driver and a broadcast: items with categories and permuted
    Zipf popularity, category trend per epoch, users with Zipf activity."""

    def __init__(self, cfg: GeneratorConfig):
        self.cfg = cfg
        rng = np.random.default_rng(cfg.seed)
        self.category = rng.integers(0, cfg.n_categories, cfg.n_items).astype(np.int16)
        self.popularity = np.empty(cfg.n_items)
        self.popularity[rng.permutation(cfg.n_items)] = zipf(cfg.n_items, cfg.pop_zipf)
        order = np.lexsort((np.arange(cfg.n_items), self.category))
        self.pools = dict(enumerate(np.split(order, np.searchsorted(self.category[order], np.arange(1, cfg.n_categories)))))
        for c, pool in self.pools.items():  # a category without items borrows one
            if not len(pool):
                self.pools[c] = np.array([rng.integers(0, cfg.n_items)])
        self.phase = rng.uniform(size=cfg.n_categories)

    @cached_property
    def pool_cdf(self) -> dict[int, np.ndarray]:
        return {c: np.cumsum(self.popularity[p] / self.popularity[p].sum()) for c, p in self.pools.items()}

    @cached_property
    def trend_cdf(self) -> np.ndarray:
        mid = (np.arange(EPOCHS)[:, None] + 0.5) / EPOCHS
        w = zipf(self.cfg.n_categories, 0.5) * (1 + self.cfg.trend_amp * np.sin(2 * np.pi * (mid + self.phase)))
        return np.cumsum(w / w.sum(1, keepdims=True), axis=1)

    @cached_property
    def user_cdf(self) -> np.ndarray:
        return np.cumsum(zipf(self.cfg.n_users, self.cfg.user_zipf))

    def items(self, spark: SparkSession) -> DataFrame:
        rows = pd.DataFrame({"item_id": np.arange(self.cfg.n_items), "category": self.category.astype(np.int32), "popularity": self.popularity})
        return spark.createDataFrame(rows, "item_id bigint, category int, popularity double")

    def users(self, spark: SparkSession) -> DataFrame:
        primary = F.pmod(F.col("id") * F.lit(USER_MULTIPLIER), F.lit(self.cfg.n_categories)).cast("int")
        return spark.range(self.cfg.n_users).select(F.col("id").alias("user_id"), primary.alias("primary_cat"))


def look_up(cdf: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many entries of ``cdf`` are at most ``u``, never past the last entry."""
    return np.minimum(np.searchsorted(cdf, u, side="right"), len(cdf) - 1)


def draw(cat: Catalogue, focus: np.ndarray, x_user: np.ndarray, x_cat: np.ndarray, x_item: np.ndarray, epoch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Users, categories and items of a batch of events from their uniforms."""
    cfg = cat.cfg
    users = look_up(cat.user_cdf, x_user)
    primary = users.astype(np.uint64) * np.uint64(USER_MULTIPLIER) % np.uint64(cfg.n_categories)
    # Here an entry counts only if it lies strictly below the draw.
    explored = np.minimum((cat.trend_cdf[epoch] < x_cat[:, None]).sum(1), cfg.n_categories - 1)
    cats = np.where(focus < cfg.focus, primary.astype(np.int64), explored)
    items = np.empty(len(cats), np.int64)
    for c in np.unique(cats):
        at = cats == c
        items[at] = cat.pools[int(c)][look_up(cat.pool_cdf[int(c)], x_item[at])]
    return users, cats, items


def generate(spark: SparkSession, rows: int, cfg: GeneratorConfig = GeneratorConfig(), *, start: float = 0.0, end: float = 1.0, partitions: int | None = None) -> DataFrame:
    """``(event_id, user_id, item_id, ts, category)``: hashes are JVM expressions, only the table look-ups go through
    Arrow. ``ts`` rises from ``start`` to below ``end``."""
    shared = spark.sparkContext.broadcast(Catalogue(cfg))
    ids = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    events = with_uniforms(ids, F.col("id"), {"x_user": 0, "x_focus": 1, "x_cat": 2, "x_item": 3}, cfg.seed)
    frac = F.col("id") / F.lit(float(rows))
    events = events.withColumns({"ts": F.lit(start) + F.lit(end - start) * frac, "epoch": F.least(F.floor(frac * EPOCHS), F.lit(EPOCHS - 1)).cast("int")})

    def run(batches):
        for pdf in batches:
            u, c, i = draw(shared.value, *(pdf[k].to_numpy() for k in ("x_focus", "x_user", "x_cat", "x_item", "epoch")))
            yield pd.DataFrame({"event_id": pdf["id"], "user_id": u, "item_id": i, "ts": pdf["ts"], "category": c.astype(np.int32)})

    return events.mapInPandas(run, "event_id bigint, user_id bigint, item_id bigint, ts double, category int")
