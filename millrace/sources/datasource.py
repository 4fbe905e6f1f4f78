"""The event source as a Python data source, batch and streaming: ``spark.read.format("millrace_events")``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from millrace.functions.generator_math import EPOCHS
from millrace.functions.hashing import SM1, SM2, SM3
from millrace.sources.generator import Catalogue, GeneratorConfig, draw

_SCHEMA = "event_id bigint, user_id bigint, item_id bigint, ts double, category int"
_CHUNK = 200_000


def uniforms(index: np.ndarray, stream: int, seed: int) -> np.ndarray:
    """The same draws as ``millrace.functions.hashing.uniform``, in numpy."""
    z = (index.astype(np.uint64) * np.uint64(4) + np.uint64(stream)) ^ np.uint64(seed * SM1 % (1 << 64))
    z = z + np.uint64(SM1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(SM2)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SM3)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Span(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


def _config(options) -> tuple[GeneratorConfig, int]:
    kinds = {"n_users": int, "n_items": int, "n_categories": int, "pop_zipf": float, "user_zipf": float, "focus": float, "trend_amp": float, "seed": int}
    return GeneratorConfig(**{k: f(options[k]) for k, f in kinds.items() if k in options}), int(options.get("rows", 1000))


def _read(cfg: GeneratorConfig, rows: int, span: Span):
    cat = Catalogue(cfg)
    for lo in range(span.lo, span.hi, _CHUNK):
        e = np.arange(lo, min(lo + _CHUNK, span.hi), dtype=np.int64)
        x = [uniforms(e, s, cfg.seed) for s in range(4)]
        frac = e / rows
        u, c, i = draw(cat, x[1], x[0], x[2], x[3], np.minimum((frac * EPOCHS).astype(np.int64), EPOCHS - 1))
        yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(u.astype(np.int64)), pa.array(i), pa.array(frac), pa.array(c.astype(np.int32))], names=["event_id", "user_id", "item_id", "ts", "category"])


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.cfg, self.rows = _config(options)
        self.parts = int(options.get("partitions", 4))

    def partitions(self):
        cuts = np.linspace(0, self.rows, self.parts + 1).astype(int).tolist()
        return [Span(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]

    def read(self, partition):
        yield from _read(self.cfg, self.rows, partition)


class _Stream(DataSourceStreamReader):
    """Events by their number, up to ``rows``, in partitions of ``chunk``. The position is Spark's alone: the reader keeps
    none, so a restarted query goes on from the offset that Spark stored, without a gap or a repetition."""

    def __init__(self, options):
        self.cfg, self.rows = _config(options)
        self.chunk = int(options.get("chunk", 100_000))

    def initialOffset(self):
        return {"at": 0}

    def latestOffset(self):
        return {"at": self.rows}

    def partitions(self, start, end):
        return [Span(lo, min(lo + self.chunk, end["at"])) for lo in range(start["at"], end["at"], self.chunk)]

    def read(self, partition):
        yield from _read(self.cfg, self.rows, partition)

    def commit(self, end):
        pass


class EventSource(DataSource):
    @classmethod
    def name(cls):
        return "millrace_events"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventSource)
