"""Per-entity feature table from typed events (problem 3).

Types are encoded as indices of a dictionary. Per entity the engine keeps four aligned sparse vectors (index, count,
total, latest time), and two more with the smallest and largest witness, so that "at least two different items" stays
mergeable. States merge by addition and maximum; columns appear only at the very end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest dictionary that is broadcast and expanded; beyond it, ``type_index`` raises.
MAX_TYPES = 10_000

STATE = ["idx", "cnt", "total", "latest", "low", "high"]


def type_index(types: DataFrame, col: str, max_types: int = MAX_TYPES) -> DataFrame:
    """The dictionary ``(type, idx)``: distinct non-null values of ``col`` in ascending order, numbered from 0.

    The dictionary is what becomes columns, so it is bounded by ``max_types``; more distinct values raise ValueError.
    An empty table gives an empty dictionary.
    """
    found = [r[0] for r in types.select(col).where(F.col(col).isNotNull()).distinct().limit(max_types + 1).collect()]
    if len(found) > max_types:
        raise ValueError(f"more than {max_types} types")
    kind = types.schema[col].dataType.simpleString()
    return types.sparkSession.createDataFrame([(v, i) for i, v in enumerate(sorted(found))], f"type {kind}, idx int")


def feature_state(
    events: DataFrame, dictionary: DataFrame, *, entity: str, kind: str, time: str, value: str | Column | None = None, witness: str | None = None
) -> DataFrame:
    """One row per entity: ``entity``, ``n_all``, ``latest_all`` and ``state``, an array of structs ordered by ``idx``.

    - Rows with a null entity belong to no one and are left out.
    - A null type, or one outside the dictionary, counts in ``n_all`` and ``latest_all`` and has no vector entry.
    - A null time counts, without moving the latest time. A null value adds nothing to the total.
    - Repeated rows count each. An empty table gives no rows. Other columns of ``events`` are never touched.

    The first aggregation combines on the map side, so a hot entity reaches the shuffle as at most one row per type and
    task; the second gathers at most ``MAX_TYPES`` + 1 rows an entity.
    """
    val = F.lit(1.0) if value is None else (F.col(value) if isinstance(value, str) else value)
    wit = F.lit(None).cast("bigint") if witness is None else F.col(witness)
    rows = events.select(
        F.col(entity).alias("__e"), F.col(kind).alias("__k"), F.col(time).alias("__t"), val.cast("double").alias("__v"), wit.alias("__w")
    ).where(F.col("__e").isNotNull())
    per_type = rows.groupBy("__e", "__k").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("__v").alias("total"), F.max("__t").alias("latest"), F.min("__w").alias("low"), F.max("__w").alias("high")
    )
    # At most MAX_TYPES rows: the size is checked where the dictionary is made.
    d = F.broadcast(dictionary.select(F.col("type").alias("__k"), "idx"))
    per_type = per_type.join(d, "__k", "left")
    return _gather(per_type.withColumn("__n", F.col("cnt")).withColumn("__l", F.col("latest")), entity)


def _gather(per_type: DataFrame, entity: str) -> DataFrame:
    entry = F.struct("idx", "cnt", F.coalesce("total", F.lit(0.0)).alias("total"), "latest", "low", "high")
    return (
        per_type.groupBy("__e")
        .agg(
            F.sum("__n").alias("n_all"),
            F.max("__l").alias("latest_all"),
            F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(), entry))).alias("state"),
        )
        .withColumnRenamed("__e", entity)
    )


def merge_states(*states: DataFrame, entity: str) -> DataFrame:
    """States of disjoint event sets (say, yesterday's and today's) as the state of their union."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    both = both.withColumnRenamed(entity, "__e")
    # The entity's own totals travel in an entry without index, so one aggregation merges everything.
    whole = F.struct(
        F.lit(None).cast("int").alias("idx"), F.lit(0).cast("bigint").alias("cnt"), F.lit(0.0).alias("total"), F.lit(None).cast(both.schema["latest_all"].dataType).alias("latest"),
        F.lit(None).cast(both.schema["state"].dataType.elementType["low"].dataType).alias("low"), F.lit(None).cast(both.schema["state"].dataType.elementType["high"].dataType).alias("high"),
    )
    rows = both.select("__e", "n_all", "latest_all", F.explode(F.concat(F.array(whole), F.col("state"))).alias("s")).select(
        "__e", "s.*", F.when(F.col("s.idx").isNull(), F.col("n_all")).otherwise(F.lit(0)).alias("__n"), F.when(F.col("s.idx").isNull(), F.col("latest_all")).alias("__l")
    )
    per_type = rows.groupBy("__e", "idx").agg(
        F.sum("cnt").alias("cnt"), F.sum("total").alias("total"), F.max("latest").alias("latest"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("__n").alias("__n"), F.max("__l").alias("__l"),
    )
    return _gather(per_type, entity)


def expand(state: DataFrame, dictionary: DataFrame, *, entity: str) -> DataFrame:
    """The wide table: ``n_all``, ``latest_all`` and, for each index i, ``cnt_i`` (0 if none), ``total_i`` (0.0) and
    ``recency_s_i``, the whole seconds from the type's latest event to the entity's latest (null if none).

    Times are timestamps. An Arrow batch becomes three matrices (type by entity), each of whose rows is a column: with
    hundreds of columns this takes a third of the time of as many JVM expressions.
    """
    n = dictionary.count()
    names = [f"{k}_{i}" for i in range(n) for k in ("cnt", "total", "recency_s")]
    kinds = {"cnt": "bigint", "total": "double", "recency_s": "bigint"}
    head = state.select(F.col(entity).alias("__e"), "n_all", "latest_all", "state")
    shape = [f"`{c}` {head.schema[c].dataType.simpleString()}" for c in ("__e", "n_all", "latest_all")] + [f"{c} {kinds[c.rpartition('_')[0]]}" for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):  # bounds the matrices
                b = whole.slice(at, 2000)
                vec = b.column(3)
                lens = np.diff(np.asarray(vec.offsets))
                entry = vec.flatten()
                row, idx = np.repeat(np.arange(len(lens)), lens), np.asarray(entry.field("idx"))
                cnt, total = np.zeros((n, len(lens)), np.int64), np.zeros((n, len(lens)))
                cnt[idx, row], total[idx, row] = np.asarray(entry.field("cnt")), np.asarray(entry.field("total"))
                seen = entry.field("latest")
                known = np.asarray(seen.is_valid())
                micros = lambda x: np.asarray(x.cast(pa.timestamp("us", x.type.tz)).cast(pa.int64()).fill_null(0))
                age = np.zeros((n, len(lens)), np.int64)
                none = np.ones((n, len(lens)), bool)
                age[idx, row] = (micros(b.column(2))[row] - micros(seen)) // 1_000_000
                none[idx, row] = ~known
                cols = [pa.array(m) for i in range(n) for m in (cnt[i], total[i], np.ma.masked_array(age[i], none[i]))]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=["__e", "n_all", "latest_all", *names])

    return head.mapInArrow(run, ", ".join(shape)).withColumnRenamed("__e", entity)


def dominant_types(state: DataFrame, dictionary: DataFrame, *, entity: str, min_count: int = 4, share: int = 5, within: str = "7 days") -> DataFrame:
    """``(entity, type)`` where the type has at least ``min_count`` events, at least two different witnesses, at least
    1/``share`` of all the entity's events, and its latest event at most ``within`` before the entity's latest."""
    s = state.select(entity, "n_all", "latest_all", F.explode("state").alias("s"))
    hit = s.where(
        (F.col("s.cnt") >= min_count)
        & (F.col("s.low") < F.col("s.high"))
        & (F.col("s.cnt") * share >= F.col("n_all"))
        & (F.col("s.latest") >= F.col("latest_all") - F.expr(f"INTERVAL {within}"))
    )
    return hit.select(entity, F.col("s.idx").alias("idx")).join(F.broadcast(dictionary), "idx").select(entity, "type")
