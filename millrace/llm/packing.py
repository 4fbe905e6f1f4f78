"""Filling fixed-capacity containers by minimum bin slack (problem 8).

Only the lengths matter for packing, so the whole corpus shrinks to a histogram with at most ``capacity`` entries. Over
it, each container starts with the longest length left and a bitset subset-sum picks the multiset of remaining lengths
that fills the rest closest to capacity; the backtracked counts tell how many containers in a row can be filled alike.
The resulting runs are bounded by the capacity, not by the rows. Every item then finds its container from its rank
among the items of its length, and ranks are made in groups, as many as the number of items of the length asks for, so a
length that a third of all items share is no hot spot. Each container size is packed by a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import TOKENIZERS, token_counts
from millrace.session import written

#: Items of one length that are ranked together; more are split into as many groups as it takes.
RANKED = 100_000
#: Rows of pack_sizes at most: they are driver-side parameters.
MAX_SIZES = 1000


def fill_one(lengths: list[int], counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset ``[(length, copies)]`` for one container: the longest remaining length, then what fills closest.

    ``lengths`` descend and have positive counts. Bit s of a bitset says that a sum s can be reached. Lengths join in
    binary portions of their copies until the rest is reached exactly; backtracking prefers the longer ones.
    """
    head = lengths[0]
    rest = capacity - head
    mask = (1 << (rest + 1)) - 1
    reach, target = 1, 1 << rest
    steps: list[tuple[int, int, int]] = []  # length, copies of the portion, what was reachable before
    for v in lengths:
        if reach & target:
            break
        if v > rest:
            continue
        have = min(counts[v] - (v == head), rest // v)
        portion = 1
        while have > 0:
            k = min(portion, have)
            steps.append((v, k, reach))
            reach |= (reach << (v * k)) & mask
            have -= k
            portion *= 2
            if reach & target:
                break
    at = reach.bit_length() - 1
    used: dict[int, int] = {head: 1}
    for v, k, before in reversed(steps):
        if not (before >> at) & 1:
            used[v] = used.get(v, 0) + k
            at -= v * k
    return sorted(used.items(), reverse=True)


def min_slack_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs ``(containers, [(length, copies in each)])`` that use up ``counts`` (length to number, 1 to capacity)."""
    left = {v: n for v, n in counts.items() if n > 0}
    if any(not 1 <= v <= capacity for v in left):
        raise ValueError("lengths must be within 1 to the capacity")
    lengths = sorted(left, reverse=True)
    runs = []
    while lengths:
        used = fill_one(lengths, left, capacity)
        times = min(left[v] // k for v, k in used)
        runs.append((times, used))
        for v, k in used:
            left[v] -= times * k
            if not left[v]:
                lengths.remove(v)
    return runs


def run_rows(size: int, runs: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(size, length, first rank, copies per container, first container, containers)`` of each length in each run."""
    rows, base, ranked = [], 0, {}
    for times, used in runs:
        for v, k in used:
            rows.append((size, v, ranked.get(v, 0), k, base, times))
            ranked[v] = ranked.get(v, 0) + times * k
        base += times
    return rows


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (size, capacity, lengths, counts) to the rows of their runs."""
    for b in batches:
        for size, capacity, lengths, counts in zip(*(c.to_pylist() for c in b.columns)):
            rows = run_rows(size, min_slack_runs(dict(zip(lengths, counts)), capacity))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=["size", "v", "rank", "copies", "base", "times"])


class _Runs:
    """For each (size, length): rank intervals, copies per container and first container."""

    def __init__(self, rows: list[tuple[int, int, int, int, int, int]]):
        self.containers: dict[int, int] = {}
        for r in rows:
            self.containers[r[0]] = max(self.containers.get(r[0], 0), r[4] + r[5])
        self.cols = np.array(sorted(rows), np.int64).reshape(-1, 6)
        key = self.cols[:, :2]
        first = np.concatenate(([True], (key[1:] != key[:-1]).any(1))) if len(key) else np.zeros(0, bool)
        self.of = {(int(s), int(v)): i for i, (s, v) in zip(np.flatnonzero(first), key[first])}
        self.end = dict(zip(self.of, [*np.flatnonzero(first)[1:].tolist(), len(key)]))

    def place(self, size: int, length: int, rank: np.ndarray) -> np.ndarray:
        if length == 0:  # texts without tokens fit anywhere: dealt out in turn
            return rank % max(1, self.containers.get(size, 0))
        part = self.cols[self.of[size, length] : self.end[size, length]]
        i = np.searchsorted(part[:, 2], rank, "right") - 1
        return part[i, 4] + (rank - part[i, 2]) // part[i, 3]


def fill_containers(docs: DataFrame, sizes: DataFrame, *, key: str, text: str, folder: str = TOKENIZERS) -> DataFrame:
    """``(size_id, key, part, n_tokens, container)`` for each row of ``sizes`` (``size_id``, ``tokenizer``, ``capacity``).

    A text of at most ``capacity`` tokens is one part (0) in one container. A longer one is cut into parts of exactly
    ``capacity``, each a container of its own, and what remains over is an ordinary last part. ``container`` counts from
    0 within a ``size_id``.

    - Null and empty texts have one part of 0 tokens and take turns over the containers (container 0 if there are none).
    - Each row is an item of its own, repeated and null keys included. Texts of any length are measured whole.
    - Among equal lengths the order is by a hash group, then by key and part.
    - A row of ``sizes`` with a null field or a capacity below 1 raises ValueError; repeated rows count once; an empty
      ``sizes`` or ``docs`` gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    wanted = [tuple(r) for r in sizes.select("size_id", "tokenizer", "capacity").distinct().limit(MAX_SIZES + 1).collect()]
    if len(wanted) > MAX_SIZES:
        raise ValueError(f"more than {MAX_SIZES} sizes")
    if any(x is None for r in wanted for x in r) or any(r[2] < 1 for r in wanted) or len({r[0] for r in wanted}) < len(wanted):
        raise ValueError("each size needs one id, a tokenizer and a capacity of at least 1")
    kind = docs.schema[key].dataType.simpleString()
    shape = f"size_id int, k {kind}, part int, n_tokens int, container bigint"
    if not wanted:
        return spark.createDataFrame([], shape).withColumnRenamed("k", key)
    measured = None
    for tokenizer in sorted({r[1] for r in wanted}):
        one = token_counts(docs, key=key, text=text, tokenizer=tokenizer, folder=folder).select(F.col(key).alias("k"), "n_tokens", F.lit(tokenizer).alias("tokenizer"))
        measured = one if measured is None else measured.unionByName(one)
    measured = written(measured, "tokens")

    plan = spark.createDataFrame(wanted, "size_id int, tokenizer string, capacity int")
    n, c = F.col("n_tokens"), F.col("capacity")
    last = F.greatest(F.ceil(n / c) - 1, F.lit(0)).cast("int")
    items = measured.join(F.broadcast(plan), "tokenizer").select("size_id", "k", "capacity", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    items = items.select("size_id", "k", "part", F.least(n - F.col("part") * c, c).cast("int").alias("v"))
    # At most capacity + 1 rows a size.
    histogram = written(items.groupBy("size_id", "v").agg(F.count(F.lit(1)).alias("c")), "lengths")
    items = items.join(F.broadcast(histogram.select("size_id", "v", F.ceil(F.col("c") / RANKED).cast("int").alias("salts"))), ["size_id", "v"])
    items = items.withColumn("salt", F.pmod(F.xxhash64("k", "part"), "salts").cast("int"))
    groups = items.groupBy("size_id", "v", "salt").agg(F.count(F.lit(1)).alias("c"))
    lists = histogram.where("v > 0").groupBy("size_id").agg(F.collect_list("v").alias("vs"), F.collect_list("c").alias("cs"))
    lists = lists.join(F.broadcast(plan), "size_id").select("size_id", "capacity", "vs", "cs").repartition(len(wanted), "size_id")
    runs = spark.sparkContext.broadcast(_Runs([tuple(r) for r in lists.mapInArrow(_packed, "size bigint, v bigint, rank bigint, copies bigint, base bigint, times bigint").collect()]))

    before = Window.partitionBy("size_id", "v").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("size_id", "v", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("size_id", "v", "salt").orderBy("k", "part")
    ranked = items.withColumn("r", F.row_number().over(order)).join(offsets, ["size_id", "v", "salt"])
    ranked = ranked.select("size_id", "k", "part", "v", (F.col("r") - 1 + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, v, r = (np.asarray(b.column(i)).astype(np.int64) for i in (0, 3, 4))
            out = np.zeros(len(r), np.int64)
            order = np.lexsort((v, s))
            starts = np.flatnonzero(np.concatenate(([True], (s[order][1:] != s[order][:-1]) | (v[order][1:] != v[order][:-1])))) if len(r) else []
            for i, j in zip(starts, [*starts[1:], len(order)]):
                o = order[i:j]
                out[o] = runs.value.place(int(s[o[0]]), int(v[o[0]]), r[o])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out)], names=["size_id", "k", "part", "n_tokens", "container"])

    return ranked.mapInArrow(place, shape).withColumnRenamed("k", key)


def fill_rates(filled: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(size_id, capacity, n_containers, n_tokens, fill)``; ``least`` containers any packing needs is n_tokens/capacity."""
    per = filled.groupBy("size_id").agg(F.max("container").alias("__m"), F.sum("n_tokens").alias("n_tokens"))
    caps = sizes.select("size_id", "capacity").distinct()
    n = F.col("__m") + 1
    return per.join(caps, "size_id").select("size_id", "capacity", n.alias("n_containers"), "n_tokens", F.round(F.col("n_tokens") / (n * F.col("capacity")), 6).alias("fill"))
