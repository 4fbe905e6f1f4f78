"""Sessions by inactivity gap (problem 6).

Events are range-partitioned by (user, time, tie) and sorted within partitions, the secondary sort; one linear scan per
partition then emits sessions while it holds a single open one. Since the ranges cut by the whole order and not by user,
a user with a third of all events is spread over a third of the partitions. A session that crosses a range boundary
shows up as the last of one partition and the first of the next; those at most two fragments a partition are stitched
afterwards, all others are final.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

_OUT = "user bigint, start_us bigint, end_us bigint, n bigint, first_tie bigint, last_tie bigint, edge boolean"
_NAMES = ["user", "start_us", "end_us", "n", "first_tie", "last_tie", "edge"]


def _scan(gap_us: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # user, start, end, n, first tie, last tie
        leading = True  # the partition's first session is an edge

        def made(cols, edge):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols] + [pa.array(edge)], names=_NAMES)

        for b in batches:
            if not b.num_rows:
                continue
            u, t, e = (np.asarray(b.column(i)) for i in range(3))
            new = np.empty(len(u), bool)
            new[1:] = (u[1:] != u[:-1]) | (t[1:] - t[:-1] > gap_us)
            new[0] = open_ is None or u[0] != open_[0] or t[0] - open_[2] > gap_us
            first = np.flatnonzero(new)
            if open_ is not None:  # the open session heads the list, longer by the rows before the first start
                stop = first[0] if len(first) else len(u)
                if stop:
                    open_ = (open_[0], open_[1], t[stop - 1], open_[3] + stop, open_[4], e[stop - 1])
            last = np.append(first[1:], len(u)) - 1 if len(first) else first
            cols = [u[first], t[first], t[last], last - first + 1, e[first], e[last]]
            if open_ is not None:
                cols = [np.concatenate(([o], c)) for o, c in zip(open_, cols)]
            open_ = tuple(c[-1] for c in cols)
            if len(cols[0]) > 1:
                edge = np.zeros(len(cols[0]) - 1, bool)
                edge[0], leading = leading, False
                yield made([c[:-1] for c in cols], edge)
        if open_ is not None:
            yield made([[x] for x in open_], [True])

    return scan


def sessions(events: DataFrame, *, user: str = "user_id", time: str = "ts", tie: str = "event_id", gap_minutes: int = 30) -> DataFrame:
    """One row per session: ``user``, ``start``, ``end``, ``duration_us``, ``n_events``, ``first_<tie>``, ``last_<tie>``.

    A session begins where ``time`` is more than ``gap_minutes`` after the user's previous event in the order (time,
    tie); exactly that far continues it.

    - Rows with a null user, time or tie can't be placed in the order and are left out.
    - Equal times are ordered by ``tie``; fully repeated rows count each.
    - Only the three columns are read, so further columns may have any name. An empty table gives no rows.
    """
    gap_us = int(gap_minutes) * 60_000_000
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    us = F.timestamp_diff("MICROSECOND", epoch, F.col(time).cast("timestamp_ntz"))
    rows = events.select(F.col(user).cast("bigint").alias("u"), us.alias("t"), F.col(tie).cast("bigint").alias("e")).where("u IS NOT NULL AND t IS NOT NULL AND e IS NOT NULL")
    parts = rows.repartitionByRange("u", "t", "e").sortWithinPartitions("u", "t", "e").mapInArrow(_scan(gap_us), _OUT)
    # Stored once: the final sessions and the edge fragments are two readers of one scan.
    found = written(parts, "sessions")
    w = Window.partitionBy("user").orderBy("start_us", "first_tie", "end_us", "last_tie")
    edge = found.where("edge").withColumn("__new", F.coalesce((F.col("start_us") - F.lag("end_us").over(w) > gap_us).cast("int"), F.lit(1)))
    edge = edge.withColumn("__s", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = edge.groupBy("user", "__s").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"),
        F.min(F.struct("start_us", "first_tie"))["first_tie"].alias("first_tie"), F.max(F.struct("end_us", "last_tie"))["last_tie"].alias("last_tie"),
    ).drop("__s")
    out = found.where("NOT edge").drop("edge").unionByName(whole)
    at = lambda c: F.timestamp_add("MICROSECOND", F.col(c), epoch)
    return out.select(
        F.col("user").alias(user), at("start_us").alias("start"), at("end_us").alias("end"), (F.col("end_us") - F.col("start_us")).alias("duration_us"), F.col("n").alias("n_events"),
        F.col("first_tie").alias(f"first_{tie}"), F.col("last_tie").alias(f"last_{tie}"),
    )
