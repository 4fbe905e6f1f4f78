import datetime as dt
import random

import pytest

from millrace.operators.sessions import sessions

T0 = dt.datetime(2016, 3, 1)
SHAPE = "user_id bigint, ts timestamp_ntz, event_id bigint"


def brute(rows, gap):
    out, by = [], {}
    for u, t, e in rows:
        if None not in (u, t, e):
            by.setdefault(u, []).append((t, e))
    for u, events in by.items():
        events.sort()
        run = [events[0]]
        for x in events[1:] + [None]:
            if x is None or x[0] - run[-1][0] > dt.timedelta(minutes=gap):
                out.append((u, run[0][0], run[-1][0], int((run[-1][0] - run[0][0]) / dt.timedelta(microseconds=1)), len(run), run[0][1], run[-1][1]))
                run = []
            run.append(x)
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("user_id", "start", "end", "duration_us", "n_events", "first_event_id", "last_event_id")) for r in df.collect())


@pytest.mark.parametrize("partitions", [1, 4, 7])
def test_random_users_with_one_hot_user_equal_brute_force(spark, partitions):
    rng = random.Random(partitions)
    rows = [(0 if rng.random() < 0.5 else rng.randint(1, 20), T0 + dt.timedelta(minutes=rng.randint(0, 4000) * 3), e) for e in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert got(sessions(spark.createDataFrame(rows, SHAPE))) == brute(rows, 30)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_session_over_all_partitions_is_stitched(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(1, T0 + dt.timedelta(minutes=29 * i), i) for i in range(500)] + [(2, T0, 1000)]
        assert got(sessions(spark.createDataFrame(rows, SHAPE))) == brute(rows, 30)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_exactly_the_gap_continues_and_ties_follow_the_event(spark):
    m = dt.timedelta(minutes=30)
    rows = [(1, T0, 5), (1, T0, 3), (1, T0 + m, 9), (1, T0 + 2 * m + dt.timedelta(microseconds=1), 1)]
    assert got(sessions(spark.createDataFrame(rows, SHAPE))) == [
        (1, T0, T0 + m, 1_800_000_000, 3, 3, 9),
        (1, rows[3][1], rows[3][1], 0, 1, 1, 1),
    ]


def test_nulls_repeated_rows_extra_columns_and_no_rows(spark):
    rows = [(None, T0, 1), (1, None, 2), (1, T0, None), (1, T0, 4), (1, T0, 4)]
    df = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS user", "2 AS edge", "'x' AS start_us", "3 AS n")
    assert got(sessions(df)) == [(1, T0, T0, 0, 2, 4, 4)]
    assert got(sessions(spark.createDataFrame([], SHAPE))) == []
