import datetime as dt
import random
from collections import defaultdict

import pytest

from millrace.operators.feature_table import dominant_types, expand, feature_state, merge_states, type_index

T0 = dt.datetime(2016, 3, 1)
SHAPE = "user_id bigint, kind int, ts timestamp_ntz, value double, item_id bigint"


def events(n, seed):
    rng = random.Random(seed)
    some = lambda x: None if rng.random() < 0.1 else x
    return [(some(rng.choice([0, 0, 0, 1, 2, 3])), some(rng.randint(0, 6)), some(T0 + dt.timedelta(hours=rng.randint(0, 900))), some(float(rng.randint(0, 9))), rng.randint(0, 3)) for _ in range(n)]


def state_of(spark, rows, dic):
    return feature_state(spark.createDataFrame(rows, SHAPE), dic, entity="user_id", kind="kind", time="ts", value="value", witness="item_id")


def brute(rows, types):
    out = {}
    by = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            by[r[0]].append(r)
    for u, rs in by.items():
        times = [r[2] for r in rs if r[2]]
        last = max(times) if times else None
        vec = []
        for t in types:
            mine = [r for r in rs if r[1] == t]
            seen = [r[2] for r in mine if r[2]]
            vec += [len(mine), sum(r[3] or 0.0 for r in mine), int((last - max(seen)).total_seconds()) if seen else None]
        out[u] = (len(rs), last, *vec)
    return out


@pytest.fixture()
def dic(spark):
    return type_index(spark.createDataFrame([(i,) for i in (4, 2, 0, 1, 3, None, 2)], "kind int"), "kind")


def wide(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_expanded_table_equals_brute_force(spark, dic):
    rows = events(800, 1)
    assert wide(expand(state_of(spark, rows, dic), dic, entity="user_id")) == brute(rows, [0, 1, 2, 3, 4])


def test_states_merge_like_their_events(spark, dic):
    a, b, c = events(300, 2), events(200, 3), events(1, 4)
    merged = merge_states(*(state_of(spark, r, dic) for r in (a, b, c)), entity="user_id")
    whole = state_of(spark, a + b + c, dic)
    key = lambda df: {r["user_id"]: (r["n_all"], r["latest_all"], [tuple(s) for s in r["state"]]) for r in df.collect()}
    assert key(merged) == key(whole)


def test_dominant_types_respect_every_limit(spark, dic):
    h = lambda n: T0 + dt.timedelta(hours=n)
    rows = [(1, 0, h(0), 1.0, i % 2) for i in range(4)] + [(1, 1, h(168), 1.0, 7)] * 5  # type 1 has one witness only
    rows += [(2, 0, h(0), 1.0, i) for i in range(4)] + [(2, None, h(169), 1.0, 1)]  # an hour too late
    rows += [(3, 2, h(0), 1.0, i) for i in range(4)] + [(3, None, h(1), 1.0, 1)] * 17  # less than a fifth
    rows += [(4, 3, h(5), 1.0, i) for i in range(3)]  # too few
    out = dominant_types(state_of(spark, rows, dic), dic, entity="user_id")
    assert [tuple(r) for r in out.collect()] == [(1, 0)]


def test_empty_tables_and_clashing_columns(spark, dic):
    assert state_of(spark, [], dic).count() == 0
    none = type_index(spark.createDataFrame([], "kind int"), "kind")
    rows = spark.createDataFrame(events(50, 5), SHAPE).selectExpr("*", "1 AS idx", "2 AS cnt", "3 AS state", "4 AS latest")
    s = feature_state(rows, none, entity="user_id", kind="kind", time="ts")
    assert all(r["state"] == [] for r in s.collect()) and expand(s, none, entity="user_id").columns == ["user_id", "n_all", "latest_all"]


def test_too_many_types_are_refused(spark):
    with pytest.raises(ValueError):
        type_index(spark.range(11).selectExpr("CAST(id AS INT) AS kind"), "kind", max_types=10)
