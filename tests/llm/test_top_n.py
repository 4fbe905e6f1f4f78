import random
from collections import defaultdict

import pytest

from millrace.llm.top_n import band_edges, top_n_per_group

SHAPE = "g long, i long, s double"


def brute(rows, n):
    by = defaultdict(list)
    for g, i, s in rows:
        if g is not None:
            low = s is None or s != s
            by[g].append((low, 0 if low else -s, 1 if s is None else 0, i is None, i or 0, i, s))
    return sorted((g, k + 1, str(r[5]), str(r[6])) for g, rs in by.items() for k, r in enumerate(sorted(rs, key=lambda r: r[:5])[:n]))


def got(df):
    return sorted((r["g"], r["rank"], str(r["i"]), str(r["s"])) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("n", [1, 5, 10])
def test_equals_brute_force_with_ties_nulls_and_a_hot_group(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(3000):
        g = None if rng.random() < 0.02 else (0 if rng.random() < 0.4 else rng.randint(1, 200))
        s = rng.choice([None, float("nan"), 1.0, 1.0, 1.0, 2.0, 3.0, float(rng.randint(1, 60)), -4.5])
        rows.append((g, None if rng.random() < 0.02 else rng.randint(0, 500), s))
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    assert got(top_n_per_group(df, group="g", item="i", score="s", n=n)) == brute(rows, n)


def test_large_integers_keep_their_order(spark):
    base = 1 << 60
    df = spark.createDataFrame([(1, k, base + k) for k in range(20)], "g long, i long, s long")
    assert [r["i"] for r in top_n_per_group(df, group="g", item="i", score="s", n=3).orderBy("rank").collect()] == [19, 18, 17]


def test_one_value_repeated_rows_and_short_groups(spark):
    rows = [(1, 5, 2.0)] * 4 + [(2, 9, 2.0)]
    df = spark.createDataFrame(rows, SHAPE)
    assert band_edges(df.withColumnRenamed("s", "b"), "b") == []
    assert got(top_n_per_group(df, group="g", item="i", score="s", n=3)) == brute(rows, 3)


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], SHAPE)
    assert top_n_per_group(none, group="g", item="i", score="s").count() == 0
    df = spark.createDataFrame([(1, 2, 3.0)], "user long, item long, score double").selectExpr("*", "1 AS b", "2 AS r", "3 AS band", "4 AS above", "5 AS g")
    out = top_n_per_group(df, group="user", item="item", score="score")
    assert out.columns == ["user", "item", "score", "rank"] and [tuple(r) for r in out.collect()] == [(1, 2, 3.0, 1)]


def test_missing_scores_come_below_minus_infinity(spark):
    rows = [(1, 1, float("nan")), (1, 2, float("-inf")), (1, 3, None), (1, 4, float("inf")), (1, 5, 0.0)]
    df = spark.createDataFrame(rows, SHAPE)
    assert [r["i"] for r in top_n_per_group(df, group="g", item="i", score="s", n=5).orderBy("rank").collect()] == [4, 5, 2, 1, 3]
