import random

import pytest

from millrace.operators.eager_aggregate import eager_join_aggregate, heavy_keys, key_counts


def rows(df):
    return sorted(map(repr, (tuple(sorted(r.asDict().items())) for r in df.collect())))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("keep", [True, False])
def test_equals_the_plain_join(spark, how, keep):
    rng = random.Random(3)
    some = lambda x: None if rng.random() < 0.1 else x
    a = [(some(0 if rng.random() < 0.5 else rng.randint(1, 9)), some(rng.choice("ab")), some(rng.randint(0, 5))) for _ in range(400)]
    b = [(some(rng.randint(0, 6)), some(rng.choice("xy")), some(rng.randint(0, 5))) for _ in range(60)]
    spark.createDataFrame(a, "k int, g string, x long").createOrReplaceTempView("a")
    spark.createDataFrame(b, "k int, h string, y long").createOrReplaceTempView("b")
    got = eager_join_aggregate(
        spark.table("a").selectExpr("*", "1 AS h", "2 AS y"), spark.table("b").selectExpr("*", "1 AS g", "2 AS __na"), ["k"],
        left_groups=["g"], right_groups=["h"], left_sums={"sx": "x"}, right_sums={"sy": "y"}, keep_key=keep, how=how,
    )
    key = "a.k, " if keep else ""
    want = spark.sql(f"SELECT {key} g, h, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM a {how} JOIN b ON a.k = b.k GROUP BY {key} g, h")
    assert rows(got) == rows(want)


def test_compact_states_are_all_that_is_joined(spark):
    a = spark.range(1000).selectExpr("0 AS k", "id AS x")
    got = eager_join_aggregate(a, a.selectExpr("k", "x AS y"), ["k"], left_sums={"sx": "x"}, right_sums={"sy": "y"})
    assert [tuple(r) for r in got.collect()] == [(0, 1_000_000, 499500 * 1000, 499500 * 1000)]


def test_bad_names_and_empty_inputs(spark):
    a = spark.createDataFrame([], "k int, g string")
    with pytest.raises(ValueError):
        eager_join_aggregate(a, a, ["k"], left_groups=["g"], right_groups=["g"])
    assert eager_join_aggregate(a, a, ["k"], left_groups=["g"]).count() == 0


def test_key_counts_and_heavy_keys(spark):
    events = spark.createDataFrame([(1, 10)] * 60 + [(2, 11)] + [(3, 12 + i) for i in range(39)] + [(None, 7)], "user_id long, item_id long")
    dims = {"user_id": spark.createDataFrame([(1,), (1,), (None,)], "user_id long"), "item_id": spark.createDataFrame([(10, 1)], "item_id long, user_id long")}
    counts = key_counts(events, dims)
    by = {(r[0], r[1]): (r[2], r[3]) for r in counts.collect()}
    assert by["user_id", 1] == (60, True) and by["user_id", 3] == (39, False) and by["item_id", 10] == (60, True) and len(by) == 3 + 42
    assert sorted((r[0], r[1]) for r in heavy_keys(counts).collect()) == [("item_id", 10), ("user_id", 1), ("user_id", 3)]
    # exactly one fiftieth is heavy
    exact = spark.createDataFrame([("f", 1, 2, True), ("f", 2, 98, True)], "key_field string, key_id long, n long, known boolean")
    assert sorted(r[1] for r in heavy_keys(exact).collect()) == [1, 2]
