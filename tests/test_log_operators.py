"""Split, statistics, metrics, baselines, hashing and ranking on hand-made and generated logs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.hashing import with_uniforms
from millrace.operators import baselines, metrics, stats
from millrace.operators.ranking import exact_quantile, row_numbers
from millrace.operators.split import Split, leak_check, temporal_split
from millrace.schema import counted_events
from millrace.sources.datasource import register, uniforms
from millrace.sources.generator import Catalogue, GeneratorConfig, generate


def test_quantile_equals_numpy(spark):
    rng = np.random.default_rng(0)
    for values in ([1.0], [3.0, 1.0], rng.normal(size=1001), rng.integers(0, 4, 500).astype(float), np.r_[np.zeros(90), 1e12, -5.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "ts double")
        for q in (0.0, 0.3, 0.8, 1.0):
            assert exact_quantile(df, "ts", q) == pytest.approx(float(np.quantile(values, q)), rel=1e-12, abs=1e-12)
    assert exact_quantile(spark.createDataFrame([], "ts double"), "ts", 0.5) is None


def test_row_numbers(spark):
    df = spark.range(500).selectExpr("id", "id % 7 AS v").repartition(5)
    got = {r["id"]: r["r"] for r in row_numbers(df, [F.desc("v"), F.asc("id")], "r").collect()}
    want = {i: k + 1 for k, i in enumerate(sorted(range(500), key=lambda i: (-(i % 7), i)))}
    assert got == want
    assert row_numbers(df.where("id < 0"), [F.asc("id")], "r").count() == 0


def test_hashed_uniforms_equal_numpy_and_are_spread(spark):
    got = [r["x"] for r in with_uniforms(spark.range(2000), F.col("id"), {"x": 3}, 42).orderBy("id").collect()]
    assert got == uniforms(np.arange(2000), 3, 42).tolist()
    assert abs(np.mean(got) - 0.5) < 0.02 and min(got) >= 0 and max(got) < 1


def toy(spark):
    rng = random.Random(5)
    rows = [(e, rng.randint(0, 20), rng.randint(0, 30), float(rng.randint(0, 100))) for e in range(1500)]
    return rows, spark.createDataFrame(rows, "event_id long, user_id long, item_id long, ts double")


def test_split_matches_sets(spark):
    rows, log = toy(spark)
    s = temporal_split(log)
    thr = float(np.quantile([r[3] for r in rows], 0.8))
    hist = {(r[1], r[2]) for r in rows if r[3] < thr}
    users = {u for u, _ in hist}
    gt = {(r[1], r[2]) for r in rows if r[3] >= thr and r[1] in users} - hist
    assert s.threshold == thr and {tuple(r) for r in s.history.collect()} == hist and {tuple(r) for r in s.ground_truth.collect()} == gt
    assert leak_check(s).head()["ok"]
    with pytest.raises(ValueError):
        temporal_split(log.limit(0))


def test_statistics(spark):
    rows, log = toy(spark)
    items = spark.createDataFrame([(i, i % 4) for i in range(35)], "item_id long, category int")
    s = temporal_split(log)
    train = [r for r in rows if r[3] < s.threshold]
    st = {r["item_id"]: r for r in stats.item_stats(s.train, items).collect()}
    assert len(st) == 35 and abs(sum(r["prob"] for r in st.values()) - 1) < 1e-9 and st[34]["n"] == 0 and st[34]["mean_ts"] == 0.0
    assert st[3]["n"] == sum(r[2] == 3 for r in train) and st[3]["selfinfo"] == pytest.approx(-math.log2(st[3]["prob"]))
    us = {r["user_id"]: r for r in stats.user_stats(s.train, items, spark.range(25).withColumnRenamed("id", "user_id")).collect()}
    assert us[24]["n"] == 0 and us[24]["dom_cat"] is None
    n = [sum(r[1] == 2 and r[2] % 4 == c for r in train) for c in range(4)]
    assert us[2]["dom_cat"] == n.index(max(n))
    order = [r["item_id"] for r in stats.popularity_ranking(stats.item_stats(s.train, items)).orderBy("pop_rank").collect()]
    assert order == sorted(range(35), key=lambda i: (-st[i]["n"], i))


def test_popularity_and_random_recommendations(spark):
    rows, log = toy(spark)
    items = spark.createDataFrame([(i, 0) for i in range(35)], "item_id long, category int")
    s = temporal_split(log)
    ranking = stats.popularity_ranking(stats.item_stats(s.train, items))
    order = [r["item_id"] for r in ranking.orderBy("pop_rank").collect()]
    hist = {tuple(r) for r in s.history.collect()}
    got = {}
    for r in baselines.popularity_recs(s, ranking, 5).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["item_id"])
    assert got == {r[0]: [i for i in order if (r[0], i) not in hist][:5] for r in s.eval_users.collect()}
    rnd = baselines.random_recs(s, 35, 5).collect()
    assert not {(r["user_id"], r["item_id"]) for r in rnd} & hist and len({(r["user_id"], r["item_id"]) for r in rnd}) == len(rnd)


def test_metrics_by_hand(spark):
    assert metrics.idcg_values(2)[1] == pytest.approx(1 + 1 / math.log2(3), abs=1e-12)
    gt = spark.createDataFrame([(1, 10), (1, 20), (2, 7)], "user_id long, item_id long")
    recs = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 5)], "user_id long, rank int, item_id long")
    by = {r["user_id"]: r for r in metrics.per_user(recs, gt, 5).collect()}
    assert by[1]["ndcg"] == pytest.approx(1.0) and by[1]["recall"] == 1.0 and by[2]["recall"] == 0.0 and by[2]["ndcg"] == 0.0


def test_random_recommendations_are_complete_for_users_who_saw_nearly_everything(spark):
    n, k = 10_000, 20
    saw = {1: n - 100, 2: n - 7, 3: n, 4: 0, 5: n // 2}
    history = spark.createDataFrame([(u, i) for u, m in saw.items() for i in range(1, m + 1)], "user_id long, item_id long")
    gt = spark.createDataFrame([(u, n) for u in saw], "user_id long, item_id long")
    rnd = [tuple(r) for r in baselines.random_recs(Split(0.0, None, None, history, gt), n, k, 42, first_item=1).collect()]
    for u, m in saw.items():
        own = sorted((rank, item) for user, rank, item in rnd if user == u)
        assert [rank for rank, _ in own] == list(range(1, min(k, n - m) + 1)) and len({i for _, i in own}) == len(own) and all(m < i <= n for _, i in own)


@pytest.mark.parametrize("partitions", [1, 4, 7])
def test_generated_log_ignores_partitions(spark, partitions):
    cfg = GeneratorConfig(n_users=500, n_items=200, seed=7)
    got = generate(spark, 3000, cfg, partitions=partitions).orderBy("event_id").toPandas()
    want = generate(spark, 3000, cfg, partitions=2).orderBy("event_id").toPandas()
    assert got.equals(want) and got["ts"].is_monotonic_increasing and got["ts"].between(0, 1, inclusive="left").all()


def test_generated_log_has_its_properties(spark):
    cfg = GeneratorConfig(n_users=800, n_items=300, n_categories=8, seed=9)
    log = generate(spark, 60_000, cfg).toPandas()
    primary = {r["user_id"]: r["primary_cat"] for r in Catalogue(cfg).users(spark).collect()}
    assert (log["user_id"].map(primary) == log["category"]).mean() > 0.7
    counts = log["item_id"].value_counts()
    assert counts.head(30).sum() / len(log) > 0.35
    a, b = (log[m]["category"].value_counts(normalize=True) for m in (log["ts"] < 0.2, log["ts"] >= 0.8))
    assert (a.sub(b, fill_value=0)).abs().sum() > 0.05


def test_data_source_gives_the_same_log(spark):
    register(spark)
    opts = {"rows": "2000", "n_users": "100", "n_items": "50", "n_categories": "5", "seed": "3"}
    got = spark.read.format("millrace_events").options(**opts, partitions="3").load().orderBy("event_id").toPandas()
    want = generate(spark, 2000, GeneratorConfig(n_users=100, n_items=50, n_categories=5, seed=3)).orderBy("event_id").toPandas()
    assert got.equals(want[got.columns])


def test_counted_events_keep_the_earliest_delivery(spark):
    rows = [(1, 5, 6, "2016-01-02", 9, "2016-01-05"), (1, 5, 6, "2016-01-02", 3, "2016-01-03"), (2, -1, 6, "2016-01-02", 1, "2016-01-03"), (3, 5, None, "2016-01-02", 1, "2016-01-03"), (4, 5, 6, None, 1, "2016-01-03"), (5, 5, 7, "2016-01-02", None, None)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, item_id long, a string, category int, b string").selectExpr("event_id", "user_id", "item_id", "CAST(a AS TIMESTAMP_NTZ) AS ts", "category", "CAST(b AS TIMESTAMP_NTZ) AS received_at")
    got = sorted((r["event_id"], r["user_id"], r["item_id"], r["category"]) for r in counted_events(df, category=True).collect())
    assert got == [(1, 5, 6, 3), (5, 5, 7, None)]


def test_written_tables_are_dropped(spark):
    from millrace.session import drop_written, scope, written

    df = written(spark.range(5).selectExpr("id", "id % 2 AS odd"), "some", "odd")
    assert df.count() == 5 and df.where("odd = 1").count() == 2
    with scope(spark):
        inner = written(spark.range(3), "inner")
        assert inner.count() == 3
    spark.catalog.clearCache()
    with pytest.raises(Exception):  # noqa: B017
        inner.count()
    assert df.count() == 5 and drop_written(spark) >= 1 and drop_written(spark) == 0
    spark.catalog.clearCache()
    with pytest.raises(Exception):  # noqa: B017
        df.count()


def test_a_restarted_stream_goes_on_where_it_stopped(spark, tmp_path):
    register(spark)
    for rows in (300, 700):
        s = spark.readStream.format("millrace_events").options(rows=rows, chunk=100, n_users=20, n_items=10, n_categories=3).load().select("event_id")
        s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
        assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(rows))
