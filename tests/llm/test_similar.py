import numpy as np
import pytest

from millrace.llm.similar import nearest, rotation, scan_list, similar_pairs

SHAPE = "item_id long, vec array<float>"


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = set()
    for a in range(len(ids)):
        best = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]
        out |= {(int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))) for b in best}
    return out


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((12, 64))
    x = (c[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, 64))) * rng.uniform(0.2, 5, (n, 1))
    return rng.permutation(n * 3)[:n].astype(np.int64), x.astype(np.float32)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in zip(ids, x)], SHAPE)


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_recall_and_precision_against_brute_force(spark):
    ids, x = clustered(900)
    want = brute(ids, x.astype(np.float64), 5)
    got = pairs(similar_pairs(frame(spark, ids, x), key="item_id", vec="vec", dim=64))
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97


def test_all_lists_without_abandoning_are_exact(spark):
    ids, x = clustered(300, 1)
    got = pairs(similar_pairs(frame(spark, ids, x), key="item_id", vec="vec", dim=64, probes=10_000, epsilon=1e6))
    assert got == brute(ids, x.astype(np.float64), 5)


def test_split_lists_give_the_same(spark, monkeypatch):
    import millrace.llm.similar as m

    ids, x = clustered(300, 2)
    monkeypatch.setattr(m, "MEMBERS", 7)
    monkeypatch.setattr(m, "QUERIES", 11)
    got = pairs(similar_pairs(frame(spark, ids, x), key="item_id", vec="vec", dim=64, probes=10_000, epsilon=1e6))
    assert got == brute(ids, x.astype(np.float64), 5)


def test_unsound_vectors_take_no_part(spark):
    ids, x = clustered(40, 3)
    rows = [(int(i), [float(y) for y in v]) for i, v in zip(ids, x)]
    bad = [(1000, None), (1001, [0.0] * 64), (1002, [1.0] * 63), (1003, [float("nan")] * 64), (1004, [None] + [1.0] * 63), (1005, []), (1006, [float("inf")] + [1.0] * 63), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad + rows[:5], SHAPE).selectExpr("*", "1 AS id", "2 AS v", "3 AS q", "4 AS near", "5 AS list")
    got = pairs(similar_pairs(df, key="item_id", vec="vec", dim=64, probes=100, epsilon=1e6))
    assert got == brute(ids, x.astype(np.float64), 5)


def test_equal_vectors_tie_by_smaller_id(spark):
    v = np.tile(np.random.default_rng(0).standard_normal(64).astype(np.float32), (9, 1))
    got = {(r["q"], r["id"], r["rank"]) for r in nearest(frame(spark, np.arange(9), v), key="item_id", vec="vec", dim=64, k=2).collect()}
    assert (8, 0, 1) in got and (8, 1, 2) in got and (0, 1, 1) in got and (0, 2, 2) in got and len(got) == 18


def test_few_and_no_vectors(spark):
    assert similar_pairs(spark.createDataFrame([], SHAPE), key="item_id", vec="vec", dim=64).count() == 0
    one = frame(spark, [1], np.ones((1, 64), np.float32))
    assert similar_pairs(one, key="item_id", vec="vec", dim=64).count() == 0
    assert pairs(similar_pairs(frame(spark, [1, 2], np.eye(2, 64, dtype=np.float32)), key="item_id", vec="vec", dim=64)) == {(1, 2)}


def test_scan_abandons_yet_keeps_the_near():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:50]
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    bound = np.sort(d, axis=1)[:, 5]
    t = rotation(64, 1)
    i, j = scan_list(q @ t, x @ t, bound)
    kept = set(zip(i.tolist(), j.tolist()))
    need = {(a, b) for a in range(50) for b in np.argsort(d[a])[:6].tolist()}
    assert len(need & kept) / len(need) > 0.98 and len(kept) < 0.05 * d.size
    assert t @ t.T == pytest.approx(np.eye(64), abs=1e-9)
