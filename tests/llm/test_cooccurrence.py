import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from millrace.llm.cooccurrence import cooccurrence

SHAPE = "u long, i long"


def brute(rows, min_pair, lift):
    baskets = defaultdict(set)
    for u, i in rows:
        if u is not None and i is not None:
            baskets[u].add(i)
    n, single, pair = len(baskets), Counter(), Counter()
    for b in baskets.values():
        single.update(b)
        pair.update(combinations(sorted(b), 2))
    return {(a, b, k, single[a], single[b], n) for (a, b), k in pair.items() if k >= min_pair and k * n >= lift * single[a] * single[b]}


def got(df):
    return {tuple(r[c] for c in ("item_id_a", "item_id_b", "n_ab", "n_a", "n_b", "n_baskets")) for r in df.collect()}


def log(seed, users=300, items=120):
    rng = random.Random(seed)
    rows = []
    for u in range(users):
        home = rng.randrange(12)
        for _ in range(rng.randint(1, 9)):
            rows.append((u, home * 10 + rng.randrange(10) if rng.random() < 0.8 else rng.randrange(items)))
    for big in range(8):  # huge baskets
        rows += [(1000 + big, i) for i in range(items) if (i + big) % 3]
    rows += [(None, 1), (5, None)] + rows[:50]
    return rows


@pytest.mark.parametrize("huge", [4, 30, 10_000])
@pytest.mark.parametrize("chunk", [7, 1024])
def test_equals_brute_force_with_baskets_split_anywhere(spark, huge, chunk):
    rows = log(huge)
    df = spark.createDataFrame(rows, SHAPE).repartition(3).selectExpr("*", "1 AS codes", "2 AS cell", "3 AS n_i", "4 AS c", "5 AS code")
    for min_pair, lift in ((6, 4), (2, 1)):
        assert got(cooccurrence(df, basket="u", item="i", min_pair=min_pair, lift=lift, huge=huge, chunk=chunk)) == brute(rows, min_pair, lift)


def test_pairs_of_huge_baskets_alone_are_found(spark):
    rows = [(u, i) for u in range(6) for i in range(40)] + [(u, 1000 + u) for u in range(100, 400)]
    assert got(cooccurrence(spark.createDataFrame(rows, SHAPE), basket="u", item="i", huge=10, chunk=8)) == brute(rows, 6, 4)


def test_negative_and_large_ids_strings_as_baskets_and_no_rows(spark):
    rows = [(u, i) for u in range(7) for i in (-5, 1 << 60)] + [(u, u) for u in range(10, 50)]
    df = spark.createDataFrame(rows, SHAPE).selectExpr("CAST(u AS STRING) AS u", "i")
    assert got(cooccurrence(df, basket="u", item="i", huge=1)) == brute(rows, 6, 4)
    assert cooccurrence(spark.createDataFrame([], SHAPE), basket="u", item="i").count() == 0
    assert cooccurrence(spark.createDataFrame([(1, 1)], SHAPE), basket="u", item="i").count() == 0


def test_one_basket_of_very_many_chunks_comes_out_of_many_keys(spark, monkeypatch):
    import millrace.llm.cooccurrence as m

    monkeypatch.setattr(m, "SLICE", 2)
    rng = random.Random(8)
    baskets = {1: set(range(400)), 2: set(range(0, 400, 2)), 3: set(range(0, 400, 3))} | {10 + u: {rng.randint(0, 399) for _ in range(4)} for u in range(3000)}
    rows = [(u, i) for u, items in baskets.items() for i in items]
    df = spark.createDataFrame(rows, "user_id long, item_id long").repartition(4)
    count = Counter(p for items in baskets.values() for p in combinations(sorted(items), 2))
    n_i, n = Counter(i for items in baskets.values() for i in items), len(baskets)
    want = {(a, b, k) for (a, b), k in count.items() if k >= 2 and k * n >= 4 * n_i[a] * n_i[b]}
    got = {(r[0], r[1], r[2]) for r in cooccurrence(df, basket="user_id", item="item_id", min_pair=2, huge=50, chunk=10).collect()}
    assert got == want and want
