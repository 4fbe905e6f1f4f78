import random
from collections import Counter, defaultdict
from itertools import product

import pytest

from millrace.llm.packing import fill_containers, fill_one, fill_rates, min_slack_runs


def first_fit_decreasing(counts, cap):
    """The usual heuristic, to compare with."""
    free = []
    for v in sorted(Counter(counts).elements(), reverse=True):
        at = next((i for i, f in enumerate(free) if f >= v), None)
        if at is None:
            free.append(cap - v)
        else:
            free[at] -= v
    return len(free)


SIZES = "size_id int, tokenizer string, capacity int"


@pytest.mark.parametrize("seed", range(30))
def test_one_container_is_filled_as_well_as_any_multiset_can(seed):
    rng = random.Random(seed)
    cap = rng.randint(5, 40)
    counts = {v: rng.randint(1, 3) for v in rng.sample(range(1, cap + 1), min(cap, 5))}
    lengths = sorted(counts, reverse=True)
    used = dict(fill_one(lengths, counts, cap))
    assert used[lengths[0]] >= 1 and all(k <= counts[v] for v, k in used.items())
    options = product(*(range(counts[v] + 1) for v in lengths))
    best = max(s for o in options if o[0] >= 1 and (s := sum(v * k for v, k in zip(lengths, o))) <= cap)
    assert sum(v * k for v, k in used.items()) == best


@pytest.mark.parametrize("seed", range(5))
def test_runs_use_up_all_lengths(seed):
    rng = random.Random(seed)
    cap = 512
    counts = Counter(min(cap, int(rng.expovariate(1 / 90)) + 1) for _ in range(20_000))
    runs = min_slack_runs(dict(counts), cap)
    back = Counter()
    for times, used in runs:
        assert sum(v * k for v, k in used) <= cap
        for v, k in used:
            back[v] += times * k
    assert back == counts
    least = -(-sum(v * n for v, n in counts.items()) // cap)
    assert sum(t for t, _ in runs) <= least * 1.01 + 1 and len(runs) <= 5 * cap
    with pytest.raises(ValueError):
        min_slack_runs({cap + 1: 1}, cap)


def test_documents_fill_their_containers(spark):
    rng = random.Random(1)
    rows = [(i, " word" * rng.choice([1, 3, 3, 3, 7, 40, 90])) for i in range(400)] + [(400, None), (401, ""), (402, " word" * 1234), (7, " word" * 5), (None, " word" * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "1 AS v", "2 AS salt", "3 AS size_id", "4 AS part")
    sizes = spark.createDataFrame([(1, "byte_bpe_50k", 64), (2, "byte_bpe_50k", 500), (2, "byte_bpe_50k", 500)], SIZES)
    out = fill_containers(docs, sizes, key="doc_id", text="text").collect()
    for s, cap in ((1, 64), (2, 500)):
        mine = [r for r in out if r["size_id"] == s]
        load, parts = Counter(), defaultdict(list)
        for r in mine:
            load[r["container"]] += r["n_tokens"]
            parts[r["doc_id"]].append((r["part"], r["n_tokens"]))
        want = Counter()
        for k, t in rows:
            want[k] += len((t or "").split())
        assert {k: sum(n for _, n in p) for k, p in parts.items()} == want
        assert max(load.values()) <= cap and set(load) == set(range(max(load) + 1))
        big = sorted(parts[402])
        assert [p for p, _ in big] == list(range(-(-1234 // cap))) and all(n == cap for _, n in big[:-1])
        assert all(len(p) == 1 for k, p in parts.items() if k not in (402, 7) and want[k] <= cap)
        # Items of 40 can't share 64, so the sum alone is no bound; first fit is what to match.
        assert len(load) <= first_fit_decreasing(Counter(r["n_tokens"] for r in mine if r["n_tokens"]), cap)
    rates = {r["size_id"]: r for r in fill_rates(spark.createDataFrame(out), sizes).collect()}
    assert rates[1]["capacity"] == 64 and rates[1]["fill"] == pytest.approx(rates[1]["n_tokens"] / 64 / rates[1]["n_containers"], abs=1e-6)


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    sizes = spark.createDataFrame([(1, "byte_bpe_50k", 8)], SIZES)
    assert fill_containers(docs.where("false"), sizes, key="doc_id", text="text").count() == 0
    assert fill_containers(docs, sizes.where("false"), key="doc_id", text="text").count() == 0
    only_empty = fill_containers(docs.where("doc_id = 2"), sizes, key="doc_id", text="text").collect()
    assert [(r["n_tokens"], r["container"]) for r in only_empty] == [(0, 0)]
    for bad in ([(None, "byte_bpe_50k", 8)], [(1, None, 8)], [(1, "byte_bpe_50k", 0)], [(1, "byte_bpe_50k", 8), (1, "byte_bpe_50k", 9)]):
        with pytest.raises(ValueError):
            fill_containers(docs, spark.createDataFrame(bad, SIZES), key="doc_id", text="text")
