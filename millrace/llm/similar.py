"""Most similar vectors for every vector: inverted lists with an adaptive dimension scan (problem 2).

Vectors are scaled to unit length and turned by a random rotation, so that any leading block of columns is a fair sample
of a distance. Centroids are fitted in two levels on a bounded sample; every vector is put into its nearest list. How many
lists a query probes is measured, not set: for a bounded sample of queries the true neighbours are found by comparing with
all vectors, and the probes are as many as it takes to hold the wanted share of them. Lists whose radius shows that they
hold nothing near enough are skipped. Lists of one coarse centroid form blocks, and a query travels once to each block with
the lists it asks there. Within a probed list the distances grow block of columns by block of columns, and after each a
hypothesis test gives up the candidates whose partial distance already shows, at the chosen confidence, that they lie beyond
the query's k-th best. What survives is compared exactly, in double precision on the vectors as given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

#: Rows per list that the centroids are fitted on, and rows at most; every row is indexed whatever this is.
FIT_PER_LIST, FIT_ROWS = 32, 131_072
#: Lists at most, so that the broadcast centroids stay bounded (16,384 x dimensions doubles).
MAX_LISTS = 16_384
#: Queries whose true neighbours decide the number of probes, and the share of these neighbours to be held.
MEASURED, TARGET = 512, 0.9995
#: More probes than measured, by this factor, since the sample may miss the rarest.
SPARE = 1.5
#: Members of a block of lists and queries in it that one task compares; larger ones are split by a hash.
MEMBERS, QUERIES = 8192, 32_768
#: Pairs that are compared exactly at a time.
EXACT = 100_000
#: Confidence of the test: a candidate goes if its scaled partial distance exceeds the bound by a factor 1 + EPSILON/sqrt(d).
EPSILON = 2.1
#: Columns added per step.
BLOCK = 16


def sound(vectors: DataFrame, *, key: str, vec: str, dim: int) -> DataFrame:
    """``(id, v)``, one row per id: vectors that are not null, have ``dim`` numbers, no null, NaN or infinity, and are
    not all zero. A null id is left out; of an id's different sound vectors the smallest (as an array) is taken."""
    # Single-precision vectors stay so where they are stored and sent; all arithmetic is in double precision.
    kind = "array<float>" if vectors.schema[vec].dataType.simpleString() == "array<float>" else "array<double>"
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast(kind).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where((F.size("v") == dim) & ~bad & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _rows(batch_col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(batch_col.flatten(), np.float64).reshape(-1, dim)


def _kmeans(sample: np.ndarray, lists: int, rng: np.random.Generator, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means on unit vectors, and each one's centroid; an emptied centroid restarts at the worst-placed vector."""
    c = sample[rng.choice(len(sample), lists, replace=False)]
    near, sim = np.empty(len(sample), np.int64), np.empty(len(sample))
    for r in range(rounds + 1):
        for s in range(0, len(sample), 4096):
            d = sample[s : s + 4096] @ c.T
            near[s : s + 4096], sim[s : s + 4096] = d.argmax(1), d.max(1)
        if r == rounds:
            return c, near
        order = np.argsort(near, kind="stable")
        ends = np.searchsorted(near[order], np.arange(lists + 1))
        sums = np.add.reduceat(np.vstack([sample[order], np.zeros(sample.shape[1])]), np.minimum(ends[:-1], len(sample)), axis=0)
        empty = np.flatnonzero(ends[1:] == ends[:-1])
        if len(empty):
            sums[empty] = sample[np.argsort(sim)[: len(empty)]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    raise AssertionError


def _fit(sample: np.ndarray, lists: int, seed: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids in two levels, and the coarse one each belongs to: about the root of ``lists`` coarse ones, each divided
    into lists by its share of the sample."""
    rng = np.random.default_rng(seed)
    _, coarse = _kmeans(sample, max(1, round(math.sqrt(lists))), rng, rounds)
    fine, of = [], []
    for c in np.unique(coarse):
        part = sample[coarse == c]
        n = min(len(part), max(1, round(lists * len(part) / len(sample))))
        fine.append(_kmeans(part, n, rng, rounds)[0])
        of += [c] * n
    return np.concatenate(fine), np.array(of)


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scan_list(q: np.ndarray, x: np.ndarray, bound: np.ndarray, epsilon: float = EPSILON, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (query row, member row) that no test gave up. ``bound`` is each query's squared distance to beat."""
    dim = q.shape[1]
    d = min(block, dim)
    # The first block is dense for all pairs, then only survivors are extended.
    part = (q[:, :d] ** 2).sum(1)[:, None] + (x[:, :d] ** 2).sum(1)[None, :] - 2 * (q[:, :d] @ x[:, :d].T)
    factor = lambda d: d / dim * (1 + epsilon / math.sqrt(d)) ** 2 if d < dim else 1.0
    # 1e-5 keeps what would tie after rounding the cosine to 6 decimals (squared distance = 2 - 2 cos).
    keep = part <= ((bound + 1e-5) * factor(d))[:, None]
    i, j = np.nonzero(keep)
    p = part[i, j]
    while d < dim and len(i):
        e = min(d + block, dim)
        p = p + ((q[i, d:e] - x[j, d:e]) ** 2).sum(1)
        ok = p <= (bound[i] + 1e-5) * factor(e)
        i, j, p, d = i[ok], j[ok], p[ok], e
    return i, j


def _best(qi: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best: rounded similarity descending, id ascending."""
    order = np.lexsort((ids, -sim, qi))
    first = np.concatenate(([True], qi[order][1:] != qi[order][:-1])) if len(order) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def _block(dim: int, k: int, turn: np.ndarray, epsilon: float):
    """Queries against the members of the lists they ask for in a block: each query's k best within it."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        shape = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("sim", pa.float64())])
        if not queries.num_rows or not members.num_rows:
            return shape.empty_table()
        qid, xid = queries.column("qid").to_numpy(), members.column("mid").to_numpy()
        qv, xv = _rows(queries.column("qv").combine_chunks(), dim), _rows(members.column("mv").combine_chunks(), dim)
        qn, xn = qv / np.linalg.norm(qv, axis=1, keepdims=True), xv / np.linalg.norm(xv, axis=1, keepdims=True)
        bound = queries.column("bound").to_numpy().copy()
        asks = queries.column("lists").combine_chunks()
        who, what = np.repeat(np.arange(len(qid)), np.diff(np.asarray(asks.offsets))), np.asarray(asks.flatten())
        held = members.column("list").to_numpy()
        qr, xr = qn @ turn, xn @ turn
        got = none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for a in np.unique(held):
            asking, inside = np.sort(who[what == a]), np.flatnonzero(held == a)
            found = [got]
            for t in range(0, len(asking), 2048):
                q = asking[t : t + 2048]
                best = none
                # Members in slices: each one tightens the bound for the next.
                for s in range(0, len(inside), 512):
                    x = inside[s : s + 512]
                    i, j = scan_list(qr[q], xr[x], bound[q], epsilon)
                    other = qid[q[i]] != xid[x[j]]
                    i, j = i[other], x[j[other]]
                    if not len(i):
                        continue
                    cos = [np.einsum("ij,ij->i", qn[q[i[e : e + EXACT]]], xn[j[e : e + EXACT]]) for e in range(0, len(i), EXACT)]
                    i, y, c = (np.concatenate(z) for z in zip(best, (i, xid[j], np.round(np.concatenate(cos), 6))))
                    b = _best(i, y, c, k)
                    best = i[b], y[b], c[b]
                    full = np.bincount(best[0], minlength=len(q)) >= k
                    worst = np.full(len(q), 2.0)
                    np.minimum.at(worst, best[0], best[2])
                    bound[q[full]] = np.minimum(bound[q[full]], 2 - 2 * worst[full])
                found.append((q[best[0]], best[1], best[2]))
            i, y, c = (np.concatenate(z) for z in zip(*found))
            b = _best(i, y, c, k)
            got = i[b], y[b], c[b]
        return pa.table([qid[got[0]], got[1], got[2]], schema=shape)

    return run


def probes_needed(base: DataFrame, queries: tuple[np.ndarray, np.ndarray], shared, *, dim: int, k: int, target: float) -> int:
    """Lists that the sample ``queries`` (ids, unit vectors) must probe, nearest first, to hold the share ``target`` of
    their ``k`` true neighbours. One pass over all vectors; a task keeps ``k`` rows a query."""
    ids, q = queries
    asked = base.sparkSession.sparkContext.broadcast((ids, q))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = asked.value
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty((0, dim)))
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                xid, x = part.column(0).to_numpy(), _rows(part.column(1), dim)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                sim = q @ x.T
                sim[ids[:, None] == xid[None, :]] = -2
                m = min(k, len(xid))
                top = np.argpartition(-sim, m - 1, axis=1)[:, :m].ravel()
                i = np.repeat(np.arange(len(ids)), m)
                real = sim[i, top] > -2
                i, top = i[real], top[real]
                i, y, c, v = (np.concatenate(z) for z in zip(best, (i, xid[top], sim[i, top], x[top])))
                keep = _best(i, y, c, k)
                best = i[keep], y[keep], c[keep], v[keep]
        if len(best[0]):
            home = (best[3] @ shared.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2]), pa.array(home)], names=["q", "id", "sim", "list"])

    near = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    found = base.mapInArrow(scan, "q bigint, id bigint, sim double, list bigint").withColumn("r", F.row_number().over(near)).where(F.col("r") <= k)
    got = found.select("q", "list").toArrow()  # at most k rows a query
    if not got.num_rows:
        return 1
    order = np.argsort(np.argsort(-(q @ shared.value.T), axis=1, kind="stable"), axis=1, kind="stable")
    ranks = np.sort(order[got.column("q").to_numpy(), got.column("list").to_numpy()])
    return int(ranks[min(len(ranks), math.ceil(target * len(ranks))) - 1]) + 1


def nearest(
    vectors: DataFrame, *, key: str, vec: str, dim: int, k: int = 5, probes: int | None = None, per_list: float = 1.0, target: float = TARGET, epsilon: float = EPSILON, seed: int = 11
) -> DataFrame:
    """``(q, id, sim, rank)``: for every sound vector its ``k`` most similar others, by cosine in double precision rounded
    to 6 decimals, ties by smaller id. Approximate only in that unprobed lists and wrongly abandoned candidates can miss:
    of about ``per_list * sqrt(n)`` lists as many are probed as hold the share ``target`` of the true neighbours of
    ``MEASURED`` queries, or ``probes`` where given.

    Unsound and null vectors take no part, see ``sound``. Repeated rows count once, equal vectors of different ids are
    similar with 1.0. Fewer than ``k`` other vectors give all of them. An empty table gives no rows. Extra columns are
    not read.
    """
    spark = vectors.sparkSession
    out_shape = "q bigint, id bigint, sim double, rank int"
    base = written(sound(vectors, key=key, vec=vec, dim=dim), "vectors")
    n = base.count()
    if n == 0:
        return spark.createDataFrame([], out_shape)
    lists = int(min(MAX_LISTS, max(1, round(per_list * math.sqrt(n))), n))
    # The fit sees the rows with the smallest hashes: a bounded uniform sample, the same on every run.
    sample = base.orderBy(F.xxhash64("id", F.lit(seed))).limit(min(FIT_ROWS, max(MEASURED, FIT_PER_LIST * lists))).toArrow()
    s = _rows(sample.column("v").combine_chunks(), dim)
    s = s / np.linalg.norm(s, axis=1, keepdims=True)
    centroids, coarse = _fit(s, min(lists, len(s)), seed)
    lists = len(centroids)
    shared = spark.sparkContext.broadcast(centroids)
    if probes is None:
        probes = math.ceil(SPARE * probes_needed(base, (sample.column("id").to_numpy()[:MEASURED], s[:MEASURED]), shared, dim=dim, k=k, target=target))
    probes = min(probes, lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                v = _rows(b.column(1), dim)
                d = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ c.T
                near = np.argpartition(-d, probes - 1, axis=1)[:, :probes]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1).astype(np.int32)
                gap = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(d, near, 1), 0)).astype(np.float32)  # distances to those centroids
                off = pa.array(np.arange(0, near.size + 1, probes, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.ListArray.from_arrays(off, pa.array(x.ravel())) for x in (near, gap))], names=["id", "v", "near", "gap"])

    placed = written(base.mapInArrow(assign, f"id bigint, v {base.schema['v'].dataType.simpleString()}, near array<int>, gap array<float>"), "placed")
    # One row a list, at most MAX_LISTS, reaches the driver, which joins small lists into blocks; large ones are split.
    size = placed.groupBy(F.col("near")[0].alias("list")).agg(F.count(F.lit(1)).alias("m"), F.max(F.col("gap")[0]).alias("radius"))
    blocks, room, last = [], 0, None
    for r in sorted(size.collect(), key=lambda r: (coarse[r["list"]], r["list"])):
        if coarse[r["list"]] != last or r["m"] > room:
            room, last = MEMBERS, coarse[r["list"]]
            block = len(blocks)
        room -= r["m"]
        blocks.append((r["list"], block, -(-r["m"] // MEMBERS), r["radius"] + 1e-6))
    block_of, radius, parts = np.zeros(lists, np.int32), np.zeros(lists), np.ones(len(blocks) or 1, np.int32)
    for a, block, split, r in blocks:
        block_of[a], radius[a], parts[block] = block, r, split
    plan = spark.sparkContext.broadcast((block_of, radius))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks that queries may ask, counted once a query."""
        total = np.zeros(len(parts), np.int64)
        for b in filter(len, batches):
            ask = np.sort(plan.value[0][np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)], axis=1)
            first = np.concatenate([np.ones((len(ask), 1), bool), ask[:, 1:] != ask[:, :-1]], axis=1)
            total += np.bincount(ask[first], minlength=len(parts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(total)], names=["block", "n"])

    asked = np.zeros(len(parts), np.int64)
    for r in placed.select("near").mapInArrow(spread, "block int, n bigint").groupBy("block").agg(F.sum("n").alias("n")).collect():
        asked[r["block"]] = r["n"]
    shape = "block int, mb int, qb int"
    splits = F.broadcast(spark.createDataFrame(pa.table({"block": np.arange(len(parts), dtype=np.int32), "mb": parts, "qb": (-(-asked // QUERIES)).clip(1).astype(np.int32)}), shape))
    listed = F.broadcast(spark.createDataFrame(pa.table({"list": np.arange(lists, dtype=np.int32), "block": block_of}), "list int, block int"))
    members = placed.select(F.col("near")[0].alias("list"), F.col("id").alias("mid"), F.col("v").alias("mv")).join(listed, "list").join(splits, "block")
    members = members.withColumn("x", F.pmod(F.xxhash64("mid"), "mb").cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    members = members.select("block", "x", "y", "list", "mid", "mv")

    def asks(first: int, last: int):
        """Rows (id, v, near, gap, bound) to one row for each block in which the query asks for lists ``first`` to ``last``
        of its order. Nothing in a list is nearer than its centroid less its radius: such lists are skipped, without loss."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block_of, radius = plan.value
            for b in filter(len, batches):
                near, gap = (np.asarray(b.column(c).flatten()).reshape(b.num_rows, -1)[:, first:last] for c in (2, 3))
                i, j = np.nonzero(gap - radius[near] <= np.sqrt(b.column(4).to_numpy() + 1e-5)[:, None])
                near = near[i, j]
                order = np.lexsort((block_of[near], i))
                i, near = i[order], near[order]
                block = block_of[near]
                head = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (block[1:] != block[:-1])))) if len(i) else i
                which = pa.ListArray.from_arrays(pa.array(np.append(head, len(i)).astype(np.int32)), pa.array(near))
                row = pa.array(i[head])
                yield pa.RecordBatch.from_arrays([pa.array(block[head]), b.column(0).take(row), b.column(1).take(row), b.column(4).take(row), which], names=["block", "qid", "qv", "bound", "lists"])

        return run

    turn = rotation(dim, seed)
    kind = base.schema["v"].dataType.simpleString()

    def search(queries: DataFrame, first: int, last: int) -> DataFrame:
        """Each query's k best within each block it asks."""
        q = queries.mapInArrow(asks(first, last), f"block int, qid bigint, qv {kind}, bound double, lists array<int>").join(splits, "block")
        q = q.withColumn("y", F.pmod(F.xxhash64("qid", F.lit(7)), "qb").cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
        q = q.select("block", "x", "y", "qid", "qv", "bound", "lists")
        keys = ["block", "x", "y"]
        return q.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(_block(dim, k, turn, epsilon), "q bigint, id bigint, sim double")

    mine = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    # The query's own list first: its k-th best there is the bound that lets the other lists abandon early.
    home = written(search(placed.withColumn("bound", F.lit(4.0)), 0, 1), "home")
    top = home.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
    found = top.drop("rank")
    if probes > 1:
        bound = top.where(F.col("rank") == k).select(F.col("q").alias("id"), (2 - 2 * F.col("sim")).alias("bound"))
        rest = placed.join(bound, "id", "left").select("id", "v", "near", "gap", F.coalesce("bound", F.lit(4.0)).alias("bound"))
        found = found.unionByName(search(rest, 1, probes))
    return found.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, *, key: str, vec: str, dim: int, **how) -> DataFrame:
    """``(item_id_a, item_id_b)``, a < b: pairs of which at least one is among the other's ``k`` most similar."""
    near = nearest(vectors, key=key, vec=vec, dim=dim, **how)
    return near.select(F.least("q", "id").alias("item_id_a"), F.greatest("q", "id").alias("item_id_b")).distinct()
