"""Items that appear together, with large-basket blocking (problem 5).

Items get a chunk and a place in it. Ordinary baskets emit their item pairs as packed codes, already summed within each
Arrow batch. A huge basket is split into its items of each chunk; only chunk pairs travel, and the product of two chunks
is formed by the task that owns this pair of chunks, as additions to one bounded matrix. The same task receives the
ordinary counts of these two chunks in order, adds both, and emits the pairs that are frequent enough, so the pairs of
huge baskets are never written out. Association is then computed from the item counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

#: Items in a basket from which it is split into chunks.
HUGE = 512
#: Items of a chunk, about; a task holds one matrix of about this size squared (int32).
CHUNK = 1024
#: Chunks at least, so that the pairs of few items still meet in many tasks; and the chunks of a huge basket with which all
#: its chunks are paired under one key.
LEAST_CHUNKS, SLICE = 16, 32
#: Pair codes buffered by a task before they are summed and sent on.
FLUSH = 2_000_000


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Baskets (sorted list of codes) to (cell, code pair, count), summed within the buffer."""
    held, size = [], 0

    def flush():
        key, n = np.unique(np.concatenate(held), return_counts=True)
        a, b = key >> 32, key & 0xFFFFFFFF
        cell = ((a >> 12) << 32) | (b >> 12)
        for s in range(0, len(key), 100_000):
            e = slice(s, s + 100_000)
            k = len(key[e])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[e]), pa.array(key[e]), pa.array(n[e].astype(np.int64)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())],
                names=["cell", "key", "n", "xs", "ys"],
            )

    for batch in batches:
        lists = batch.column(0)
        flat, off = np.asarray(lists.flatten()).astype(np.int64), np.asarray(lists.offsets)
        off = off - off[0]
        sizes = np.diff(off)
        for m in np.unique(sizes[sizes > 1]):  # all baskets of one size at once
            rows = np.sort(flat[(off[:-1][sizes == m])[:, None] + np.arange(m)], axis=1)
            i, j = np.triu_indices(m, 1)
            step = max(1, FLUSH // len(i))
            for s in range(0, len(rows), step):
                part = rows[s : s + step]
                held.append(((part[:, i] << 32) | part[:, j]).ravel())
                size += held[-1].size
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
    if held:
        yield from flush()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of each part of a huge basket as the bytes of their 16-bit places: compact, and cheap where absent."""
    for b in batches:
        lists = b.column(2)
        off = np.asarray(lists.offsets)
        places = (np.asarray(lists.values) & 4095).astype("<i2")
        packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((off * 2).astype(np.int32)), pa.py_buffer(places)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], names=["u", "c", "at"])


def _cells(min_pair: int, side: int):
    """Rows sorted by (cell, key), products first (their key is -1): total counts per pair, those of ``min_pair`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, grid = None, None  # the open cell and its matrix, if it has products
        last_key, last_n = None, 0  # the open pair of ordinary counts
        out_key: list[np.ndarray] = []
        out_n: list[np.ndarray] = []

        def settle(keys: np.ndarray, n: np.ndarray) -> None:
            """Closed ordinary pairs of the open cell."""
            if grid is not None and len(keys):
                x, y = (keys >> 32) & 4095, keys & 4095
                n = n + grid[x, y]
                grid[x, y] = 0
            hit = n >= min_pair
            out_key.append(keys[hit])
            out_n.append(n[hit])

        def close() -> None:
            """The open cell ends: the open pair, and pairs of huge baskets alone."""
            nonlocal last_key, last_n
            if last_key is not None:
                settle(np.array([last_key], np.int64), np.array([last_n], np.int64))
                last_key, last_n = None, 0
            if grid is not None:
                cx, cy = cell >> 32, cell & 0xFFFFFFFF
                x, y = np.nonzero((np.triu(grid, 1) if cx == cy else grid) >= min_pair)  # of a chunk with itself, a < b
                out_key.append((((cx << 12) | x.astype(np.int64)) << 32) | ((cy << 12) | y.astype(np.int64)))
                out_n.append(grid[x, y].astype(np.int64))

        def made():
            k, n = np.concatenate(out_key), np.concatenate(out_n)
            out_key.clear(), out_n.clear()
            return pa.RecordBatch.from_arrays([pa.array(k >> 32), pa.array(k & 0xFFFFFFFF), pa.array(n)], names=["ca", "cb", "n_ab"])

        for batch in batches:
            cells, keys, ns = (np.asarray(batch.column(i)) for i in range(3))
            starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else []
            for s, e in zip(starts, [*starts[1:], len(cells)]):
                if cells[s] != cell:
                    if cell is not None:
                        close()
                    cell, grid = int(cells[s]), None
                m = s + int(np.searchsorted(keys[s:e], 0))  # products have key -1
                for r in range(s, m):
                    xs, ys = (np.frombuffer(batch.column(c)[r].as_buffer(), "<i2") for c in (3, 4))
                    if grid is None:
                        grid = np.zeros((side, side), np.int32)
                    grid[np.ix_(xs, ys)] += 1
                if m < e:
                    k, n = keys[m:e], ns[m:e]
                    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                    k, n = k[first], np.add.reduceat(n, first)
                    if last_key is not None:
                        if k[0] == last_key:
                            n[0] += last_n
                        else:
                            settle(np.array([last_key], np.int64), np.array([last_n], np.int64))
                    settle(k[:-1], n[:-1])
                    last_key, last_n = int(k[-1]), int(n[-1])
            if out_key:
                yield made()
        if cell is not None:
            close()
            if out_key:
                yield made()

    return run


def cooccurrence(
    baskets: DataFrame, *, basket: str, item: str, min_pair: int = 6, lift: int = 4, huge: int = HUGE, chunk: int = CHUNK
) -> DataFrame:
    """``(item_id_a, item_id_b, n_ab, n_a, n_b, n_baskets, lift)``, a < b: pairs with ``n_ab`` >= ``min_pair`` baskets in
    common and ``n_ab * n_baskets`` >= ``lift * n_a * n_b``.

    - A basket is a set: repeated rows of an item count once. Rows with a null basket or item are left out.
    - A basket of one item has no pair but counts among all baskets.
    - An empty table gives no rows. Only the two columns are read, whatever others are called. Items are BIGINT.
    - ``chunk`` is at most 2048: chunks vary in size around it and must stay below the 4096 places of a cell.

    Items that can be in no case are left out before any pair is made, exactly: as n_ab <= min(n_a, n_b), both items
    need ``min_pair`` baskets, and neither may be in more than 1/``lift`` of all baskets.
    """
    if not 1 <= chunk <= 2048:
        raise ValueError("chunk must be within 1 to 2048")
    pairs = baskets.select(F.col(basket).alias("u"), F.col(item).cast("bigint").alias("i")).where("u IS NOT NULL AND i IS NOT NULL").distinct()
    pairs = written(pairs, "baskets")
    spark = baskets.sparkSession
    n_baskets = pairs.select("u").distinct().count()
    counts = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n_i"))
    kept = counts.where((F.col("n_i") >= min_pair) & (F.col("n_i") * lift <= n_baskets))
    # A hash spreads items over chunks; the place is the rank within a chunk. Chunks are bounded, so is this window.
    n_chunks = max(LEAST_CHUNKS, -(-kept.count() // chunk))
    place = F.row_number().over(Window.partitionBy("c").orderBy("i")) - 1
    coded = kept.withColumn("c", F.pmod(F.xxhash64("i"), F.lit(n_chunks))).withColumn("p", place)
    coded = written(coded.select("i", "n_i", (F.col("c") * 4096 + F.col("p")).alias("code"), "p"), "items")
    side = (coded.agg(F.max("p")).head()[0] or 0) + 1
    if side > 4096:
        raise ValueError("a chunk overflows its cell; choose a smaller chunk")

    # Codes of kept items per basket; hot items went with the pruning, and AQE splits what skew is left in this join.
    rows = pairs.join(coded.select("i", "code"), "i").select("u", F.col("code").cast("int").alias("code"))
    # A task lists at most the items of one chunk of a basket, so no basket gathers whole unless it is small.
    parts = rows.groupBy("u", F.shiftright("code", 12).alias("c")).agg(F.collect_list("code").alias("codes"))
    parts = written(parts.withColumn("n", F.size("codes")), "parts")
    sizes = parts.groupBy("u").agg(F.sum("n").alias("total"))
    big = sizes.where(F.col("total") > huge).select("u")
    small = parts.join(big, "u", "left_anti").groupBy("u").agg(F.flatten(F.collect_list("codes")).alias("codes")).select("codes")
    shape = "cell bigint, key bigint, n bigint, xs binary, ys binary"
    ordinary = small.mapInArrow(_pairs, shape)

    whose = pairs.schema["u"].dataType.simpleString()
    split = parts.join(big, "u", "left_semi").select("u", "c", "codes").mapInArrow(_places, f"u {whose}, c int, at binary")
    # The chunk pairs of a basket come out of many keys: one for every few of its chunks.
    slices = parts.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("s"))
    split = split.join(slices, "u")
    x = split.select("u", F.col("c").alias("cx"), F.col("at").alias("xs"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("s"))
    y = split.select("u", F.col("c").alias("cy"), F.col("at").alias("ys"), F.pmod(F.xxhash64("c"), "s").cast("int").alias("s"))
    cell = F.shiftleft(F.col("cx").cast("bigint"), 32).bitwiseOR(F.col("cy").cast("bigint"))
    products = x.join(y, ["u", "s"]).where("cx <= cy").select(cell.alias("cell"), F.lit(-1).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("n"), "xs", "ys")

    both = ordinary.unionByName(products).repartition("cell").sortWithinPartitions("cell", "key")
    found = both.mapInArrow(_cells(min_pair, side), "ca bigint, cb bigint, n_ab bigint")
    one = coded.select("i", "n_i", "code")
    a = one.select(F.col("code").alias("ca"), F.col("i").alias("ia"), F.col("n_i").alias("na"))
    b = one.select(F.col("code").alias("cb"), F.col("i").alias("ib"), F.col("n_i").alias("nb"))
    hit = found.join(a, "ca").join(b, "cb").where(F.col("n_ab") * n_baskets >= F.lit(lift) * F.col("na") * F.col("nb"))
    turned = F.col("ia") > F.col("ib")
    return hit.select(
        F.least("ia", "ib").alias("item_id_a"), F.greatest("ia", "ib").alias("item_id_b"), "n_ab",
        F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("n_a"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("n_b"),
        F.lit(n_baskets).cast("bigint").alias("n_baskets"), (F.col("n_ab") * n_baskets / (F.col("na") * F.col("nb"))).alias("lift"),
    )
