"""Counter-based randomness: every draw is a pure function of (index, stream, seed), so no plan depends on partitioning."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The constants of the public splitmix64 finaliser.
SM1, SM2, SM3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
WORD = 1 << 64


def signed(x: int) -> int:
    """A 64-bit word as Spark's BIGINT."""
    x %= WORD
    return x - WORD if x >= WORD // 2 else x


_ANSI = RLock()


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Arithmetic that wraps around: expressions analysed inside keep that mode wherever they run. One thread at a time
    switches the mode, so that none restores what another has set."""
    with _ANSI:
        old = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.ansi.enabled", old)


def splitmix64(x: Column) -> Column:
    z = x + F.lit(signed(SM1))
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 30)) * F.lit(signed(SM2))
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 27)) * F.lit(signed(SM3))
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def uniform(index: Column, stream: int, seed: int) -> Column:
    """A double in [0, 1) from the top 53 bits."""
    key = (index.cast("bigint") * 4 + stream).bitwiseXOR(F.lit(signed(seed * SM1)))
    return F.shiftrightunsigned(splitmix64(key), 11).cast("double") * F.lit(2.0**-53)


def with_uniforms(df: DataFrame, index: Column, draws: dict[str, int], seed: int) -> DataFrame:
    """``df`` with one column per draw: name to stream number."""
    with wrapping(df.sparkSession):
        out = df.withColumns({name: uniform(index, stream, seed) for name, stream in draws.items()})
        out.schema  # noqa: B018  the plan is analysed while arithmetic wraps
    return out


def _factor(n: int) -> int:
    """An odd multiplier for the n-th key."""
    return pow(SM2, n + 1, WORD) | 1


def with_key_hash(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``df`` with a non-negative 61-bit hash of whole-number columns: four times it still fits a BIGINT."""
    with wrapping(df.sparkSession):
        total = F.lit(0).cast("bigint")
        for n, k in enumerate(keys):
            total = total + F.col(k).cast("bigint") * F.lit(signed(_factor(n)))
        out = df.withColumn(name, F.shiftrightunsigned(splitmix64(total), 3))
        out.schema  # noqa: B018  as above
    return out


def key_hash_sql(source: str, name: str, prefix: str, *keys: str) -> str:
    """CTEs (the last is ``<prefix>``) that add the same hash in DuckDB."""
    m = f"CAST({WORD} AS UHUGEINT)"
    total = " + ".join(f"CAST({k} AS UHUGEINT) * CAST({_factor(n)} AS UHUGEINT) % {m}" for n, k in enumerate(keys))
    return f"""{prefix}1 AS (SELECT *, ({total} + CAST({SM1} AS UHUGEINT)) % {m} AS z FROM {source}),
{prefix}2 AS (SELECT * EXCLUDE z, (xor(z, z >> 30) * CAST({SM2} AS UHUGEINT)) % {m} AS z FROM {prefix}1),
{prefix}3 AS (SELECT * EXCLUDE z, (xor(z, z >> 27) * CAST({SM3} AS UHUGEINT)) % {m} AS z FROM {prefix}2),
{prefix} AS (SELECT * EXCLUDE z, CAST(xor(z, z >> 31) >> 3 AS BIGINT) AS {name} FROM {prefix}3)"""


def uniform_sql(source: str, index: str, stream: int, seed: int, name: str, prefix: str) -> str:
    """CTEs (comma-separated, the last is ``<prefix>4``) that add the same draw as column ``name`` in DuckDB."""
    m, s = str(WORD), (seed * SM1) % WORD
    return f"""
{prefix}1 AS (SELECT *, (xor(CAST({index} AS UHUGEINT) * 4 + {stream}, CAST({s} AS UHUGEINT)) + CAST({SM1} AS UHUGEINT)) % CAST({m} AS UHUGEINT) AS z1 FROM {source}),
{prefix}2 AS (SELECT * EXCLUDE z1, (xor(z1, z1 >> 30) * CAST({SM2} AS UHUGEINT)) % CAST({m} AS UHUGEINT) AS z2 FROM {prefix}1),
{prefix}3 AS (SELECT * EXCLUDE z2, (xor(z2, z2 >> 27) * CAST({SM3} AS UHUGEINT)) % CAST({m} AS UHUGEINT) AS z3 FROM {prefix}2),
{prefix}4 AS (SELECT * EXCLUDE z3, CAST(xor(z3, z3 >> 31) >> 11 AS DOUBLE) * {2.0**-53!r} AS {name} FROM {prefix}3)"""
