"""Queries of the general problems 3, 4 and 6, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.eager_aggregate import eager_join_aggregate, heavy_keys, key_counts
from millrace.operators.feature_table import dominant_types, expand, feature_state, type_index
from millrace.operators.sessions import sessions
from millrace.schema import counted_events, table

#: One row per counted event, in SQL.
COUNTED_SQL = """ce AS (
  SELECT event_id, user_id, item_id, ts, category
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at) AS rn FROM interactions)
  WHERE rn = 1 AND user_id >= 0 AND item_id >= 0 AND ts IS NOT NULL)"""


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dictionary = type_index(table(spark, d, "categories"), "category")
    ce = counted_events(table(spark, d, "interactions"), category=True)
    return feature_state(ce, dictionary, entity="user_id", kind="category", time="ts", witness="item_id"), dictionary


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    state, dictionary = _state(spark, d)
    return dominant_types(state, dictionary, entity="user_id").withColumnRenamed("type", "category")


def p3_feature_table(spark: SparkSession, d: str) -> DataFrame:
    state, dictionary = _state(spark, d)
    return expand(state, dictionary, entity="user_id")


def _key_counts(spark: SparkSession, d: str) -> DataFrame:
    dims = {"user_id": table(spark, d, "users"), "item_id": table(spark, d, "item_catalogue")}
    return key_counts(counted_events(table(spark, d, "interactions")), dims)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(_key_counts(spark, d)).select("key_field", "key_id")


def p4_key_counts(spark: SparkSession, d: str) -> DataFrame:
    return _key_counts(spark, d).select("key_field", "key_id", F.col("n").alias("n_events"), "known")


def p4_category_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Events joined with every catalogue row of their item (some occur twice), rolled up by the catalogue's category."""
    ce, cat = counted_events(table(spark, d, "interactions")), table(spark, d, "item_catalogue")
    out = eager_join_aggregate(
        ce, cat.select("item_id", F.col("category").alias("catalogue_category"), F.col("popularity")), ["item_id"],
        right_groups=["catalogue_category"], right_sums={"sum_popularity": "popularity"}, keep_key=False, count="n_rows",
    )
    return out.withColumn("sum_popularity", F.round("sum_popularity", 4))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_sessions(spark, d).select("user_id", "first_event_id", "last_event_id")


def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(counted_events(table(spark, d, "interactions")))


_SESSIONS_SQL = f"""
WITH {COUNTED_SQL},
marked AS (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 THEN 0 ELSE 1 END AS fresh
  FROM ce WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM marked),
grouped AS (
  SELECT user_id, s, min(ts) AS "start", max(ts) AS "end", count(*) AS n_events,
    arg_min(event_id, k) AS first_event_id, arg_max(event_id, k) AS last_event_id
  FROM numbered GROUP BY user_id, s)
"""

_P3_STATE_SQL = f"""
WITH {COUNTED_SQL},
u AS (SELECT user_id, count(*) AS n_all, max(ts) AS latest_all FROM ce GROUP BY user_id),
t AS (SELECT user_id, category, count(*) AS cnt, max(ts) AS latest, count(DISTINCT item_id) AS items
  FROM ce WHERE category IS NOT NULL AND category IN (SELECT category FROM categories) GROUP BY user_id, category)
"""


def _wide_sql(n: int = 240) -> str:
    cols = ", ".join(
        f"coalesce(max(t.cnt) FILTER (WHERE t.category = {i}), 0) AS cnt_{i}, "
        f"CAST(coalesce(max(t.cnt) FILTER (WHERE t.category = {i}), 0) AS DOUBLE) AS total_{i}, "
        f"(epoch_us(u.latest_all) - max(epoch_us(t.latest)) FILTER (WHERE t.category = {i})) // 1000000 AS recency_s_{i}"
        for i in range(n)
    )
    return f"{_P3_STATE_SQL} SELECT u.user_id, u.n_all, u.latest_all, {cols} FROM u LEFT JOIN t ON u.user_id = t.user_id GROUP BY u.user_id, u.n_all, u.latest_all"


QUERIES = {
    "p3_found": p3_found,
    "p3_feature_table": p3_feature_table,
    "p4_found": p4_found,
    "p4_key_counts": p4_key_counts,
    "p4_category_rollup": p4_category_rollup,
    "p6_found": p6_found,
    "p6_sessions": p6_sessions,
}

_KEYS_SQL = f"""
WITH {COUNTED_SQL},
k AS (SELECT 'user_id' AS key_field, user_id AS key_id, count(*) AS n FROM ce GROUP BY user_id
  UNION ALL SELECT 'item_id', item_id, count(*) FROM ce GROUP BY item_id)
"""

SQL = {
    "p3_found": _P3_STATE_SQL
    + """SELECT t.user_id, t.category FROM t JOIN u ON t.user_id = u.user_id
WHERE t.cnt >= 4 AND t.items >= 2 AND t.cnt * 5 >= u.n_all AND t.latest >= u.latest_all - INTERVAL 7 DAY""",
    "p3_feature_table": _wide_sql(),
    "p4_found": _KEYS_SQL + "SELECT key_field, key_id FROM k WHERE n * 50 >= (SELECT count(*) FROM ce)",
    "p4_key_counts": _KEYS_SQL
    + """SELECT key_field, key_id, n AS n_events, CASE WHEN key_field = 'user_id' THEN key_id IN (SELECT user_id FROM users WHERE user_id IS NOT NULL)
  ELSE key_id IN (SELECT item_id FROM item_catalogue WHERE item_id IS NOT NULL) END AS known FROM k""",
    "p4_category_rollup": f"""WITH {COUNTED_SQL}
SELECT c.category AS catalogue_category, count(*) AS n_rows, round(sum(c.popularity), 4) AS sum_popularity
FROM ce JOIN item_catalogue c ON ce.item_id = c.item_id GROUP BY c.category""",
    "p6_found": _SESSIONS_SQL + "SELECT user_id, first_event_id, last_event_id FROM grouped",
    "p6_sessions": _SESSIONS_SQL
    + """SELECT user_id, "start", "end", epoch_us("end") - epoch_us("start") AS duration_us, n_events, first_event_id, last_event_id FROM grouped""",
}
