"""Queries of the llm problems, and the SQL they are held against where SQL can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bait import bait_pages
from millrace.llm.bpe import encode_ids
from millrace.llm.cooccurrence import cooccurrence
from millrace.llm.packing import fill_containers, fill_rates
from millrace.llm.similar import similar_pairs
from millrace.llm.top_n import top_n_per_group
from millrace.schema import counted_events, table

COUNTED_SQL = """ce AS (
  SELECT event_id, min(user_id) AS user_id, min(item_id) AS item_id, min(ts) AS ts FROM interactions
  WHERE event_id IS NOT NULL AND user_id >= 0 AND item_id >= 0 AND ts IS NOT NULL GROUP BY event_id)"""


def p1_top_items(spark: SparkSession, d: str) -> DataFrame:
    ce = counted_events(table(spark, d, "interactions"))
    scored = ce.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n_events"))
    return top_n_per_group(scored, group="user_id", item="item_id", score="n_events", n=10)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_top_items(spark, d).select("user_id", "item_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(table(spark, d, "item_emb"), key="item_id", vec="vec", dim=64, k=5)


def _together(spark: SparkSession, d: str) -> DataFrame:
    # A basket is a set and all deliveries of an event agree on user and item, so repeated deliveries change nothing.
    events = table(spark, d, "interactions").where("event_id IS NOT NULL AND user_id >= 0 AND item_id >= 0 AND ts IS NOT NULL")
    return cooccurrence(events, basket="user_id", item="item_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _together(spark, d).select("item_id_a", "item_id_b")


def p5_association(spark: SparkSession, d: str) -> DataFrame:
    return _together(spark, d).withColumn("lift", F.round("lift", 6))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_ids(table(spark, d, "documents"), key="doc_id", text="text", tokenizer="byte_bpe_50k")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(table(spark, d, "documents"), table(spark, d, "pack_sizes"), key="doc_id", text="text")


def p8_fill_rates(spark: SparkSession, d: str) -> DataFrame:
    return fill_rates(p8_containers(spark, d), table(spark, d, "pack_sizes"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return bait_pages(table(spark, d, "documents"), key="doc_id", text="text", host="repo").select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_top_items": p1_top_items,
    "p2_found": p2_found,
    "p5_found": p5_found,
    "p5_association": p5_association,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_fill_rates": p8_fill_rates,
    "p9_found": p9_found,
}

_TOP_SQL = f"""WITH {COUNTED_SQL},
s AS (SELECT user_id, item_id, count(*) AS n_events FROM ce GROUP BY user_id, item_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n_events DESC, item_id) AS INTEGER) AS rank FROM s)
"""

_TOGETHER_SQL = f"""WITH {COUNTED_SQL},
b AS (SELECT DISTINCT user_id, item_id FROM ce),
t AS (SELECT count(DISTINCT user_id) AS n FROM b),
i AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
p AS (SELECT x.item_id AS item_id_a, y.item_id AS item_id_b, count(*) AS n_ab
  FROM b x JOIN b y ON x.user_id = y.user_id AND x.item_id < y.item_id GROUP BY 1, 2 HAVING count(*) >= 6),
a AS (SELECT p.item_id_a, p.item_id_b, p.n_ab, i.n AS n_a, j.n AS n_b, t.n AS n_baskets
  FROM p JOIN i ON p.item_id_a = i.item_id JOIN i j ON p.item_id_b = j.item_id JOIN t ON true
  WHERE p.n_ab * t.n >= 4 * i.n * j.n)
"""

# All pairs, which is what these table sizes allow; the operator itself is approximate.
_SIMILAR_SQL = """WITH s AS (SELECT item_id, min(CAST(vec AS DOUBLE[])) AS v FROM item_emb
  WHERE item_id IS NOT NULL AND vec IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY item_id),
c AS (SELECT a.item_id AS q, b.item_id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM s a JOIN s b ON a.item_id <> b.item_id),
r AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS r FROM c)
SELECT DISTINCT least(q, id) AS item_id_a, greatest(q, id) AS item_id_b FROM r WHERE r <= 5"""

SQL = {
    "p2_found": _SIMILAR_SQL,
    "p1_found": _TOP_SQL + "SELECT user_id, item_id FROM r WHERE rank <= 10",
    "p1_top_items": _TOP_SQL + "SELECT user_id, item_id, n_events, rank FROM r WHERE rank <= 10",
    "p5_found": _TOGETHER_SQL + "SELECT item_id_a, item_id_b FROM a",
    "p5_association": _TOGETHER_SQL
    + """SELECT item_id_a, item_id_b, n_ab, n_a, n_b, n_baskets,
  round(CAST(n_ab * n_baskets AS DOUBLE) / CAST(n_a * n_b AS DOUBLE), 6) AS lift FROM a""",
}
