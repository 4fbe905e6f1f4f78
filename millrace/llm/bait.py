"""Keyword-stuffed and link-list pages (problem 9).

Every page is measured twice, see ``page_features``. Crude signals of the text as a whole (how far it packs, how many word
pairs its words form, how many foreign hosts it names, how much of it is program text) vote, and where the votes agree a page
has a weak label. Bagged decision trees, each split seeing a part of the features, are fitted to a bounded sample of the
labelled pages; their features are others than the signals, so they learn what the labelled pages are like and judge those
the signals leave open. At last predictions are smoothed with the rate among the other pages of the same host, here the
repository, as far as hosts differ more than chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.page_features import FEATURES, SIGNALS, measured
from millrace.session import written

#: Weakly labelled pages the trees are fitted on, at most.
FIT_ROWS = 20_000
#: Pages without bait for each page with it in the sample; where cases are rarer, they are repeated up to this.
PER_CASE = 2


def page_features(docs: DataFrame, *, key: str, text: str, host: str) -> DataFrame:
    """``(key, host, <FEATURES>, <SIGNALS>)`` for every row, in one pass without shuffle."""
    rows = docs.select(F.col(key).alias("k"), F.col(host).alias("h"), F.col(text).alias("t"))
    names = [*FEATURES, *SIGNALS]
    shape = ", ".join([f"k {rows.schema['k'].dataType.simpleString()}", f"h {rows.schema['h'].dataType.simpleString()}", *[f"{c} double" for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e, got in measured(b.column(2)):
                cols = [pa.array(got[c].astype(float)) for c in names]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), *cols], names=["k", "h", *names])

    return rows.mapInArrow(run, shape)


def weak_label() -> Column:
    """1 where a signal for bait stands alone, 0 where a signal against it does, null where neither or both do.

    For: few words in many pairs that pack well, in no sentences or in very short ones; many hosts and little beside them;
    letters that keep repeating whatever parts them. Against: program text, text that hardly packs or repeats, sentences of ordinary
    length, tables of numbers, lines that all end alike.
    """
    c = F.col
    soft = (c("s_symbols") < 0.1) & (c("s_tail") < 0.9)
    some = c("s_words") >= 40
    loose = c("s_stops") <= 1 / 30
    stuffed = some & (c("s_packed") <= 0.42) & (c("s_grams") >= 2) & loose & (c("s_hosts") <= 2)
    chanted = some & (c("s_packed") <= 0.36) & (c("s_grams") >= 1.7) & (c("s_stops") >= 1 / 8)
    linking = (c("s_hosts") >= 8) & (c("s_words") <= 5 * c("s_urls")) & (c("s_numerals") <= 0.5 * c("s_urls"))
    glued = (c("s_novelty") <= 0.4) & (c("s_words") >= 20) & loose & (c("s_numerals") <= 0.3 * c("s_words"))
    bait = soft & (stuffed | chanted | linking | glued)
    prose = (c("s_grams") < 2) & (c("s_stops") > 1 / 25) & (c("s_stops") < 1 / 9.5) & (c("s_urls") <= c("s_words") / 12)
    varied = ((c("s_packed") >= 0.5) | (c("s_novelty") >= 0.75)) & (c("s_hosts") < 5)
    fair = (c("s_symbols") >= 0.25) | varied | prose | (c("s_tail") >= 0.9) | (c("s_numerals") >= 0.5 * c("s_words") + 1) | ((c("s_words") < 10) & (c("s_hosts") <= 1))
    return F.when(bait & ~fair, 1.0).when(fair & ~bait, 0.0)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(0.005)), F.lit(0.995))
    return F.log(q / (1 - q))


def _forest(pages: DataFrame, fit_rows: int, trees: int, depth: int) -> DataFrame:
    """``pages`` with the trees' probability ``p``; the labels alone decide where they are all of one kind."""
    labelled = pages.where("s_size > 0").withColumn("label", weak_label()).where("label IS NOT NULL")
    # Bounded, uniform and repeatable samples: the rows of either kind with the smallest hashes. The key is hashed too, so
    # that copies of a page don't come all or none.
    drawn = labelled.select("label", *FEATURES, F.xxhash64("k", "h", *FEATURES).alias("__x")).orderBy("__x").drop("__x")
    cases = written(drawn.where("label = 1").limit(fit_rows // (1 + PER_CASE)), "cases")
    n = cases.count()
    others = written(drawn.where("label = 0").limit(fit_rows - fit_rows // (1 + PER_CASE)), "others")
    m = others.count()
    if not n or not m:
        return pages.withColumn("p", F.coalesce(weak_label(), F.lit(0.0)))
    copies = max(1, round(m / (PER_CASE * n)))  # so that few cases are still in every tree's sample
    sample = cases.withColumn("__c", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("__c").unionByName(others)
    vector = VectorAssembler(inputCols=FEATURES, outputCol="v")
    forest = RandomForestClassifier(
        featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", bootstrap=True, subsamplingRate=1.0, seed=17, minInstancesPerNode=1, maxBins=64
    )
    model = forest.fit(vector.transform(sample))
    return model.transform(vector.transform(pages)).withColumn("p", vector_to_array("probability")[1])


def bait_pages(
    docs: DataFrame, *, key: str, text: str, host: str, fit_rows: int = FIT_ROWS, trees: int = 40, depth: int = 10, pull: float = 0.2, threshold: float = 0.5, smooth: bool = True
) -> DataFrame:
    """``(key, score)`` of the rows judged search bait: ``score`` is the smoothed probability, at least ``threshold``.

    Smoothing adds ``pull`` times the host's evidence: the log-odds of the rate among its other pages against the overall
    rate. That rate is shrunk towards the overall one by a number of pages fitted from how far hosts differ beyond what
    their sizes explain; where they don't differ, hosts say nothing. ``smooth`` false leaves the trees' prediction.

    - Null and empty texts are no case. Each row is judged by itself, repeated and null keys included.
    - A null host has no other pages, so its prediction stays as it is.
    - Texts of any length are read whole. Without labelled pages of both kinds to fit on, the weak labels alone decide. An
      empty table gives no rows. Only the three columns are read.
    """
    pages = written(page_features(docs, key=key, text=text, host=host), "pages")
    judged = _forest(pages, fit_rows, trees, depth).select("k", "h", "p", F.col("s_size").alias("size"))
    if not smooth:
        return judged.where((F.col("p") >= threshold) & (F.col("size") > 0)).select(F.col("k").alias(key), F.col("p").alias("score"))
    judged = written(judged, "judged")
    hosts = judged.where("h IS NOT NULL").groupBy("h").agg(F.sum("p").alias("__s"), F.count(F.lit(1)).alias("__n"))
    rate, spread, strength = _between(hosts)
    odds = _logit(F.col("p"))
    joined = judged.join(hosts, "h", "left")
    if spread:
        others = (F.col("__s") - F.col("p") + F.lit(strength * rate)) / (F.col("__n") - 1 + strength)
        odds = odds + F.coalesce(F.lit(pull) * (_logit(others) - _logit(F.lit(rate))), F.lit(0.0))
    scored = joined.withColumn("score", 1 / (1 + F.exp(-odds)))
    return scored.where((F.col("score") >= threshold) & (F.col("size") > 0)).select(F.col("k").alias(key), "score")


def _between(hosts: DataFrame) -> tuple[float, bool, float]:
    """Overall rate, whether hosts differ beyond chance, and the pages by which a host's rate is shrunk: the moments of a
    beta distribution of rates over the hosts of more than one page, weighted by their pages."""
    s, n = F.col("__s"), F.col("__n")
    a = hosts.where("__n > 1").agg(F.sum(s).alias("s"), F.sum(n).alias("n"), F.sum(s * s / n).alias("q"), F.sum(n * n).alias("m"), F.count(F.lit(1)).alias("k")).head()
    if not a["n"] or a["k"] < 2 or not 0 < a["s"] < a["n"]:
        return 0.0, False, 0.0
    rate = a["s"] / a["n"]
    within = rate * (1 - rate)
    # Expected sum of n (host rate - rate)^2 is (k - 1) within + (n - m / n) between, up to the share of within.
    between = (a["q"] - a["s"] ** 2 / a["n"] - (a["k"] - 1) * within) / (a["n"] - a["m"] / a["n"])
    return (rate, True, max(1.0, within / between - 1)) if between > 0 else (rate, False, 0.0)
