"""``python -m millrace.cli generate|run|bench``."""

from __future__ import annotations

import argparse
import resource
import time

from pyspark.sql import functions as F

from millrace.operators import metrics, stats
from millrace.operators.trainer import TrainConfig
from millrace.plans.pipeline import PipelineConfig, run
from millrace.session import get_spark
from millrace.sources import files
from millrace.sources.generator import Catalogue, GeneratorConfig, generate
from millrace.streaming.histogram import counts, head_share


def _config(a: argparse.Namespace) -> GeneratorConfig:
    return GeneratorConfig(n_users=a.users, n_items=a.items, n_categories=a.categories, seed=a.seed)


def _generate(a: argparse.Namespace) -> None:
    spark, t = get_spark("generate"), time.time()
    n = files.write_log(generate(spark, a.rows[0], _config(a)), a.out)
    print(f"{n} rows in {time.time() - t:.1f} s to {a.out}")


def _run(a: argparse.Namespace) -> None:
    spark, t = get_spark("run"), time.time()
    cfg = _config(a)
    items = Catalogue(cfg).items(spark)
    log = generate(spark, a.rows[0], cfg)
    files.write_log(log, f"{a.out}/log")
    log = files.read_log(spark, f"{a.out}/log")
    res = run(log, items, PipelineConfig(k=a.k, train=TrainConfig(dim=a.dim, epochs=a.epochs, shards=a.shards)))
    res.metrics.show(truncate=False)
    files.write_metrics([res.metrics], f"{a.out}/metrics")
    files.write_summary(res.metrics.select(F.collect_list(F.struct("*")).alias("methods")).withColumn("ann_recall", F.lit(res.ann_recall)).withColumn("seconds", F.lit(time.time() - t)), f"{a.out}/summary")
    files.write_items(res.embeddings.items, items, stats.item_stats(res.split.train, items), f"{a.out}/items")
    metrics.lift(res.metrics, "popularity").show(20, truncate=False)
    print(f"recall of the lists against exact search {res.ann_recall:.4f}, {time.time() - t:.1f} s")


def _bench(a: argparse.Namespace) -> None:
    spark = get_spark("bench")
    out = []
    for rows in a.rows:
        t = time.time()
        c = counts(generate(spark, rows, _config(a)), "item_id").where("field = 'item_id'")
        r = head_share(c, a.items).head()
        s = time.time() - t
        out.append((rows, s, rows / s / 1e6, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, r["head_share"], r["n_touched"]))
    res = spark.createDataFrame(out, "rows bigint, seconds double, throughput_mrows_s double, peak_rss_mb double, head_1pct_share double, distinct_items_touched bigint")
    res.show()
    files.write_metrics([res], a.out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(required=True)
    for name, f, rows in (("generate", _generate, 1_000_000), ("run", _run, 5_000_000), ("bench", _bench, 1_000_000)):
        q = sub.add_parser(name)
        q.set_defaults(f=f)
        q.add_argument("--rows", type=int, nargs="+" if name == "bench" else 1, default=[rows])
        q.add_argument("--users", type=int, default=50_000)
        q.add_argument("--items", type=int, default=5_000)
        q.add_argument("--categories", type=int, default=20)
        q.add_argument("--seed", type=int, default=42)
        q.add_argument("--out", required=True, help="a folder that all executors share")
        if name == "run":
            q.add_argument("--dim", type=int, default=64)
            q.add_argument("--epochs", type=int, default=4)
            q.add_argument("--k", type=int, default=20)
            q.add_argument("--shards", type=int, default=1)
    a = p.parse_args(argv)
    a.f(a)


if __name__ == "__main__":
    main()
