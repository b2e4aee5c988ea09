"""Results with their intervals as tables and JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import stats


def compare(current: DataFrame, baseline: DataFrame, metric: str) -> DataFrame:
    """Two runs joined on ``qid``: number of pairs, mean difference with its t-interval, signed-rank p."""
    pairs = current.select("qid", F.col(metric).alias("x")).join(baseline.select("qid", F.col(metric).alias("y")), "qid").withColumn("metric", F.lit(metric))
    interval = stats.mean_interval(pairs.withColumn("d", F.col("x") - F.col("y")), ["metric"], "d")
    return interval.join(stats.wilcoxon(pairs, "metric", "x", "y").select("metric", "p"), "metric")


def markdown(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Lines of a Markdown table of estimates ``struct<mean, lo, hi>``."""
    cell = lambda c: F.coalesce(F.format_string("%.3f [%.3f, %.3f]", F.col(f"{c}.mean"), F.col(f"{c}.lo"), F.col(f"{c}.hi")), F.lit("n/a"))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", F.col(name), *[cell(c) for c in columns]), F.lit(" |")).alias("line"))


def envelope(name: str, hardware: str, seeds: list[int], rows: list[dict]) -> str:
    """A benchmark as JSON. Every value must be an estimate with bounds; bare numbers are refused."""
    for row in rows:
        for key, value in row.items():
            if isinstance(value, float):
                raise ValueError(f"{key} has no interval")
    if len(set(seeds)) < 3:
        raise ValueError("three distinct seeds at least")
    return json.dumps({"name": name, "hardware": hardware, "seeds": seeds, "rows": rows}, sort_keys=True)


# Metrics in the order in which reports name them.
METRIC_ORDER = ["recall@1", "recall@5", "recall@10", "recall@20", "ndcg@10", "mrr", "map"]


def ordered_metrics(names: list[str]) -> list[str]:
    """Well-known metrics first, the others by name."""
    return [n for n in METRIC_ORDER if n in names] + sorted(n for n in names if n not in METRIC_ORDER)


def metric_names(metric: str) -> list[str]:
    """Both spellings of a metric at a cut: ``ndcg@10`` and ``ndcg_at_10``."""
    return list(dict.fromkeys([metric, metric.replace("@", "_at_"), metric.replace("_at_", "@")]))


def extract_metric(payload: Column, metric: str) -> Column:
    """A metric's value in a result file's JSON, whatever its shape: the mean of an estimate or a number, under ``metrics``, ``summary`` or at the top."""
    paths = [f"$.{top}['{name}']{tail}" for name in metric_names(metric) for top in ("metrics", "summary", "") for tail in (".mean", "")]
    return F.coalesce(*[F.get_json_object(payload, p.replace("$.[", "$[")).try_cast("double") for p in paths])


def per_question(payloads: DataFrame, metric: str) -> DataFrame:
    """``run, qid, value`` of ``payloads(run, payload)``: the map under ``per_question`` in either spelling."""
    maps = [F.from_json(F.get_json_object("payload", f"$.per_question['{n}']"), "map<string, double>") for n in metric_names(metric)]
    return payloads.select("run", F.explode(F.coalesce(*maps)).alias("qid", "value"))


def coverage(golden: DataFrame, categories: list[str]) -> DataFrame:
    """Questions per category, those without any included."""
    spark = golden.sparkSession
    every = spark.createDataFrame([(c,) for c in categories], "category string")
    return every.join(golden.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
