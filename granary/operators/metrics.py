"""Metrics of rankings and of generated answers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import text as T


def ranking_metrics(run: DataFrame, qrels: DataFrame, k: int = 10, extra: list[str] | None = None) -> DataFrame:
    """Per query with at least one relevant document: ``recall, ndcg, rr, ap`` at k, and ``n_relevant``.

    ``run(qid, doc_id, rank)`` (ranks from 1), ``qrels(qid, doc_id)``. The ideal of nDCG holds min(relevant, k) documents; average precision
    divides by the same number. A query without hits scores 0.
    """
    extra = extra or []
    rel = qrels.select("qid", "doc_id").distinct()
    sizes = rel.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    hits = run.where(F.col("rank") <= k).join(rel, ["qid", "doc_id"])
    order = Window.partitionBy(*extra, "qid").orderBy("rank")
    hits = hits.withColumn("nth", F.row_number().over(order))
    sums = hits.groupBy(*extra, "qid").agg(F.count("*").alias("found"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min("rank").alias("first"), F.sum(F.col("nth") / F.col("rank")).alias("precisions"))
    every = run.select(*extra).distinct().crossJoin(sizes) if extra else sizes
    joined = every.join(sums, [*extra, "qid"], "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    cap = F.least("n_relevant", F.lit(k))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        *extra, "qid", "n_relevant", zero(F.col("found") / F.col("n_relevant")).alias("recall"), zero(F.col("dcg") / ideal).alias("ndcg"), zero(1.0 / F.col("first")).alias("rr"), zero(F.col("precisions") / cap).alias("ap")
    )


def graded_ndcg(run: DataFrame, k: int = 10) -> DataFrame:
    """nDCG of ``run(qid, rank, relevance)`` whose ideal is the returned list itself, sorted."""
    gain = lambda rank: F.sum(F.col("relevance") / F.log2(F.col(rank) + 1.0))
    w = Window.partitionBy("qid").orderBy(F.desc("relevance"), "rank")
    placed = run.where(F.col("rank") <= k).withColumn("best", F.row_number().over(w))
    return placed.groupBy("qid").agg(F.coalesce(F.try_divide(gain("rank"), gain("best")), F.lit(0.0)).alias("ndcg"))


def hit_rate(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Share of queries with at least one relevant document among the first k."""
    found = run.where(F.col("rank") <= k).join(qrels, ["qid", "doc_id"], "left_semi").select("qid").distinct().withColumn("hit", F.lit(1.0))
    return qrels.select("qid").distinct().join(found, "qid", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def by_category(per_query: DataFrame, categories: DataFrame, metrics: list[str]) -> DataFrame:
    """Means over all and by category, in one pass; the overall row has category ``overall``."""
    joined = per_query.join(categories, "qid")
    out = joined.rollup("category").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics], F.grouping("category").alias("g"))
    return out.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("category")).alias("category"), "n", *metrics)


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    kinds = F.array_intersect(a, b)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(kinds, F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def token_f1(p: Column, r: Column) -> Column:
    """Token overlap F1 of two columns of answer tokens; 0 if either side is empty."""
    same = overlap(p, r)
    return F.when((F.size(p) > 0) & (F.size(r) > 0), f1(same / F.size(p), same / F.size(r))).otherwise(F.lit(0.0))


def claim_support(need: Column, held: Column) -> Column:
    """Multiset recall of a claim's content words in those of a chunk; both are columns of tokens."""
    return F.coalesce(F.try_divide(overlap(need, held), F.size(need)), F.lit(0.0))


def faithfulness(answers: DataFrame, chunks: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Share of the claims of ``answers(qid, text)`` that some chunk of ``chunks(qid, text)`` supports."""
    parts = answers.select("qid", F.posexplode_outer(T.claims(F.col("text"))).alias("pos", "claim")).where("claim is not null").select("qid", "pos", T.content_tokens(F.col("claim")).alias("need"))
    held = chunks.select("qid", T.content_tokens(F.col("text")).alias("held"))
    scored = parts.join(held, "qid", "left").groupBy("qid", "pos").agg(F.max(F.coalesce(claim_support(F.col("need"), F.col("held")), F.lit(0.0))).alias("s"))
    return scored.groupBy("qid").agg(F.avg((F.col("s") >= threshold).cast("double")).alias("faithfulness"), F.count("*").alias("claims"))


def citation_scores(cited: Column, expected: Column) -> tuple[Column, Column]:
    """Precision and recall of cited ids."""
    both = F.size(F.array_intersect(cited, expected))
    return F.coalesce(F.try_divide(both, F.size(F.array_distinct(cited))), F.lit(0.0)), F.coalesce(F.try_divide(both, F.size(F.array_distinct(expected))), F.lit(0.0))


def check_regression(current: Column, baseline: Column, tolerance: float = 0.02) -> Column:
    """``skip`` without a baseline, ``error`` without a current value, ``fail`` for a relative drop beyond the tolerance, else ``pass``."""
    return F.when(baseline.isNull(), "skip").when(current.isNull(), "error").when(current < baseline - F.abs(baseline) * tolerance, "fail").otherwise("pass")


def verdict_for_gap(gap: Column) -> Column:
    """Buckets of a quality gap: under 0.3 a tie, under 1.0 slight, else clear."""
    return F.when(F.abs(gap) < 0.3, "tie").when(F.abs(gap) < 1.0, "slight").otherwise("clear")


def flip(verdict: Column) -> Column:
    return F.translate(verdict, "AB", "BA")


def perplexity(loss: Column, cap: float = 20.0) -> Column:
    return F.exp(F.least(loss, F.lit(cap)))


def bits_per_byte(loss: Column, bytes_per_token: Column) -> Column:
    return loss / math.log(2) / bytes_per_token


def top_k_filter(p: Column, k: int) -> Column:
    """Probabilities but for the k largest set to 0."""
    kth = F.element_at(F.sort_array(p, asc=False), F.least(F.lit(k), F.size(p)))
    return F.transform(p, lambda x: F.when(x >= kth, x).otherwise(F.lit(0.0)))


def top_p_filter(p: Column, mass: float) -> Column:
    """The nucleus: largest probabilities until their sum reaches ``mass``; the one that crosses it stays."""
    return F.transform(p, lambda x: F.when(F.aggregate(F.filter(p, lambda y: y > x), F.lit(0.0), lambda s, y: s + y) < mass, x).otherwise(F.lit(0.0)))


def min_p_filter(p: Column, share: float) -> Column:
    return F.transform(p, lambda x: F.when(x >= share * F.array_max(p), x).otherwise(F.lit(0.0)))


def group_advantages(rewards: DataFrame, eps: float = 1e-6) -> DataFrame:
    """``(reward - mean) / (std + eps)`` within each prompt; 0 where rewards are all alike."""
    w = Window.partitionBy("prompt")
    sd = F.stddev_pop("reward").over(w)
    return rewards.withColumn("advantage", F.when(sd == 0, F.lit(0.0)).otherwise((F.col("reward") - F.avg("reward").over(w)) / (sd + eps)))
