import math
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import metrics, retrieval, stats


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "a b b"), (1, "b c c c")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "b"), (1, "b c")], "qid long, text string")
    got = {(r.qid, r.doc_id): r.score for r in retrieval.bm25(docs, q).collect()}
    assert got[0, 0] == pytest.approx(0.27299484439736516)
    assert got[0, 1] == pytest.approx(0.17130884530975599)
    assert got[1, 1] == pytest.approx(1.2867181013832312)


def test_bm25_rounds_before_the_cut(spark):
    docs = spark.createDataFrame([(0, "b c d"), (1, "b c")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "b")], "qid long, text string")
    assert [r.doc_id for r in retrieval.bm25(docs, q, k=1, b=1e-12).collect()] == [0]


def test_context_is_found_by_whole_items(spark, tmp_path):
    from granary.plans import catalogue

    spark.createDataFrame([(1, "a b c d e f target")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(7, "the target here"), (8, "nothing")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalogue.rendered_context(spark, str(tmp_path)).collect()
    assert [r.qid for r in rows] == [1] and "the target here" in rows[0].context


def test_zero_scores_fill_up(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "b")], "qid long, text string")
    assert [r.doc_id for r in retrieval.bm25(docs, q, with_zero=True).orderBy("rank").collect()] == [1, 0, 2]


def test_rank_fusion(spark):
    arm = lambda ids: spark.createDataFrame([(0, i, 1.0 / (k + 1), k + 1) for k, i in enumerate(ids)], "qid long, doc_id long, score double, rank int")
    got = {r.doc_id: r.score for r in retrieval.reciprocal_rank_fusion({"a": arm([1, 2]), "b": arm([1, 3])}).collect()}
    assert got == pytest.approx({1: 2 / 61, 2: 1 / 62, 3: 1 / 62})


def test_ranking_metrics(spark):
    run = spark.createDataFrame([(0, d, r) for r, d in enumerate([9, 1, 8, 2], 1)], "qid long, doc_id long, rank int")
    rel = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (5, 7)], "qid long, doc_id long")
    rows = {r.qid: r for r in metrics.ranking_metrics(run, rel, 10).collect()}
    assert rows[0].recall == pytest.approx(2 / 3)
    assert rows[0].rr == 0.5
    assert rows[0].ap == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert rows[0].ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3) + 1 / 2))
    assert rows[5].recall == 0.0


def test_kappa(spark):
    pairs = spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15, "a string, b string")
    assert stats.kappa(pairs, "a", "b").first().kappa == pytest.approx(0.4)
    assert stats.kappa(pairs.select(F.lit("x").alias("a"), F.lit("x").alias("b")), "a", "b").first().kappa == 1.0


def test_wilcoxon(spark):
    rng = random.Random(4)
    groups = {"exact": [1.0, 2.0, 3.0], "zeros": [0.0, 0.0], "ties": [1.0, 1.0, -2.0, 3.0, 0.0, 4.0], "long": [rng.gauss(0.3, 1) for _ in range(60)]}
    rows = [(g, d, 0.0) for g, ds in groups.items() for d in ds]
    got = {r.g: (r.n, r.p) for r in stats.wilcoxon(spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y").collect()}
    assert got["exact"] == (3, 0.25) and got["zeros"] == (0, 1.0)
    for g in ("ties", "long"):
        d = [x for x in groups[g] if x]
        sizes = sorted(map(abs, d))
        rank = lambda x: (sizes.index(abs(x)) + 1 + len(sizes) - sizes[::-1].index(abs(x))) / 2  # noqa: B023, E731
        w, n = min(sum(rank(x) for x in d if x > 0), sum(rank(x) for x in d if x < 0)), len(d)
        var = n * (n + 1) * (2 * n + 1) / 24 - sum(sizes.count(s) ** 3 - sizes.count(s) for s in set(sizes)) / 48
        assert got[g][1] == pytest.approx(math.erfc((abs(w - n * (n + 1) / 4) - 0.5) / math.sqrt(2 * var)), abs=1e-9)


def test_erfc(spark):
    xs = [0.0, 0.1, 0.7, 1.5, 2.5, 3.3, 4.4, 5.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stats.erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], abs=1e-8)


def test_seeds():
    assert stats.require_seeds([3, 1, 2, 1]) == [1, 2, 3] and stats.normal_quantile(0.975) == pytest.approx(stats.Z)
    with pytest.raises(ValueError, match="seeds"):
        stats.require_seeds([1, 1, 2])
