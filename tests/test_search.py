"""Graph search, pruned indexes and caches in order of time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import ann, block_max, graph_search, late, retrieval


def clustered(n, dim=16, clusters=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return [(i, (centres[rng.integers(clusters)] + 0.6 * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_graph_search_finds_neighbours(spark):
    rows = clustered(900)
    vectors = spark.createDataFrame([*rows, (2000, None), (None, rows[0][1])], "doc_id long, v array<double>").selectExpr("*", "1 as score", "'x' as neighbours")
    queries = vectors.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("v").alias("q"))
    graph = graph_search.build_graph(vectors, degree=10, keep=20)
    assert graph.select(F.max(F.size("neighbours"))).first()[0] <= 22
    truth = ann.exact(vectors.select("doc_id", "v"), queries, 10)
    curve = {r.width: r for r in graph_search.recall_curve(graph_search.beam_search(graph, vectors, queries, 10, [10, 60]), truth).collect()}
    assert curve[60].recall >= 0.95 and curve[10].recall <= curve[60].recall
    assert curve[10].scored < curve[60].scored < 900


def test_graph_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, v array<double>")
    graph = graph_search.build_graph(none)
    assert graph.count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, q array<double>")
    assert graph_search.beam_search(graph, none, one, 5, [10]).count() == 0


def test_graph_starts_near(spark):
    """Few rounds are needed, as the start alone finds most of the links."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(100, 16))[:, None] + 0.2 * rng.normal(size=(100, 20, 16))).reshape(-1, 16)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = graph_search.neighbour_links(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, v array<double>"), 10, rounds=0).collect()
    near = np.argsort(-(x @ x.T) + 9 * np.eye(len(x)), axis=1)[:, :10]
    assert len(links) == 20_000
    assert len({(r.doc_id, r.other) for r in links} & {(i, int(j)) for i, row in enumerate(near) for j in row}) >= 16_000


def test_beam_search_walks_as_by_hand(spark):
    """Every search is a row that is read off at its end: nothing seen is compared or counted again."""
    rows = clustered(200, seed=4)
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame(rows, "doc_id long, v array<double>")
    links = {i: [(i + s) % 200 for s in (1, 7, 31, 90)] for i in range(200)}
    graph = spark.createDataFrame(list(links.items()), "doc_id long, neighbours array<long>")
    queries = vectors.where("doc_id % 50 = 3").select(F.col("doc_id").alias("qid"), F.col("v").alias("q"))
    entries = [r[0] for r in vectors.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(graph_search.ENTRIES).select("doc_id").collect()]
    found = graph_search.beam_search(graph, vectors, queries, 5, [3, 12])
    want = set()
    for q in range(3, 200, 50):
        far = {i: (-round(float(x[i] @ x[q]), 9), i) for i in range(200)}
        for width in (3, 12):
            seen = sorted((i for i in entries if i != q), key=far.get)[:8]
            beam, done, looked = seen[:width], set(), graph_search.ENTRIES
            while ahead := [i for i in beam if i not in done]:
                done |= set(ahead)
                new = {j for i in ahead for j in links[i]} - set(seen) - {q}
                seen, looked = [*seen, *new], looked + len(new)
                beam = sorted([*beam, *new], key=far.get)[:width]
            want |= {(width, q, i, at + 1, looked) for at, i in enumerate(beam[:5])}
    assert {(r.width, r.qid, r.doc_id, r["rank"], r.scored) for r in found.collect()} == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def brute_late(docs, asked, k):
    out = {}
    for qid, qs in asked.items():
        scores = [(-round(float(sum(max(np.dot(v, q) for v in vs) for q in qs)), 9), i) for i, vs in docs.items()]
        out[qid] = [i for _, i in sorted(scores)[:k]]
    return out


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(e.totalShuffleWrite() for e in (lambda found: [found.apply(i) for i in range(found.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))


def test_pruned_late_search_shuffles_what_it_chooses(spark):
    rng = np.random.default_rng(5)
    tokens = spark.createDataFrame([(i, v.tolist()) for i in range(2000) for v in rng.normal(size=(2, 4))], "doc_id long, v array<double>")
    wanted = spark.createDataFrame([(q, j, v.tolist()) for q in range(100) for j, v in enumerate(rng.normal(size=(2, 4)))], "qid long, pos int, q array<double>")
    index = late.LateIndex(tokens, centroids=40)
    before = shuffled(spark)
    found = index.search(wanted, 5, probes=40, pool=20, final=10).collect()
    # Every query meets every document: 200,000 pairs.
    assert len(found) == 500 and {r.met for r in found} == {2000}
    assert shuffled(spark) - before < 1_500_000


def test_late_interaction(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 8))
    docs = {i: centres[rng.integers(0, 10, rng.integers(1, 6))] + 0.3 * rng.normal(size=(1, 8)) for i in range(250)}
    asked = {q: centres[rng.integers(0, 10, 3)] + 0.2 * rng.normal(size=(3, 8)) for q in range(12)}
    tokens = spark.createDataFrame([*((i, v.tolist()) for i, vs in docs.items() for v in vs), (None, [1.0] * 8), (9999, None)], "doc_id long, v array<double>")
    wanted = spark.createDataFrame([(q, j, v.tolist()) for q, vs in asked.items() for j, v in enumerate(vs)], "qid long, pos int, q array<double>")
    truth = brute_late(docs, asked, 10)
    found = late.exact(tokens, wanted, 10)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()
    by = lambda f: {q: [r.doc_id for r in sorted(rows, key=lambda r: r.rank)] for q, rows in ((q, [r for r in f if r.qid == q]) for q in asked)}
    assert by(found.collect()) == truth
    pruned = late.LateIndex(tokens, centroids=24).search(wanted, 10, probes=6, pool=80, final=40)
    some = by(pruned.collect())
    assert sum(len(set(some[q]) & set(truth[q])) for q in asked) >= 0.95 * 120
    assert late.recall(pruned, found, 250).first().met < 1
    signs = {q: [-round(float(sum(max((np.sign(v) * np.sign(x)).sum() / 8 for v in docs[i]) for x in asked[q])), 9) for i in range(250)] for q in asked}
    want = {q: sorted(range(250), key=lambda i: (signs[q][i], i))[:5] for q in asked}
    assert by(ann.sign_maxsim(tokens, wanted, 8, 5).collect()) == want


def test_block_max_search_equals_the_exhaustive_one(spark):
    rng = random.Random(5)
    words = [f"w{int(40 * rng.random() ** 2)}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(300)] + [(400, None), (401, ""), (402, "alone here")]
    queries = spark.createDataFrame([(q, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for q in range(20)] + [(77, "alone"), (78, "nowhere"), (79, None)], "qid long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    index = block_max.ImpactIndex(table)
    key = lambda r: (r.qid, r.rank, r.doc_id, round(r.score, 8))
    want = retrieval.bm25(table, queries, 5).where("score > 0")
    assert sorted(map(key, index.search(queries, 5).collect())) == sorted(map(key, want.collect()))
    assert 0 < index.read_share(queries, 5).first().share < 1


def test_block_max_sends_a_document_once(spark, monkeypatch):
    """A row for each document, not for each posting; blocks over several batches and queries in portions give the same."""
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{int(30 * rng.random() ** 2)}" for _ in range(rng.randint(1, 30)))) for i in range(200)] + [(400, None), (401, "")]
    queries = spark.createDataFrame([(q, f"w{q} w{q % 7} w{q % 3} w{q % 3}") for q in range(25)], "qid long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    index = block_max.ImpactIndex(table)
    assert index.rows.count() == 200
    key = lambda r: (r.qid, r.rank, r.doc_id, round(r.score, 8))
    want, share = sorted(map(key, retrieval.bm25(table, queries, 5).collect())), index.read_share(queries, 5).first()
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    monkeypatch.setattr(block_max, "BROADCAST_TERMS", 20)
    try:
        spark.conf.set(batch, "7")
        assert sorted(map(key, index.search(queries, 5).collect())) == want
        assert index.read_share(queries, 5).first() == share
    finally:
        spark.conf.set(batch, before)
