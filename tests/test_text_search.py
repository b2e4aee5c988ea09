import random

import pytest
from pyspark.sql import functions as F

from granary.operators import curate, retrieval, text_search


def _texts(n, seed=5):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("a b c d e f g h i j k the the the".split()) for _ in range(rng.randint(0, 30)))) for i in range(n)]


def _plain(spark, docs, queries, k):
    return {tuple(r) for r in retrieval.top(retrieval._joined(docs, retrieval.query_terms(queries), 1.5, 0.75), k).collect()}


def _shuffles(frame):
    """Columns that the exchanges of a plan are dealt by."""
    return [x for x in frame._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]


def test_blocks_rank_as_the_join_does(spark, monkeypatch):
    docs = spark.createDataFrame([*_texts(300), (900, None), (901, ""), *[(1000 + i, "a the") for i in range(40)]], "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(7, "a b the the"), (8, "k"), (9, "zzz"), (10, "c d e")], "qid long, text string")
    for cells, group in ((4_000_000, 256), (6, 2)):  # one product, and many small ones
        monkeypatch.setattr(text_search, "CELLS", cells)
        monkeypatch.setattr(text_search, "GROUP", group)
        got = {tuple(r) for r in retrieval.bm25(docs, queries, 5).collect()}
        want = _plain(spark, docs, queries, 5)
        assert {r[:2] + r[3:] for r in got} == {r[:2] + r[3:] for r in want} and sorted(r[2] for r in got) == pytest.approx(sorted(r[2] for r in want))
        sparse = retrieval.sparse_search(retrieval.sparse_weights(docs, "doc_id"), retrieval.sparse_weights(queries, "qid"), 5)
        assert {tuple(r) for r in retrieval.term_search(docs, queries, 5).collect()} == {tuple(r) for r in sparse.collect()}


def test_no_pair_of_query_and_document_is_shuffled(spark):
    docs = spark.createDataFrame(_texts(200), "doc_id long, text string")
    queries = spark.createDataFrame([(i, "a b c the") for i in range(20)], "qid long, text string")
    for found in (retrieval.bm25(docs, queries, 5), retrieval.term_search(docs, queries, 5)):
        assert not any("doc_id" in x for x in _shuffles(found))


def test_many_query_terms_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame(_texts(50), "doc_id long, text string")
    queries = spark.createDataFrame([(7, "a b the the"), (8, "k")], "qid long, text string")
    want = {tuple(r) for r in retrieval.bm25(docs, queries, 5).collect()}
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 1)
    assert {r[:2] for r in want} == {tuple(r)[:2] for r in retrieval.bm25(docs, queries, 5).collect()}


def test_only_texts_that_may_share_are_cut_into_ngrams(spark):
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(40)
    evals = spark.createDataFrame([(1, " ".join(word() for _ in range(30))), (2, "w1 w2")], "item_id long, text string")
    passage = evals.where("item_id = 1").first()["text"].split()
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(100)] + [(200, "x y " + " ".join(passage[4:9]) + " z"), (201, " ".join(passage[4:8]) + " w0"), (202, None), (203, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    words = docs.select("doc_id", F.split("text", " ").alias("w"))
    held = {r.doc_id for r in curate._holding(words, evals, 5).collect()}
    grams = {tuple(passage[i : i + 5]) for i in range(26)}
    want = {i for i, t in rows if t and any(tuple(t.split()[j : j + 5]) in grams for j in range(len(t.split())))}
    assert held == want and 200 in held and 202 not in held
    assert {r.doc_id for r in curate.contaminated_ids(docs, evals, 5).collect()} == want


def test_cells_are_searched_in_products(spark):
    from granary.operators import ann, tiles

    rng = random.Random(2)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)], "doc_id long, v array<double>")
    q = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("v").alias("q"))
    index = ann.InvertedFile(v, cells=4)
    found = index.search(q, 5, 4)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    key = lambda rows: {(r.qid, r["rank"], r.doc_id) for r in rows.collect()}
    assert key(found) == key(ann.exact(v, q, 5))
    cells = {r.doc_id: r.cell for r in index.table.collect()}
    mine = {r.qid: r.cell for r in index._placed(q, "qid", "q", 1).collect()}
    assert all(cells[r.doc_id] == mine[r.qid] for r in index.search(q, 5, 1).collect())
    assert tiles.nearest_in(index.table.where("false"), index._placed(q, "qid", "q", 1), "cell", 5).count() == 0
