"""Seams for models, tools, shards, statements and evaluation sets."""

import time

import pytest
from pyspark.sql import functions as F

from granary.operators import ablation, ingest, judging, plugins, report, tiles, tools
from granary.sources import datasets, ddl, shards, writers


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_models_see_batches(spark):
    rows = docs(spark, ["a b", "c", None])
    assert [len(r.vector) for r in plugins.with_vectors(rows, dim=8).collect()] == [8, 8, 8]
    assert [len(r.vectors) for r in plugins.with_token_vectors(rows, dim=4).orderBy("doc_id").collect()] == [2, 1, 0]
    assert [r.score for r in plugins.score_pairs(rows.withColumn("question", F.lit("a")), lambda: lambda q, t: [float(len(x or "")) for x in t]).orderBy("doc_id").collect()] == [3.0, 1.0, 0.0]
    assert [r.weights for r in plugins.with_term_weights(rows, lambda: lambda ts: [{"x": 1.0}] * len(ts)).collect()] == [{"x": 1.0}] * 3
    assert [r.completion for r in plugins.generated(rows.select(F.col("text").alias("prompt")), lambda: lambda ps: ["ok"] * len(ps)).collect()] == ["ok"] * 3


def test_a_failing_captioner_leaves_the_caption(spark):
    figures = spark.createDataFrame([("a.png", "alt")], "path string, caption string")
    assert plugins.captioned(figures, lambda: lambda ps: 1 / 0).first().described == "alt"


def test_lists_in_a_new_order(spark):
    lists = spark.createDataFrame([(1, "q", 10 + i, f"t{i}", i + 1) for i in range(4)], "qid long, question string, doc_id long, text string, rank int")
    got = plugins.reranked(lists, lambda: lambda q, ts: plugins.order_of("[3] > [1] > [9]", len(ts)), k=3).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(12, 4.0), (10, 3.0), (11, 2.0)]


def test_parsers_by_kind(spark):
    kinds = spark.createDataFrame([(1, "pdf"), (2, "pdf_scanned"), (3, "markdown")], "doc_id long, kind string")
    got = {}
    for r in plugins.first_parser(kinds, "fast").orderBy("rank").collect():
        got.setdefault(r.doc_id, []).append(r.parser)
    assert got == {1: ["pymupdf4llm", "docling", "marker"], 2: ["surya", "paddleocr"], 3: ["plaintext-fallback"]}


def test_toolbox(spark):
    now, calls = [0.0], []
    box = tools.Toolbox(ttl=10, most=2, wait=0, clock=lambda: now[0])

    def flaky(args):
        calls.append(args)
        if len(calls) == 1:
            raise OSError("busy")
        return len(calls)

    box.register("flaky", flaky)
    assert box.call("flaky", {"a": 1}) == 2 and box.call("flaky", {"a": 1}) == 2 and len(calls) == 2
    now[0] = 11.0
    assert box.call("flaky", {"a": 1}) == 3
    for name, allowed in (("none", None), ("flaky", ["other"])):
        with pytest.raises(tools.ToolError):
            box.call(name, {}, allowed)
    full = tools.standard(spark)
    assert full.call("calculate", {"expression": "2 + 2"}) == 4
    spark.range(3).createOrReplaceTempView("three")
    assert full.call("query_database", {"sql": "SELECT count(*) AS n FROM three"}) == [{"n": 3}]
    with pytest.raises(tools.ToolError):
        full.call("query_database", {"sql": "DROP TABLE three"})


def test_a_slow_frame_is_cancelled(spark):
    slow = spark.range(4).repartition(4).select(F.call_function("java_method", F.lit("java.lang.Thread"), F.lit("sleep"), F.lit(20_000).cast("long")))
    began = time.time()
    with pytest.raises(TimeoutError):
        tools.collect_within(slow, 1.0)
    assert time.time() - began < 10


def test_shards_go_on_where_another_reader_stopped(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").alias("row"), F.array(F.col("id").cast("int")).alias("tokens"))
    writers.write_shards(rows, str(tmp_path), 10, 100)
    make = lambda **more: shards.ShardReader(spark, str(tmp_path), seed=3, batch=4, **more)
    one = make()
    ids = lambda f: sorted(r.row for r in f.collect())
    whole = [ids(one.next()) for _ in range(one.steps())]
    assert sorted(sum(whole, [])) == list(range(25)) and [len(w) for w in whole] == [4] * 6 + [1]
    first, other = make(), make()
    first.next()
    other.resume(first.state())
    assert ids(other.next()) == whole[1]
    ranks = [ids(make(rank=r, ranks=2).at(0)) for r in range(2)]
    assert sorted(sum(ranks, [])) == sorted(whole[0] + whole[1])
    with pytest.raises(ValueError, match="seed"):
        other.resume({**first.state(), "seed": 4})
    with pytest.raises(ValueError, match="changed"):
        other.resume({**first.state(), "fingerprint": "x"})


def test_statements():
    assert ddl.create_vectors("t", 8) == "CREATE TABLE IF NOT EXISTS t (doc_id TEXT PRIMARY KEY, embedding VECTOR(8), metadata JSONB)"
    assert "m = 16, ef_construction = 64" in ddl.create_graph_index("t") and ddl.set_search_width(40).endswith("= 40")
    assert "BIT(8)" in ddl.add_code_column("t", 8) and ddl.nearest("t", 3, "a = 1").index("WHERE") < ddl.nearest("t", 3, "a = 1").index("ORDER")
    assert ddl.nearest_then_filter("t", 3, "a = 1").endswith("WHERE a = 1") and ddl.rescored("t", 200, 10).count("LIMIT") == 2
    with pytest.raises(ValueError, match="table name"):
        ddl.create_vectors("t; DROP TABLE x", 8)


def test_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    one, again = (datasets.content_hash(f, ["id", "t"]).first() for f in (rows, rows.repartition(2).orderBy(F.desc("id"))))
    assert one == again and one.rows == 2 and one.hash != datasets.content_hash(rows.where("id = 1"), ["id", "t"]).first().hash
    path = tmp_path / "manifest.json"
    path.write_text('{"entries": {"a": {"rows": 2, "hash": "%s"}, "b": {"rows": 1, "hash": "x"}}}' % one.hash)
    actual = spark.createDataFrame([("a", one.hash), ("c", "y")], "name string, hash string")
    assert {r["name"]: r.status for r in datasets.verified(datasets.manifest(spark, str(path)), actual).collect()} == {"a": "ok", "b": "missing", "c": "unexpected"}


def test_unknown_candidates_are_an_error(spark):
    with pytest.raises(Exception, match="unknown candidate"):
        datasets.promote(spark.createDataFrame([("a", 1)], "id string, x int"), spark.createDataFrame([("b",)], "id string")).collect()


def test_tiles_equal_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(tiles, "VECTOR_ROWS", 30)
    monkeypatch.setattr(tiles, "QUERY_ROWS", 7)
    x = np.random.default_rng(1).standard_normal((100, 6))
    x[40:60] = x[0]
    vectors = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (200, None), (201, [0.0] * 6)], "doc_id long, v array<double>")
    queries = vectors.where("doc_id % 5 = 0 and doc_id < 100").selectExpr("doc_id as qid", "v as q")
    by = {}
    for r in tiles.nearest(vectors, queries, 4, "cosine").collect():
        by.setdefault(r.qid, []).append((r["rank"], r.doc_id))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 100, 5):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        assert [i for _, i in sorted(by[q])] == np.lexsort((np.arange(100), -s))[:4].tolist()


def test_report_names():
    assert report.ordered_metrics(["map", "x", "recall@5", "a"]) == ["recall@5", "map", "a", "x"]
    assert report.metric_names("ndcg_at_10") == ["ndcg_at_10", "ndcg@10"]


def test_gate_and_replay(spark):
    rows = spark.createDataFrame([(0.7,), (0.5,), (None,)], "k double").select(judging.gate(F.col("k"))).collect()
    assert [r[0] for r in rows] == [True, False, False]
    labels = spark.createDataFrame([(1, "A")], "id long, human string")
    assert {r.id: r.verdict for r in judging.replayed(labels, spark.createDataFrame([(1,), (2,)], "id long")).collect()} == {1: "A", 2: None}


def test_ingest(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\nSome words here.\n\n| a | b |\n|---|---|\n| 1 | 2 |")
    (tmp_path / "b.bin").write_text("no")
    found = ingest.ingest_files(spark, str(tmp_path), "fixed", 4)
    assert [r.kind for r in found.blocks.orderBy("ord").collect()] == ["heading", "paragraph", "table"]
    assert found.cells.count() == 4 and found.stats.first().n == found.chunks.count()


def test_relevance(spark):
    row = spark.createDataFrame([("Alpha beta", ["alpha", "beta", "x"], True), ("alpha", ["alpha", "beta"], True), ("alpha beta", ["alpha"], False)], "t string, k array<string>, s boolean")
    assert [r[0] for r in row.select(ablation.relevance(F.col("t"), F.col("k"), F.col("s"))).collect()] == [1.0, 0.0, 0.0]
