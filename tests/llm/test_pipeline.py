import corpus_pipeline
import pytest

from granary.llm import scratch

FOLDER = "/root/testdata/sf0.001"
KEEPING = corpus_pipeline.STAGES[:-1]


def test_pipeline_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.dtypes
    for name, stage in KEEPING:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.dtypes == columns, name
        assert docs.count() > 0
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_run_sweeps_up_what_its_stages_made(spark):
    before = scratch.mark(spark)
    pieces = corpus_pipeline.run(spark, FOLDER)
    assert pieces.count() > 0
    assert scratch.mark(spark) - before <= 2  # the last documents and what packing reads
    scratch.sweep(spark, before)


SENTENCE = "The quiet house stands near a river and people walk there often in the evening, as they did before. "


def odd_rows(spark):
    long_ = " ".join(f"word{i}" for i in range(30_000)) + "."
    rows = [(1, SENTENCE * 3), (1, SENTENCE * 3), (2, None), (2, None), (3, ""), (None, SENTENCE + "Another end of it."), (None, None), (4, long_), (5, long_)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "null as source", "cast(length(text) as bigint) as n_chars", "1 as score", "'c' as comp", "0 as block_id")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], odd_rows(spark)
    assert stage(spark, docs.where("false"), FOLDER).count() == 0
    rows = stage(spark, docs, FOLDER).collect()
    if name == "packing":
        assert sorted({r.doc_id for r in rows if r.doc_id is not None}) == [1, 2, 3, 4, 5] and sum(r.piece == 0 for r in rows) == 9
        return
    assert rows[0].__fields__ == docs.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:4]) for r in rows)
    if name == "quality":
        assert len(rows) <= 9
    elif name == "near_duplicates":  # one of each set of shingles, one of each empty document
        assert kept == [(False, 1, "The "), (False, 2, ""), (False, 3, ""), (False, 4, "word"), (True, 0, ""), (True, 0, "The ")]
    else:
        assert len(rows) == 9 and all(r.n_chars == len(r.text) for r in rows)
        assert sum(len(r.text) for r in rows if r.doc_id == 1) < 2 * len(SENTENCE) and [len(r.text) for r in rows if r.doc_id == 5] == [0]
