import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_names_agree():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 180
    assert len(names - set(entry.oracle_sql())) <= 20


def test_entry_runs(spark):
    found = entry.entry(spark)
    rows = found.collect()
    assert found.columns == ["qid", "doc_id", "score", "rank"]
    assert len(rows) == 10 * spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    assert all(r.score > 0 and 1 <= r["rank"] <= 10 for r in rows)


def test_a_broken_dependency_is_no_missing_folder(monkeypatch):
    if entry.llm_queries is None:
        pytest.skip("the training-data operators aren't there")
    monkeypatch.setitem(sys.modules, "xxhash", None)
    for name in [m for m in sys.modules if m.startswith("granary.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    with pytest.raises(ImportError, match="xxhash"):
        importlib.reload(entry)
    monkeypatch.undo()
    importlib.reload(entry)


def test_missing_folders_leave_the_rest(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("granary.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "granary.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    importlib.reload(entry)
    assert entry.llm_queries is None and entry.corpus_pipeline is None
    assert not any(n.startswith("op") and n[2].isdigit() for n in entry.queries()) and len(entry.queries()) > 150
    monkeypatch.undo()
    importlib.reload(entry)
