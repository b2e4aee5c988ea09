import pandas as pd
from pyspark.sql import functions as F

from granary.operators import chunking


def test_a_long_text_does_not_travel_with_its_chunks(spark):
    docs = spark.createDataFrame([(0, "alpha beta " * 400), (1, "gamma delta. alpha"), (2, None), (3, "")], "doc_id long, text string")
    found = chunking.late(docs, 8, 0)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInPandas" in x and "whole" in x]
    assert any("array" in x or "doc_id" in x for x in joins)
    rows = found.collect()
    assert len(rows) == 101 and {r.doc_id for r in rows} == {0, 1}
    whole, own = chunking._vectors(["gamma delta. alpha"])[0], chunking._vectors(["gamma delta. alpha"])[0]
    mixed = 0.3 * whole + 0.7 * own
    got = next(r.vector for r in rows if r.doc_id == 1)
    assert max(abs(a - b) for a, b in zip(got, mixed / (mixed @ mixed) ** 0.5, strict=True)) < 1e-12
    assert "whole#" not in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "text#" in x and "AS whole" in x)


def test_chunks_leave_in_bounded_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "One two three. Four five six. Seven eight nine. " * 5) for i in range(20)], "doc_id long, text string").coalesce(1)
    want = {tuple(r) for r in chunking.semantic(docs, 6).collect()}
    seen = []

    class Kept:
        def select(self, *c):
            return self

        def mapInPandas(self, run, schema):
            seen.extend(run([docs.toPandas()]))

    monkeypatch.setattr(chunking, "OUT_CHARS", 500)
    chunking.semantic(Kept(), 6)
    assert len(seen) > 5 and max(f["text"].str.len().sum() for f in seen) < 700
    assert {tuple(r) for r in pd.concat(seen).itertuples(index=False)} == want
    assert docs.agg(F.count("*")).first()[0] == 20
