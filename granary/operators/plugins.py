"""Seams for models: plain Python callables over lists, applied in Arrow batches.

Whatever a deployment plugs in (an encoder, a reranker, a judge, a parser) is a callable from a list to a list of equal length; it is made once per task by the
factory that is handed over, and sees batches, never single rows. Without a model, the deterministic ones here stand in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.types import _parse_datatype_string as parsed

from granary.operators import chunking

Factory = Callable[[], Callable[..., Sequence]]


def apply(rows: DataFrame, inputs: list[str], factory: Factory, output: str, kind: str, fallback: str | None = None) -> DataFrame:
    """``rows`` with a column that a model computes from the input columns, given as lists.

    ``fallback`` names a column whose value stands in for a batch in which the model fails; without it the failure is the task's.
    """
    schema = StructType([*rows.schema.fields, StructField(output, parsed(kind))])
    names = rows.columns

    def run(batches):
        model = factory()
        for batch in batches:
            columns = [batch.column(names.index(c)).to_pylist() for c in inputs]
            try:
                found = list(model(*columns))
            except Exception:
                if fallback is None:
                    raise
                found = batch.column(names.index(fallback)).to_pylist()
            if len(found) != batch.num_rows:
                raise ValueError(f"{len(found)} results for {batch.num_rows} rows")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa_kind)], [*names, output])

    pa_kind = _arrow(kind)
    return rows.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(parsed(kind))


def hashed_encoder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An encoder that needs no weights: hashed words and pairs of words, normalised."""
    return lambda texts: chunking._vectors([t or "" for t in texts], dim).tolist()


def with_vectors(rows: DataFrame, text: str = "text", factory: Factory | None = None, output: str = "vector", dim: int = 64) -> DataFrame:
    """Texts with their vectors ``array<double>``."""
    return apply(rows, [text], factory or (lambda: hashed_encoder(dim)), output, "array<double>")


def with_token_vectors(rows: DataFrame, text: str = "text", factory: Factory | None = None, output: str = "vectors", dim: int = 64) -> DataFrame:
    """Texts with a vector for each of their words, ``array<array<double>>``."""

    def own():
        return lambda texts: [chunking._vectors(t.lower().split(), dim).tolist() if t else [] for t in texts]

    return apply(rows, [text], factory or own, output, "array<array<double>>")


def with_term_weights(rows: DataFrame, factory: Factory, text: str = "text", output: str = "weights") -> DataFrame:
    """Texts with term weights ``map<string,double>``."""
    return apply(rows, [text], factory, output, "map<string,double>")


def score_pairs(pairs: DataFrame, factory: Factory, left: str = "question", right: str = "text") -> DataFrame:
    """``pairs`` with a model's ``score`` of the two texts."""
    return apply(pairs, [left, right], factory, "score", "double")


def judged(pairs: DataFrame, factory: Factory) -> DataFrame:
    """``pairs(question, answer_a, answer_b, context)`` with a judge's ``verdict``."""
    return apply(pairs, ["question", "answer_a", "answer_b", "context"], factory, "verdict", "string")


def generated(prompts: DataFrame, factory: Factory, prompt: str = "prompt") -> DataFrame:
    """Prompts with a model's ``completion``."""
    return apply(prompts, [prompt], factory, "completion", "string")


def captioned(figures: DataFrame, factory: Factory) -> DataFrame:
    """``figures(path, caption)`` with a model's ``described``; where it fails, the caption."""
    return apply(figures, ["path"], factory, "described", "string", fallback="caption")


def parsed_files(files: DataFrame, factory: Factory) -> DataFrame:
    """``files(path, content)`` (a binary file scan) with their ``text``."""
    return apply(files, ["path", "content"], factory, "text", "string")


def reranked(lists: DataFrame, factory: Factory, k: int = 5) -> DataFrame:
    """``lists(qid, question, doc_id, text, rank)``: whole lists in the order that a model gives as places, those it leaves out last; ``qid, doc_id, score, rank``.

    A list is one query's candidates, a bounded number. The score is the list's length less the new place.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        n = table.num_rows
        order = [i for i in dict.fromkeys(factory()(table.column("question")[0].as_py(), table.column("text").to_pylist())) if 0 <= i < n]
        order += [i for i in range(n) if i not in set(order)]
        taken = table.take(pa.array(order[:k], pa.int64()))
        return pa.table({"qid": taken.column("qid"), "doc_id": taken.column("doc_id"), "score": pa.array([float(n - i) for i in range(taken.num_rows)]), "rank": pa.array(range(1, taken.num_rows + 1), pa.int32())})

    return lists.select("qid", "question", "doc_id", "text", "rank").groupBy("qid").applyInArrow(run, "qid long, doc_id long, score double, rank int")


def order_of(text: str, count: int) -> list[int]:
    """Places that a model names in prose such as ``[2] > [1]``, counted from 1 there; those it leaves out follow in order."""
    import re

    named = [int(x) - 1 for x in re.findall(r"\d+", text)]
    found = list(dict.fromkeys(i for i in named if 0 <= i < count))
    return found + [i for i in range(count) if i not in found]


def first_parser(kinds: DataFrame, strategy: str = "structure") -> DataFrame:
    """``kinds(doc_id, kind)`` with the parsers to try, best first: ``doc_id, rank, parser``."""
    spark = kinds.sparkSession
    rows = [(k, i, p) for (k, s), ps in PARSERS.items() if s in (strategy, "any") for i, p in enumerate(ps)]
    table = F.broadcast(spark.createDataFrame(rows, "kind string, rank int, parser string"))
    known = F.when(F.col("kind").isin("pdf", "pdf_scanned"), F.col("kind")).otherwise("text")
    return kinds.withColumn("kind", known).join(table, "kind").select("doc_id", "rank", "parser")


# Parsers by kind of document and strategy, best first.
PARSERS = {
    ("pdf", "structure"): ["docling", "pymupdf4llm", "marker"],
    ("pdf", "fast"): ["pymupdf4llm", "docling", "marker"],
    ("pdf", "accurate"): ["marker", "docling", "pymupdf4llm"],
    ("pdf_scanned", "any"): ["surya", "paddleocr"],
    ("text", "any"): ["plaintext-fallback"],
}
