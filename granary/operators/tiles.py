"""Stated queries against all vectors, in tiles: blocks of vectors meet blocks of queries, a matrix product each.

A tile keeps the k best of each of its queries, so what leaves it is short. Blocks are dealt by a hash of the id; their number grows with the
tables, their size does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR_ROWS, QUERY_ROWS = 16_384, 2_048


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _scores(x: np.ndarray, q: np.ndarray, measure: str, dim: int | None) -> np.ndarray:
    if dim is not None:
        x, q = x[:, :dim], q[:, :dim]
    if measure == "hamming":  # signs that agree less those that differ
        x, q = np.where(x > 0, 1.0, -1.0), np.where(q > 0, 1.0, -1.0)
        return -(x.shape[1] - q @ x.T) / 2
    if measure == "cosine":
        length = lambda m: np.sqrt((m * m).sum(1, keepdims=True))
        both = length(q) * length(x).T
        return np.divide(q @ x.T, both, out=np.zeros(both.shape), where=both > 0)
    return q @ x.T


def _tile(k: int, measure: str, dim: int | None, digits: int):
    """What a tile does: the k best of its vectors for each of its queries."""

    def tile(table: pa.Table) -> pa.Table:
        mask = table.column("asks").to_numpy()
        empty = pa.table({"qid": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not mask.any() or mask.all():
            return empty
        ids, x = table.column("id").to_numpy(), _matrix(table.column("v"))
        order = np.argsort(ids[~mask], kind="stable")
        doc_ids, docs = ids[~mask][order], x[~mask][order]
        out = []
        for at in range(0, int(mask.sum()), 256):
            qids = ids[mask][at : at + 256]
            scores = np.round(_scores(docs, x[mask][at : at + 256], measure, dim), digits)
            scores[qids[:, None] == doc_ids[None, :]] = -np.inf
            for qid, row in zip(qids, scores, strict=True):
                some = np.arange(len(row))
                if len(row) > 4 * k:
                    some = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                best = some[np.argsort(-row[some], kind="stable")[:k]]
                best = best[np.isfinite(row[best])]
                out.append((np.full(len(best), qid), doc_ids[best], row[best]))
        qid, doc, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"qid": pa.array(qid, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score)})

    return tile


def nearest(vectors: DataFrame, queries: DataFrame, k: int, measure: str = "dot", dim: int | None = None, digits: int = 12) -> DataFrame:
    """The k best of ``vectors(doc_id, v)`` for each of ``queries(qid, q)``: ``qid, doc_id, score, rank``; ties to the smaller ``doc_id``, never the query's own id.

    ``measure``: dot, cosine (0 for a zero vector) or hamming (of signs, negative); ``dim``: of the first components only. Scores have ``digits`` digits
    when they are ranked. Rows with a null id or vector take no part.
    """
    from granary.operators.retrieval import top

    vectors = vectors.where("doc_id is not null and v is not null").select("doc_id", "v")
    queries = queries.where("qid is not null and q is not null").select("qid", "q")
    many, asked = vectors.count(), queries.count()
    rows, groups = max(1, -(-many // VECTOR_ROWS)), max(1, -(-asked // QUERY_ROWS))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(dealt("doc_id", rows).alias("b"), every(groups).alias("g"), F.col("doc_id").alias("id"), "v", F.lit(False).alias("asks"))
    right = queries.select(every(rows).alias("b"), dealt("qid", groups).alias("g"), F.col("qid").alias("id"), F.col("q").alias("v"), F.lit(True).alias("asks"))

    found = left.unionByName(right).groupBy("b", "g").applyInArrow(_tile(k, measure, dim, digits), "qid long, doc_id long, score double")
    return top(found, k)


def nearest_in(vectors: DataFrame, queries: DataFrame, by: str, k: int, measure: str = "dot", digits: int = 12) -> DataFrame:
    """``nearest`` where a query meets only the vectors that have its ``by``: a column of both sides, in which a query may stand several times, a vector once."""
    from granary.operators.retrieval import top

    vectors = vectors.where("doc_id is not null and v is not null")
    queries = queries.where("qid is not null and q is not null")
    parts = vectors.groupBy(by).agg(F.ceil(F.count("*") / VECTOR_ROWS).cast("int").alias("rows")).join(queries.groupBy(by).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("groups")), by)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = vectors.join(parts, by).select(by, dealt("doc_id", "rows").alias("b"), every("groups").alias("g"), F.col("doc_id").alias("id"), "v", F.lit(False).alias("asks"))
    right = queries.join(parts, by).select(by, every("rows").alias("b"), dealt("qid", "groups").alias("g"), F.col("qid").alias("id"), F.col("q").alias("v"), F.lit(True).alias("asks"))
    found = left.unionByName(right).groupBy(by, "b", "g").applyInArrow(_tile(k, measure, None, digits), "qid long, doc_id long, score double")
    return top(found, k)


def with_vectors(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, score: Column) -> DataFrame:
    """``pairs(qid, doc_id)`` scored on their vectors ``v`` and ``q``, by equi-joins."""
    return pairs.select("qid", "doc_id").join(vectors.select("doc_id", "v"), "doc_id").join(queries.select("qid", "q"), "qid").select("qid", "doc_id", score.alias("score"))
