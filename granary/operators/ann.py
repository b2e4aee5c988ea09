"""Vector search with quantisation, cells and metadata filters, and how much recall each keeps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import vector as V
from granary.operators import tiles
from granary.operators.curate import _ensure_checkpoint
from granary.operators.retrieval import top


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact k nearest of ``vectors(doc_id, v)`` by cosine for each of the stated ``queries(qid, q)``."""
    return tiles.nearest(vectors, queries, k, "cosine")


def prefiltered(vectors: DataFrame, queries: DataFrame, condition: str, k: int) -> DataFrame:
    """Filter, then rank."""
    return exact(vectors.where(condition), queries, k)


def postfiltered(vectors: DataFrame, queries: DataFrame, condition: str, k: int, pool: int | None = None) -> DataFrame:
    """Rank, take a pool (k by default), then filter: loses what the pool misses."""
    taken = exact(vectors, queries, pool or k).drop("rank")
    return top(taken.join(vectors.where(condition).select("doc_id"), "doc_id").select("qid", "doc_id", "score"), k)


def hamming_rescored(vectors: DataFrame, queries: DataFrame, dim: int, pool: int, k: int) -> DataFrame:
    """Best ``pool`` by sign bits, then the best k of those by cosine."""
    near = tiles.nearest(vectors, queries, pool, "hamming", dim)
    return top(tiles.with_vectors(near, vectors, queries, F.round(V.cosine(F.col("v"), F.col("q")), 12)), k)


def int8(vectors: DataFrame, column: str = "v") -> DataFrame:
    """Vectors as whole numbers of one scale, ``max |component| / 127``."""
    scale = vectors.agg((F.max(F.array_max(F.transform(column, lambda x: F.abs(x)))) / 127.0).alias("scale"))
    return vectors.crossJoin(F.broadcast(scale)).withColumn(column, V.dequantize(V.quantize_int8(F.col(column), F.col("scale")), F.col("scale"))).drop("scale")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean share of the true neighbours that were found."""
    hits = truth.join(found.select("qid", "doc_id").withColumn("hit", F.lit(1.0)), ["qid", "doc_id"], "left")
    return hits.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("r")).agg(F.avg("r").alias("recall"))


def storage(rows: int, patches: int = 1024, dim: int = 128) -> dict[str, float]:
    """Bytes of float32, int8 and binary vectors, and the ratios."""
    full = rows * patches * dim * 4
    return {"float32": full, "int8": full / 4, "binary": full / 32, "int8_ratio": 4.0, "binary_ratio": 32.0}


class InvertedFile:
    """Cells of k-means centroids: a query looks at the vectors of its nearest cells.

    The centroids are fitted on a bounded sample on the driver; every vector is assigned to its cell.
    """

    def __init__(self, vectors: DataFrame, cells: int = 16, sample_rows: int = 20_000, seed: int = 1, rounds: int = 12):
        share = max(1, min(1 << 20, (1 << 20) * sample_rows // max(1, vectors.count())))
        rows = vectors.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < share).select("doc_id", "v").collect()
        x = np.array([r["v"] for r in sorted(rows, key=lambda r: r["doc_id"])], float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        self.centroids = x[rng.permutation(len(x))[:cells]]
        for _ in range(rounds):
            near = (x @ self.centroids.T).argmax(1)
            for c in range(len(self.centroids)):
                if (near == c).any():
                    mean = x[near == c].mean(0)
                    self.centroids[c] = mean / max(np.linalg.norm(mean), 1e-12)
        self.table = self._placed(vectors, "doc_id", "v", 1)

    def _placed(self, table: DataFrame, key: str, column: str, cells: int) -> DataFrame:
        centroids = self.centroids

        def run(batches):
            for batch in batches:
                x = tiles._matrix(pa.chunked_array([batch.column(1)])) if batch.num_rows else np.zeros((0, 1))
                order = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :cells] if batch.num_rows else np.zeros((0, 1), int)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order.tolist(), pa.list_(pa.int32()))], [key, column, "cells"])

        return table.select(key, column).mapInArrow(run, f"{key} long, {column} array<double>, cells array<int>").select(key, column, F.explode("cells").alias("cell"))

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        asked = self._placed(queries, "qid", "q", probes)
        return tiles.nearest_in(self.table, asked, "cell", k, "cosine")

    def curve(self, queries: DataFrame, truth: DataFrame, k: int, probes: list[int]) -> DataFrame:
        """Recall by number of cells looked at."""
        _ensure_checkpoint(truth.sparkSession)
        truth = truth.checkpoint()  # one exact search for all rows of the curve
        out = None
        for n in probes:
            row = recall(self.search(queries, k, n), truth).select(F.lit(n).alias("probes"), "recall")
            out = row if out is None else out.unionByName(row)
        return out


def sign_maxsim(doc_tokens: DataFrame, query_tokens: DataFrame, dim: int, k: int = 10) -> DataFrame:
    """MaxSim over sign bits: ``1 - 2 * hamming / dim`` in place of the dot product."""
    from granary.operators import late

    return late.exact(doc_tokens.withColumn("v", F.slice("v", 1, dim)), query_tokens.withColumn("q", F.slice("q", 1, dim)), k, signs=True)


def quantize_int4(column, group: int = 64):
    """Groups of components as whole numbers of -7..7 with a scale each: ``array<struct<scale, q>>``."""
    groups = F.transform(F.sequence(F.lit(1), F.size(column), F.lit(group)), lambda i: F.slice(column, i, group))
    scale = lambda g: F.greatest(F.array_max(F.transform(g, lambda x: F.abs(x))) / 7.0, F.lit(1e-12))
    return F.transform(groups, lambda g: F.struct(scale(g).alias("scale"), F.transform(g, lambda x: F.bround(x / scale(g)).cast("int")).alias("q")))


def window_rank(scored: DataFrame) -> DataFrame:
    """Ranks from 1 of ``arm, qid, doc_id, score``."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("arm", "qid").orderBy(F.desc("score"), "doc_id")))
