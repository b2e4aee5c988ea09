"""Late interaction: a document's score is, summed over the query's vectors, the best match among the document's.

Exact scores come from blocks: documents' vectors meet the vectors of a block of queries in matrix products. The pruned search looks at few documents: a query's vectors
name their nearest centroids, documents with vectors there are candidates, sums of centroid scores choose among those, residual codes among the
rest, and only what is left is scored on its vectors. Candidates are counted by score in the blocks first, so that hardly more than the chosen ones leave them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import vector as V
from granary.operators.curate import _ensure_checkpoint
from granary.operators.retrieval import top

#: Vectors of documents and of queries in a block, queries whose counts travel together, and ranges of scores that are counted.
BLOCK_VECTORS, BLOCK_QUERIES, PART, BINS = 65_536, 16_384, 256, 256


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _tiled(docs: DataFrame, asked: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``docs(id)`` and ``asked(id)``, with the other columns of either, grouped in tiles ``b, g`` of a block of each; ``asks`` tells them apart."""
    vectors, queries = docs.count(), asked.count()
    groups = max(1, -(-queries // BLOCK_QUERIES))
    # Smaller blocks of documents repeat the queries only.
    rows = max(1, -(-vectors // BLOCK_VECTORS), -(-2 * docs.sparkSession.sparkContext.defaultParallelism // groups))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = docs.select(dealt(rows).alias("b"), every(groups).alias("g"), F.lit(False).alias("asks"), *docs.columns)
    right = asked.select(every(rows).alias("b"), dealt(groups).alias("g"), F.lit(True).alias("asks"), *asked.columns)
    return left.unionByName(right, allowMissingColumns=True).groupBy("b", "g")


def _starts(ids: np.ndarray) -> np.ndarray:
    """Where each run of equal ids begins."""
    return np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest, the largest first, ties in order of place."""
    some = np.arange(len(scores))
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.argsort(-scores[some], kind="stable")[:k]]


def exact(doc_tokens: DataFrame, query_tokens: DataFrame, k: int = 10, signs: bool = False, digits: int = 9) -> DataFrame:
    """``qid, doc_id, score, rank``: the best of ``doc_tokens(doc_id, v)`` for the stated ``query_tokens(qid, q)``, all documents scored.

    ``signs``: by sign bits, ``1 - 2 * hamming / dim`` in place of the dot product. Scores have ``digits`` digits when they are ranked. Rows with a null id or vector take no part.
    """
    docs = doc_tokens.where("doc_id is not null and v is not null").select(F.col("doc_id").alias("id"), "v")
    asked = query_tokens.where("qid is not null and q is not null").select(F.col("qid").alias("id"), F.col("q").alias("v"))

    def block(table: pa.Table) -> pa.Table:
        mask = table.column("asks").to_numpy()
        empty = pa.table({"qid": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not mask.any() or mask.all():
            return empty
        ids, x = table.column("id").to_numpy(), _rows(table.column("v"))
        if signs:
            x = np.where(x > 0, 1.0, -1.0) / np.sqrt(x.shape[1])
        order = np.flatnonzero(~mask)[np.argsort(ids[~mask], kind="stable")]
        docs_, v = ids[order], x[order]
        starts = _starts(docs_)
        order = np.flatnonzero(mask)[np.argsort(ids[mask], kind="stable")]
        qids, asks = ids[order], x[order]
        edges, out = _starts(qids), []
        for a, e in zip(edges, [*edges[1:], len(qids)], strict=True):
            scores = np.round(np.maximum.reduceat(v @ asks[a:e].T, starts, axis=0).sum(axis=1), digits)
            best = _best(scores, k)
            out.append((np.full(len(best), qids[a]), docs_[starts][best], scores[best]))
        qid, doc, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"qid": pa.array(qid, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score)})

    return top(_tiled(docs, asked).applyInArrow(block, "qid long, doc_id long, score double"), k)


class LateIndex:
    """Centroids, the documents that have vectors near each, and every vector's residual in codes of four bits.

    Centroids (16 times the square root of the number of vectors, 4,096 at most) and code levels are fitted on about ``sample_rows`` vectors on the driver; every vector is indexed. Tables
    are cut from their lineage in the shared folder.
    """

    LEVELS = 16

    def __init__(self, doc_tokens: DataFrame, centroids: int | None = None, sample_rows: int = 20_000, rounds: int = 10, seed: int = 1):
        spark = doc_tokens.sparkSession
        _ensure_checkpoint(spark)
        self.tokens = doc_tokens.where("doc_id is not null and v is not null").select("doc_id", "v")
        count = self.tokens.count()
        centroids = centroids or min(4096, max(1, int(16 * count**0.5)))
        share = max(1, min(1 << 20, (1 << 20) * sample_rows // max(1, count)))
        some = self.tokens.where(F.pmod(F.xxhash64("doc_id", "v", F.lit(seed)), F.lit(1 << 20)) < share).select("v").distinct().limit(2 * sample_rows).collect()
        x = np.array(sorted(r["v"] for r in some), float)
        rng = np.random.default_rng(seed)
        self.centroids = x[rng.permutation(len(x))[:centroids]] if len(x) else np.zeros((1, 1))
        for _ in range(rounds if len(x) else 0):
            near = self._nearest(x, 1)[:, 0]
            self.centroids = np.array([x[near == c].mean(0) if (near == c).any() else self.centroids[c] for c in range(len(self.centroids))])
        rest = x - self.centroids[self._nearest(x, 1)[:, 0]] if len(x) else np.zeros(1)
        #: Residuals are coded by the middle of their quantile range.
        self.borders = np.quantile(rest, np.arange(1, self.LEVELS) / self.LEVELS)
        self.levels = np.quantile(rest, (np.arange(self.LEVELS) + 0.5) / self.LEVELS)
        centres, borders = self.centroids, self.borders

        def code(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _rows(pa.chunked_array([batch.column(1)]))
                near = _near(x, centres, 1)[:, 0]
                codes = np.searchsorted(borders, x - centres[near]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int32()), pa.array(list(codes), pa.list_(pa.int8()))], ["doc_id", "cell", "code"])

        self.coded = self.tokens.mapInArrow(code, "doc_id long, cell int, code array<tinyint>").checkpoint()

    def _nearest(self, x: np.ndarray, count: int) -> np.ndarray:
        return _near(x, self.centroids, count)

    def search(self, query_tokens: DataFrame, k: int = 10, probes: int = 96, pool: int = 1000, final: int = 128) -> DataFrame:
        """``qid, doc_id, score, rank, met``: the best of the documents that the pruning leaves, by exact scores; ``met`` is how many documents the query's centroids had.

        ``query_tokens(qid, pos, q)``. Each query vector names ``probes`` centroids; of the documents there the ``pool`` best by centroid scores are scored on codes
        and the ``final`` best of those on their vectors.
        """
        asked = query_tokens.where("qid is not null and q is not null").select("qid", "pos", "q")
        centres, levels = self.centroids, self.levels
        cells = self.coded.select(F.col("doc_id").alias("id"), "cell", "code")
        queries = asked.select(F.col("qid").alias("id"), "pos", "q")

        def survey(key, table):
            parts: dict[int, list] = {}
            for n, (qid, _, bins, met, _) in enumerate(_met(table, centres, probes)):
                parts.setdefault(n // PART, []).append((qid, np.bincount(bins[met], minlength=BINS).astype(np.uint32)))
            return pa.table(
                {
                    "g": pa.array([key[1].as_py()] * len(parts), pa.int32()),
                    "part": pa.array(list(parts), pa.int32()),
                    "qids": pa.array([np.array([q for q, _ in p], np.int64).tobytes() for p in parts.values()], pa.binary()),
                    "counts": pa.array([b"".join(c.tobytes() for _, c in p) for p in parts.values()], pa.binary()),
                }
            )

        def cut(table: pa.Table) -> pa.Table:
            qids = np.frombuffer(table.column("qids")[0].as_py(), np.int64)
            counts = np.zeros((len(qids), BINS), np.int64)
            for blob in table.column("counts"):
                counts += np.frombuffer(blob.as_buffer(), np.uint32).reshape(len(qids), BINS)
            above = np.cumsum(counts[:, ::-1], axis=1)
            enough = above >= pool
            cuts = np.where(enough.any(1), BINS - 1 - enough.argmax(1), 0)
            return pa.table({"qid": pa.array(qids), "cut": pa.array(cuts, pa.int32()), "met": pa.array(above[:, -1], pa.int64())})

        counted = _tiled(cells.drop("code"), queries).applyInArrow(survey, "g int, part int, qids binary, counts binary")
        cuts = counted.groupBy("g", "part").applyInArrow(cut, "qid long, cut int, met long").checkpoint()

        def pick(table: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
            for qid, q, bins, met, (docs, starts, score, where, code, least) in _met(table, centres, probes):
                some = np.flatnonzero(met & (bins >= least))
                some = np.sort(some[_best(score[some], pool)])
                if not len(some):
                    continue
                sizes = np.diff(np.append(starts, len(where)))[some]
                heads = np.cumsum(sizes) - sizes
                rows = np.repeat(starts[some] - heads, sizes) + np.arange(sizes.sum())
                near = np.maximum.reduceat((centres[where[rows]] + levels[code[rows]]) @ q.T, heads, axis=0).sum(1)
                out.append((np.full(len(some), qid), docs[starts[some]], score[some], np.round(near, 9)))
            qid, doc, score, near = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.table({"qid": pa.array(qid, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score), "near": pa.array(near)})

        limited = queries.join(cuts.select(F.col("qid").alias("id"), "cut"), "id")
        picked = _tiled(cells, limited).applyInArrow(pick, "qid long, doc_id long, score double, near double")
        left = top(top(picked, pool).drop("rank"), final, "near").select("qid", "doc_id")
        return top(self._scored(left.join(self.tokens, "doc_id"), asked), k).join(cuts.where("met > 0").select("qid", "met"), "qid")

    @staticmethod
    def _scored(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """Exact sums for ``pairs(qid, doc_id, v)``."""
        best = pairs.join(asked, "qid").groupBy("qid", "pos", "doc_id").agg(F.max(V.dot(F.col("v"), F.col("q"))).alias("m"))
        return best.groupBy("qid", "doc_id").agg(F.round(F.sum("m"), 9).alias("score"))


def _near(x: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """Nearest centroids by distance."""
    found = [np.zeros((0, count), np.int64)]
    for at in range(0, len(x), 1024):
        far = (centres * centres).sum(1)[None, :] - 2 * x[at : at + 1024] @ centres.T
        found.append(far.argmin(1)[:, None] if count == 1 else np.argsort(far, axis=1, kind="stable")[:, :count])
    return np.concatenate(found)


def _met(table: pa.Table, centres: np.ndarray, probes: int):
    """For each query of a tile, in order of id: ``id, vectors, bins, met`` and the documents' ``ids, starts, scores, cells, codes`` with the query's cut.

    A vector of the query scores with a document by the best of its ``probes`` nearest centroids that the document has, by the last of them if it has none; ``met``: the
    document has one at least. ``bins`` are ranges of scores between the least and the largest possible.
    """
    mask = table.column("asks").to_numpy()
    if not mask.any() or mask.all():
        return
    docs, asked = table.filter(pa.array(~mask)).sort_by("id"), table.filter(pa.array(mask)).sort_by([("id", "ascending"), ("pos", "ascending")])
    ids, cells = docs.column("id").to_numpy(), docs.column("cell").to_numpy()
    code = docs.column("code").combine_chunks() if "code" in table.schema.names else None
    code = code if code is None else code.flatten().to_numpy().reshape(len(ids), -1)
    starts, qids, q = _starts(ids), asked.column("id").to_numpy(), _rows(asked.column("q"))
    cuts = asked.column("cut").to_numpy() if "cut" in table.schema.names else np.zeros(len(qids), np.int32)
    edges, probes = _starts(qids), min(probes, len(centres))
    for a, e in zip(edges, [*edges[1:], len(qids)], strict=True):
        s = q[a:e] @ centres.T
        least = np.partition(s, len(centres) - probes, axis=1)[:, len(centres) - probes, None]
        over = np.where(s >= least, s - least, -1.0)
        for i in np.flatnonzero((over >= 0).sum(1) > probes):
            ties = np.flatnonzero(s[i] == least[i])
            over[i, ties[probes - int((s[i] > least[i]).sum()) :]] = -1.0
        best = np.array([np.maximum.reduceat(row[cells], starts) for row in over])
        floor = least.sum()
        score = np.maximum(best, 0).sum(0) + floor
        span = over.max(1).sum()
        bins = np.minimum((score - floor) / span * BINS, BINS - 1).astype(np.int64) if span > 0 else np.zeros(len(score), np.int64)
        yield qids[a], q[a:e], bins, (best >= 0).any(0), (ids, starts, score, cells, code, cuts[a])


def recall(found: DataFrame, truth: DataFrame, docs: int) -> DataFrame:
    """``recall, met``: mean share of the true best found, and mean share of all documents that a query's centroids had."""
    hits = truth.join(found.select("qid", "doc_id", F.lit(1.0).alias("hit")), ["qid", "doc_id"], "left").groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("r"))
    share = found.groupBy("qid").agg(F.first("met").alias("met"))
    return hits.join(share, "qid", "left").agg(F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg(F.coalesce("met", F.lit(0))) / max(docs, 1), 6).alias("met"))
