"""How well ways of cutting documents serve a search: every way's chunks ranked for the same questions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import text as T
from granary.operators import chunking, text_search
from granary.operators.curate import _ensure_checkpoint
from granary.operators.metrics import graded_ndcg
from granary.operators.retrieval import BROADCAST_TERMS


def relevance(chunk_text: Column, terms: Column, same_document: Column, least: int = 2) -> Column:
    """1 if a chunk is of the document asked about and holds ``least`` of the key terms (all, if there are fewer), else 0."""
    held = F.size(F.filter(terms, lambda t: F.contains(F.lower(chunk_text), t)))
    return F.when(same_document & (held >= F.least(F.lit(least), F.size(terms))), 1.0).otherwise(0.0)


def ranked_chunks(chunks: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """``qid, rank, relevance`` of the k chunks with the most of each question's terms; ``questions(qid, doc_id, terms)``, ``chunks(doc_id, idx, text)``.

    Only chunks with one of the terms are ranked, counted in blocks where they are cut, or by a join if there are more than ``BROADCAST_TERMS`` terms; ties go to the smaller document and chunk.
    """
    asked = questions.select("qid", F.explode(F.array_distinct("terms")).alias("term")).where("qid is not null")
    rows = asked.limit(BROADCAST_TERMS + 1).collect()
    if len(rows) <= BROADCAST_TERMS:
        words = chunks.select(F.col("doc_id").alias("chunk_doc"), "idx", T.search_tokens(F.col("text")).alias("w"))
        sought = text_search.Asked([(r["qid"], r["term"], 1.0) for r in rows])
        hits = text_search.best(words, ["chunk_doc", "idx"], sought, questions.schema["qid"].dataType, k, lambda tf, dl: np.ones(len(tf))).withColumnRenamed("score", "hits")
    else:
        words = chunks.select(F.col("doc_id").alias("chunk_doc"), "idx", F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("term"))
        hits = words.join(asked, "term").groupBy("qid", "chunk_doc", "idx").agg(F.count("*").alias("hits"))
    order = Window.partitionBy("qid").orderBy(F.desc("hits"), "chunk_doc", "idx")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(questions.select("qid", F.col("doc_id").alias("wanted"), "terms"), "qid")
    texts = chunks.select(F.col("doc_id").alias("chunk_doc"), "idx", "text")
    if len(rows) * k <= BROADCAST_TERMS:  # so many rows at most: the chunks' texts stay where they are
        _ensure_checkpoint(chunks.sparkSession)
        best = F.broadcast(best.checkpoint())
    return texts.join(best, ["chunk_doc", "idx"]).select("qid", "rank", relevance(F.col("text"), F.col("terms"), F.col("chunk_doc") == F.col("wanted")).alias("relevance"))


def compare(docs: DataFrame, questions: DataFrame, ways: list[tuple[str, int, int]], k: int = 10) -> DataFrame:
    """``strategy, size, overlap, ndcg, questions`` for each way to cut: (strategy, size, overlap)."""
    out = None
    for strategy, size, overlap in ways:
        per = graded_ndcg(ranked_chunks(chunking.chunk(docs, strategy, size, overlap).select("doc_id", "idx", "text"), questions, k), k)
        row = per.agg(F.avg("ndcg").alias("ndcg"), F.count("*").alias("questions")).select(F.lit(strategy).alias("strategy"), F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), "ndcg", "questions")
        out = row if out is None else out.unionByName(row)
    return out


def context_cost(chunks: DataFrame, models: dict[str, tuple[float, float]]) -> DataFrame:
    """What situating every chunk costs: ``model, chunks, tokens, cost, milliseconds`` for models ``name: (price of 1,000 tokens, milliseconds a call)``."""
    spark = chunks.sparkSession
    rates = F.broadcast(spark.createDataFrame([(n, float(p), float(m)) for n, (p, m) in models.items()], "model string, price double, ms double"))
    total = chunks.agg(F.count("*").alias("chunks"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))
    return total.crossJoin(rates).select("model", "chunks", "tokens", (F.col("tokens") / 1000 * F.col("price")).alias("cost"), (F.col("chunks") * F.col("ms")).alias("milliseconds"))
