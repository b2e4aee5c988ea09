"""Documents to everything that is searched: blocks, tables, figures and chunks, as frames over one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import chunking
from granary.sources import readers


@dataclass
class Ingested:
    """What a corpus of documents gives."""

    blocks: DataFrame
    cells: DataFrame
    figures: DataFrame
    chunks: DataFrame
    stats: DataFrame


def ingest(docs: DataFrame, strategy: str = "recursive", size: int = 512, overlap: int = 0) -> Ingested:
    """``docs(doc_id, text)``: Markdown or plain text."""
    blocks = chunking.blocks(docs)
    chunks = chunking.chunk(docs, strategy, size, overlap)
    return Ingested(blocks, chunking.tables(blocks), chunking.figures(blocks), chunks, chunking.chunk_stats(chunks))


def ingest_files(spark: SparkSession, path: str, strategy: str = "recursive", size: int = 512, overlap: int = 0) -> Ingested:
    """Text and Markdown files of a folder; a document's id is a hash of its file's stem. Other kinds need a parser (see ``plugins``)."""
    files = readers.text_files(spark, path).where(F.col("kind").isin("text", "markdown"))
    return ingest(files.select(F.xxhash64("doc_id").alias("doc_id"), "text"), strategy, size, overlap)
