"""A training corpus from ``documents``: quality, near duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. Its result is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``documents``, whatever their names. An empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import jaccard_join, packing, quality, scratch, suffix_dedup


def _bundled(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and all other columns in one, ``row``, so that no operator's column can clash with theirs."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest or [F.lit(0).alias("none")]).alias("row"))


def _opened(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of ``documents`` again, those in ``new`` computed."""
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) if c in ("doc_id", "text") else F.col(f"row.`{c}`") for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (a score of at least 0.3).

    A null text is scored as an empty one. Each of repeated rows, rows with a null ``doc_id`` and texts of any length are judged alike by their text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_quality(_bundled(docs), labels, threshold=0.3, carry=["text", "row"])
    return _opened(scored.where("predicted = 1"), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a Jaccard similarity of 0.8 or more.

    The least ``doc_id`` stays; a null one counts as the largest. Repeated rows count as copies; texts that are null or without words are copies of
    nothing but rows with their own ``doc_id``. Texts of any length are compared whole.
    """
    return jaccard_join.keep_one(docs, percent=80, n=5)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that an earlier place also holds; ``n_chars`` is counted anew.

    Every row stays, with an empty text if nothing is left of it or it was null. Rows with a null ``doc_id`` come after all others, repeated
    rows one after the other.
    """
    cut = suffix_dedup.remove_repeats(_bundled(docs), length=100, keep_text=True, carry=["row"])
    return _opened(cut, docs.columns, text=F.col("kept"), n_chars=F.length("kept").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 2048 tokens; a null or empty text is its end id alone, every row is packed, whatever its ``doc_id``, repeated ones too; texts of any length are
    cut into as many pieces as they need."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("repeats", repeat_stage), ("packing", packing_stage)]

#: The stages are a fitted model, a tokenizer and byte-level string sorting: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage leaves in the shared folder is removed when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = scratch.mark(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.sweep(spark, before, (docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
