"""Evaluation sets: what they must hold, what they hold, and whether they are still what they were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T

# Categories and difficulties of questions.
CATEGORIES = ["factoid", "multi-hop", "aggregation", "table", "figure", "out-of-domain", "adversarial-injection"]
DIFFICULTIES = ["easy", "medium", "hard"]
RELEASE_SIZE = (150, 300)


def counts(golden: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Questions by value of a column, values without any included."""
    every = golden.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(golden.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def coverage_problems(golden: DataFrame, size: tuple[int, int] = RELEASE_SIZE) -> DataFrame:
    """``problem``: categories without a question, no unanswerable or adversarial one, unverified ones, a size outside the bounds."""
    missing = counts(golden, "category", CATEGORIES).where("n = 0").select(F.concat(F.lit("no question of category "), "category").alias("problem"))
    facts = golden.agg(F.count("*").alias("n"), F.count_if(F.size("expected_doc_ids") == 0).alias("unanswerable"), F.count_if(F.col("category") == "adversarial-injection").alias("adversarial"), F.count_if(~F.col("verified")).alias("unverified"))
    told = F.array_compact(
        F.array(
            F.when(F.col("unanswerable") == 0, F.lit("no unanswerable question")),
            F.when(F.col("adversarial") == 0, F.lit("no adversarial question")),
            F.when(F.col("unverified") > 0, F.concat(F.col("unverified"), F.lit(" unverified questions"))),
            F.when(~F.col("n").between(*size), F.concat(F.col("n"), F.lit(f" questions, not {size[0]} to {size[1]}"))),
        )
    )
    return missing.unionByName(facts.select(F.explode(told).alias("problem")))


def chosen(golden: DataFrame, categories: list[str] | None = None, difficulties: list[str] | None = None, answerable: bool = False) -> DataFrame:
    """Questions of some categories and difficulties; ``answerable``: only those with documents."""
    if categories is not None:
        golden = golden.where(F.col("category").isin(categories))
    if difficulties is not None:
        golden = golden.where(F.col("difficulty").isin(difficulties))
    return golden.where(F.size("expected_doc_ids") > 0) if answerable else golden


def matches(metadata: Column, filters: dict[str, object]) -> Column:
    """Whether a map's values equal those of ``filters``, or are among them where they are lists; compared as strings."""
    held = F.lit(True)
    for key, value in filters.items():
        found = metadata[key].cast("string")
        held = held & F.coalesce(found.isin([str(v) for v in value]) if isinstance(value, (list, tuple, set)) else found == str(value), F.lit(False))
    return held


def document_of(chunk_id: Column) -> Column:
    """The document of a chunk: what stands before ``#``."""
    return F.substring_index(chunk_id, "#", 1)


def stray_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks whose id doesn't begin with their document's."""
    return chunks.where(document_of(F.col("chunk_id")) != F.col("doc_id").cast("string"))


def relevant(golden: DataFrame) -> DataFrame:
    """``id, level, relevant``: a question's chunks if it names any, else its documents."""
    chunks = F.size("expected_chunk_ids") > 0
    return golden.select("id", F.when(chunks, "chunk").otherwise("document").alias("level"), F.array_distinct(F.when(chunks, F.col("expected_chunk_ids")).otherwise(F.col("expected_doc_ids"))).alias("relevant"))


def promote(candidates: DataFrame, verified: DataFrame) -> DataFrame:
    """The candidates that people verified, ``verified(id)``; an id that is no candidate's is an error when rows are read."""
    named = verified.select("id").distinct().join(candidates.withColumn("known", F.lit(True)), "id", "left")
    known = F.when(F.col("known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown candidate "), "id")))
    return named.where(known).select(*candidates.columns)


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows, hash`` of a table: a digest of the number of rows and the sum of their digests, so neither order nor partitions matter and nothing is gathered."""
    digest = T.draw(*[F.col(c) for c in columns]).cast("decimal(38,0)")
    return rows.select(digest.alias("d")).agg(F.count("*").alias("rows"), F.sum("d").alias("s")).select("rows", F.sha2(F.concat_ws("|", "rows", "s"), 256).alias("hash"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``name, rows, hash`` of a manifest file ``{"entries": {name: {"rows": n, "hash": h}}}``."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json(F.get_json_object("value", "$.entries"), "map<string, struct<rows: long, hash: string>>")
    return raw.select(F.explode(entries).alias("name", "e")).select("name", "e.rows", "e.hash")


def verified(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``name, status`` of tables ``(name, hash)`` against a manifest: ok, changed, missing or unexpected."""
    joined = expected.select("name", F.col("hash").alias("e")).join(actual.select("name", F.col("hash").alias("a")), "name", "full")
    return joined.select("name", F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("a") == F.col("e"), "ok").otherwise("changed").alias("status"))


def other_document_pairs(chunks: DataFrame, seed: int) -> DataFrame:
    """Every chunk with the next one, in an order drawn by the seed, that is of another document: ``first, second``; for questions over two documents.

    Chunks are numbered by prefix sums and joined with their successors; a pair of one document is left out.
    """
    from granary.operators.packing import prefix_sums

    drawn = chunks.select("chunk_id", "doc_id", T.draw(seed, F.col("chunk_id")).alias("d"), F.lit(1).alias("one"))
    placed = prefix_sums(drawn, order="d", value="one").select("chunk_id", "doc_id", "start")
    following = placed.select(F.col("chunk_id").alias("second"), F.col("doc_id").alias("other"), (F.col("start") - 1).alias("start"))
    return placed.join(following, "start").where("doc_id <> other").select(F.col("chunk_id").alias("first"), "second")


def candidates(questions: DataFrame, quota: int, least: int = 5, most: int = 64, threshold: float = 0.8) -> DataFrame:
    """Questions ``(id, category, question)`` of a fitting length, without near repeats, at most ``quota`` of each category by id."""
    from pyspark.sql.window import Window

    from granary.operators import curate

    fit = questions.where(F.size(T.words(F.col("question"))).between(least, most))
    texts = fit.select(F.col("id").alias("doc_id"), F.col("question").alias("text"))
    unique = curate.keep_first(texts, curate.near_duplicate_pairs(texts, threshold, 3)).select(F.col("doc_id").alias("id"))
    ranked = fit.join(unique, "id", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("id")))
    return ranked.where(F.col("r") <= quota).drop("r")
