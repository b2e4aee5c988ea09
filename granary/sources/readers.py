"""Readers: corpora, golden sets, runs, labels, shards and mixtures, as DataFrames with stated schemas."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CORPUS = "chunk_id string, doc_id string, text string, title string, modality string"
GOLDEN = "id string, question string, expected_answer string, expected_doc_ids array<string>, expected_chunk_ids array<string>, difficulty string, category string, requires_tools array<string>, verified boolean, source string, notes string, injection_canary string"
JUDGE = "id string, question string, context string, answer_a string, answer_b string, human_label string, a_supported boolean, b_supported boolean"
RUN = "qid string, ids array<string>, scores array<double>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """The tables of a folder as temporary views."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, CORPUS)


def golden(spark: SparkSession, path: str, require_verified: bool = False) -> DataFrame:
    """Questions; with ``require_verified`` an unverified one is an error when its row is read."""
    rows = jsonl(spark, path, GOLDEN)
    return rows.withColumn("verified", F.when(F.col("verified"), True).otherwise(F.raise_error(F.concat(F.lit("unverified question "), "id")))) if require_verified else rows


def golden_violations(rows: DataFrame) -> DataFrame:
    """``id, problem`` of rows that break a constraint."""
    problems = F.array_compact(
        F.array(
            F.when((F.col("category") == "out-of-domain") & (F.size("expected_doc_ids") > 0), "out of domain with documents"),
            F.when(F.exists("expected_chunk_ids", lambda c: ~F.array_contains("expected_doc_ids", F.substring_index(c, "#", 1))), "chunk outside the documents"),
            F.when((F.coalesce("injection_canary", F.lit("")) != "") != (F.col("category") == "adversarial-injection"), "canary without attack or attack without canary"),
            F.when(F.size(F.array_distinct("expected_doc_ids")) < F.size("expected_doc_ids"), "repeated document"),
        )
    )
    repeated = rows.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    return rows.select("id", F.explode(problems).alias("problem")).unionByName(repeated)


def question_hash(rows: DataFrame) -> DataFrame:
    """A digest of a set of questions that doesn't depend on their order. The set is small by definition."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("j")).agg(F.sha2(F.concat(F.array_join(F.sort_array(F.collect_list("j")), "\n"), F.lit("\n")), 256).alias("hash"))


def run_file(spark: SparkSession, path: str) -> DataFrame:
    """A ranked run: ``qid, doc_id, score, rank``; missing scores fall from the list's length."""
    rows = jsonl(spark, path, RUN)
    score = F.coalesce(F.try_element_at("scores", F.col("pos") + 1), (F.size("ids") - F.col("pos")).cast("double"))
    return rows.select("qid", "ids", "scores", F.posexplode("ids").alias("pos", "doc_id")).select("qid", "doc_id", score.alias("score"), (F.col("pos") + 1).alias("rank"))


def judge_labels(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, JUDGE)


def verification_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Rows that a person has labelled."""
    return spark.read.json(path).where(F.trim("human_label") != "")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``doc_id`` (the file's stem), ``kind``, ``text``."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("doc_id"), document_kind(F.col("_metadata.file_name")).alias("kind"), F.col("value").alias("text"))


def document_kind(name):
    low = F.lower(name)
    return F.when(low.rlike(r"\.(md|markdown)$"), "markdown").when(low.rlike(r"\.(txt|text)$"), "text").when(low.rlike(r"\.pdf$"), "pdf").otherwise("unknown")


@dataclass
class Source:
    name: str
    weight: float
    license: str = "unknown"
    path: str | None = None
    format: str = "parquet"
    text_field: str = "text"


@dataclass
class Mixture:
    """A mixture of sources, as a YAML or JSON file states it."""

    seq_len: int
    seed: int
    allowed_licenses: list[str] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)

    @classmethod
    def load(cls, path: str, exclude: tuple[str, ...] = ()) -> Mixture:
        """``exclude`` leaves sources out; the weights of the others add up to 1 again."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            spec = json.loads(text)
        except ValueError:
            import yaml

            spec = yaml.safe_load(text)
        sources = [Source(**s) for s in spec["sources"] if s["name"] not in exclude]
        total = sum(s.weight for s in sources)
        for s in sources:
            s.weight /= total
        return cls(spec["seq_len"], spec["seed"], spec.get("allowed_licenses", []), sources)

    def frames(self, spark: SparkSession) -> dict[str, tuple[DataFrame, float]]:
        """Documents of every source that has a path: text that isn't empty, with source and license."""
        out = {}
        for s in self.sources:
            if s.path:
                rows = spark.read.format(s.format).load(s.path).select(F.col(s.text_field).alias("text")).where("text is not null and text <> ''")
                out[s.name] = (rows.select(F.xxhash64("text").alias("doc_id"), "text", F.lit(s.name).alias("source"), F.lit(s.license).alias("license")), s.weight)
        return out
