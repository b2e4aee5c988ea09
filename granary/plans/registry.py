"""Registered queries with their SQL, and the tables and SQL pieces that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import vector as V
from granary.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as queries: their whole texts."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), V.doubles(F.col("embedding")).alias("v"), "label")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of vector searches: rows whose id is divisible by 20."""
    return vecs(spark, d).where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("v").alias("q"), F.col("label").alias("q_label"))


#: White space and words as Java's Unicode classes have them, in RE2's terms.
SPACE = "[\\s\\x{85}\\x{A0}\\x{2028}\\x{2029}]"
WORD = "[\\p{L}\\p{N}\\p{M}_]+"
SPACED = f"regexp_extract_all(text, '[^{SPACE[1:-1]}]+')"


def draw_sql(*parts: str) -> str:
    """The SQL of :func:`granary.functions.text.draw`."""
    return f"('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


def poisson_sql(u: str, largest: int = 10) -> str:
    """A Poisson(1) number from a uniform one."""
    import math

    acc, steps = 0.0, []
    for k in range(largest):
        acc += math.exp(-1) / math.factorial(k)
        steps.append(f"({u} > {acc!r}::DOUBLE)::INT")
    return "(" + " + ".join(steps) + ")"
