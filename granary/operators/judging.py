"""Judges of answers: a lexical one, how a judge agrees with people, and the gate that keeps an untrusted one out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import metrics, stats

VERDICTS = ["A", "B", "tie"]


def letters_and_digits(text: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def grounding(text: Column, context: Column) -> Column:
    """Share of a text's distinct words that a context holds; both are columns of words."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(text, context)), F.size(text)), F.lit(0.0))


def compare(a: Column, b: Column, margin: float = 0.05) -> Column:
    """The better of two groundings, or a tie within the margin."""
    return F.when(F.abs(a - b) < margin, "tie").when(a > b, "A").otherwise("B")


def supports(share: Column, threshold: float = 0.6) -> Column:
    return share >= threshold


def win_score(verdict: Column) -> Column:
    """1 for A, a half for a tie, 0 for B."""
    return F.when(verdict == "A", 1.0).when(verdict == "tie", 0.5).otherwise(0.0)


def replayed(labels: DataFrame, asked: DataFrame) -> DataFrame:
    """Verdicts looked up in labels ``(id, human)``."""
    return asked.join(labels.select("id", F.col("human").alias("verdict")), "id", "left")


def confusion(rows: DataFrame) -> DataFrame:
    """``human, verdict, n`` for all nine cells, ``rows(human, forward)``; cells without rows count 0."""
    spark = rows.sparkSession
    cells = spark.createDataFrame([(h, v) for h in VERDICTS for v in VERDICTS], "human string, verdict string")
    found = rows.groupBy("human", F.col("forward").alias("verdict")).agg(F.count("*").alias("n"))
    return F.broadcast(cells).join(found, ["human", "verdict"], "left").select("human", "verdict", F.coalesce("n", F.lit(0)).alias("n"))


def calibration(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """How a judge agrees with people: ``rows(human, forward, backward)``, the last its verdict on the answers in exchanged places.

    ``n, agreement, kappa, swap_rate`` (verdicts that change with the places), ``first_rate`` (first place preferred in both orders), ``trusted``.
    """
    same = metrics.flip(F.col("backward"))
    rates = rows.agg(F.avg((F.col("forward") == F.col("human")).cast("double")).alias("agreement"), F.avg((F.col("forward") != same).cast("double")).alias("swap_rate"), F.avg(((F.col("forward") == "A") & (F.col("backward") == "A")).cast("double")).alias("first_rate"))
    return stats.kappa(rows, "human", "forward").select("n", "kappa").crossJoin(rates).select("n", "agreement", "kappa", "swap_rate", "first_rate", gate(F.col("kappa"), threshold).alias("trusted"))


def gate(kappa: Column, threshold: float = 0.6) -> Column:
    """Whether judged metrics may be reported: kappa is known and reaches the threshold."""
    return F.coalesce(kappa >= threshold, F.lit(False))
