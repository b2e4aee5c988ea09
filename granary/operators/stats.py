"""Statistics: intervals, agreement, paired tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import probability as P
from granary.functions import text as T
from granary.operators.packing import prefix_sums

Z = 1.959963984540054

# Two-sided 95 % points of Student's t by degrees of freedom.
T_975 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 12: 2.179, 15: 2.131, 20: 2.086, 25: 2.060, 30: 2.042, 40: 2.021, 60: 2.000, 120: 1.980}


def t_975(df: int) -> float:
    """The 97.5 % point of Student's t, between table rows linear in 1 / df."""
    if df in T_975:
        return T_975[df]
    lower = max((d for d in T_975 if d < df), default=1)
    upper = min((d for d in T_975 if d > df), default=None)
    a, fa = 1 / lower, T_975[lower]
    b, fb = (1 / upper, T_975[upper]) if upper else (0.0, Z)
    return fb + (fa - fb) * (1 / df - b) / (a - b)


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """Wilson score interval of a share."""
    p = successes / n
    centre = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z / (1 + Z * Z / n) * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def mean_interval(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean with a 95 % t-interval per group: ``mean, lo, hi, n``; a single value has no width."""
    sums = values.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.count(column).alias("n"))
    spark = values.sparkSession
    table = F.broadcast(spark.createDataFrame([(d, t_975(d)) for d in range(1, 1001)], "df long, t double"))
    joined = sums.join(table, (F.col("n") - 1) == F.col("df"), "left")
    half = F.coalesce(F.coalesce("t", F.lit(Z)) * F.col("sd") / F.sqrt("n"), F.lit(0.0))
    return joined.select(*by, "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"), "n")


def snapped(point: Column, lo: Column, hi: Column, tolerance: float = 1e-9) -> tuple[Column, Column]:
    """An interval that holds its estimate: ends that miss it by no more than rounding are put on it, others stay."""
    low = F.when((lo > point) & (lo - point <= tolerance), point).otherwise(lo)
    high = F.when((hi < point) & (point - hi <= tolerance), point).otherwise(hi)
    return low, high


def exact_mean_interval(values: DataFrame, by: list[str], column: str, level: float = 0.95) -> DataFrame:
    """Mean with a t-interval of any level per group, from Student's distribution itself: ``mean, lo, hi, n``; a single value has no width."""
    sums = values.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.count(column).alias("n"))
    half = F.coalesce(P.t_ppf(F.lit((1 + level) / 2), (F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt("n"), F.lit(0.0))
    lo, hi = snapped(F.col("mean"), F.col("mean") - half, F.col("mean") + half)
    return sums.select(*by, "mean", lo.alias("lo"), hi.alias("hi"), "n")


def normal_scores(rows: DataFrame, by: str, column: str, key: str) -> DataFrame:
    """``key, by, p, z``: where a value stands in its group, ``(rank - 3/8) / (n + 1/4)`` with the mean rank of equal values, and the normal quantile of that."""
    counted = _counted(rows.where(F.col(column).isNotNull()), [by], column)
    total = counted.groupBy(by).agg(F.sum("n").alias("total"))
    p = (F.col("start") + (F.col("n") + 1) / 2 - 0.375) / (F.col("total") + 0.25)
    placed = counted.join(total, by).select(by, column, p.alias("p"))
    return rows.join(placed, [by, column]).select(key, by, "p", P.norm_ppf(F.col("p")).alias("z"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters: ``n, observed, expected, kappa``. If chance agreement is certain, kappa is 1 for full agreement, else 0."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("ra"))
    cols = cells.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("rb"))
    chance = rows.join(cols, "v").agg(F.coalesce(F.sum(F.col("ra") * F.col("rb")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select("n", po.alias("observed"), pe.alias("expected"), F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def _counted(rows: DataFrame, by: list[str], column: str, *more: Column) -> DataFrame:
    """A row per group and value: ``by, column``, how many rows hold it (``n``), the aggregates ``more``, and how many rows of the group hold less (``start``)."""
    return prefix_sums(rows.groupBy(*by, column).agg(F.count("*").alias("n"), *more), order=column, by=tuple(by))


def mid_ranks(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Ranks from 1, tied values sharing the mean of theirs; nulls come first.

    Values are counted first and only their counts are put in order, range by range.
    """
    by = by or []
    keys = [*by, column]
    ranks = _counted(values, by, column).select(*[F.col(c).alias(f"_{c}") for c in keys], (F.col("start") + (F.col("n") + 1) / 2.0).alias("mid_rank"))
    return values.join(ranks, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]).select(*values.columns, "mid_rank")


def wilcoxon_sums(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Signed-rank sums of paired differences, zeros dropped: ``n, w_plus, w_minus, w``."""
    diffs = pairs.withColumn("d", F.col(x) - F.col(y)).where("d <> 0").withColumn("size", F.abs("d"))
    sizes = _counted(diffs, by, "size", F.count(F.when(F.col("d") > 0, 1)).alias("positive")).withColumn("mid_rank", F.col("start") + (F.col("n") + 1) / 2.0)
    plus = F.sum(F.col("positive") * F.col("mid_rank"))
    minus = F.sum((F.col("n") - F.col("positive")) * F.col("mid_rank"))
    return sizes.groupBy(*by).agg(F.sum("n").alias("n"), plus.alias("w_plus"), minus.alias("w_minus"), F.least(plus, minus).alias("w"))


EXACT = 25


def exact_ways(n: int) -> np.ndarray:
    """In how many ways of signs the ranks 1..n of one sign add up to each sum."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[: len(ways) - r]
    return ways


def erfc(x: Column, terms: int = 80) -> Column:
    """The complementary error function of a number from 0 on, by its power series; beyond 4.5 it is below 2e-10 and given as 0."""
    step = lambda s, i: F.struct((s["t"] * -(x * x) / i).alias("t"), (s["e"] + s["t"] * -(x * x) / i / (2 * i + 1)).alias("e"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(x.alias("t"), x.alias("e")), step, lambda s: s["e"])
    return F.when(x > 4.5, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(math.pi) * series))


def wilcoxon(pairs: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """``by, n, p``: two-sided p of the signed-rank test in every group; zeros are dropped, a group of zeros has a p of 1.

    Exact up to 25 values without ties, from a table of the null distribution; else the normal approximation with corrections for ties and continuity.
    """
    spark = pairs.sparkSession
    diffs = pairs.withColumn("d", F.col(x) - F.col(y))
    ties = diffs.where("d <> 0").groupBy(by, F.abs("d").alias("size")).agg(F.count("*").alias("t"))
    ties = ties.groupBy(by).agg(F.max("t").alias("widest"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    sums = wilcoxon_sums(pairs, [by], x, y).join(ties, by)
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = (F.abs(F.col("w") - n * (n + 1) / 4) - 0.5) / F.sqrt(variance)
    rough = F.when(variance <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), erfc(F.greatest(z, F.lit(0.0)) / math.sqrt(2))))
    rows = [(k, float(w), float(min(1.0, 2 * below / 2**k))) for k in range(1, EXACT + 1) for w, below in enumerate(np.cumsum(exact_ways(k)).tolist())]
    table = F.broadcast(spark.createDataFrame(rows, "n long, w double, exact double"))
    tested = sums.join(table, ["n", "w"], "left").select(by, "n", F.when(F.col("widest") == 1, F.coalesce("exact", rough)).otherwise(rough).alias("p"))
    return pairs.select(by).distinct().join(tested, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("p", F.lit(1.0)).alias("p"))


def snap(point: Column, lo: Column, hi: Column, tolerance: float = 1e-9) -> tuple[Column, Column]:
    """Bounds that miss the point by rounding alone, set to it."""
    low = F.when((lo - point > 0) & (lo - point <= tolerance), point).otherwise(lo)
    high = F.when((point - hi > 0) & (point - hi <= tolerance), point).otherwise(hi)
    return low, high


def normal_quantile(p: float) -> float:
    """The inverse of the normal distribution."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def require_seeds(seeds: list[int], least: int = 3) -> list[int]:
    """Distinct seeds in order; fewer than ``least`` are an error."""
    found = sorted(set(seeds))
    if len(found) < least:
        raise ValueError(f"{least} distinct seeds at least, not {len(found)}")
    return found


def seed_interval(values: DataFrame, by: list[str], seed: str, column: str, least: int = 3) -> DataFrame:
    """Mean of the seeds' means with a t-interval over seeds: ``mean, lo, hi, n``; a group of fewer than ``least`` seeds is an error."""
    means = values.groupBy(*by, seed).agg(F.avg(column).alias("m"))
    enough = F.when(F.col("n") >= least, F.col("n")).otherwise(F.raise_error(F.lit(f"{least} distinct seeds at least")))
    return mean_interval(means, by, "m").withColumn("n", enough)


def _poisson(u: Column, largest: int = 10) -> Column:
    """A Poisson(1) number from a uniform one."""
    weight, acc = F.lit(0), 0.0
    for k in range(largest):
        acc += math.exp(-1) / math.factorial(k)
        weight = weight + (u > acc).cast("int")
    return weight


def _resampled(rows: DataFrame, key: str, resamples: int, seed: int) -> DataFrame:
    """Every row with each resample's number ``b`` and its weight ``w`` there, which depends on seed, key and number alone."""
    u = (T.draw(seed, F.col(key), F.col("b")) + 0.5) / float(1 << 60)
    return rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", _poisson(u))


def bootstrap_mean(values: DataFrame, column: str, key: str, resamples: int = 1000, seed: int = 1234) -> DataFrame:
    """Percentile bootstrap of a mean by Poisson weights: ``mean, lo, hi, n``; ``key`` tells rows apart.

    Every row gets for each resample a Poisson(1) weight from a hash of its key and the resample, so no row is copied and sums are combined map-side.
    """
    rows = values.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).cast("double").alias("x"))
    means = _resampled(rows, "key", resamples, seed).groupBy("b").agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("m"))
    interval = means.agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return rows.agg(F.avg("x").alias("mean"), F.count("*").alias("n")).crossJoin(interval).select("mean", "lo", "hi", "n")


def kappa_interval(pairs: DataFrame, a: str, b: str, key: str, resamples: int = 1000, seed: int = 1234) -> DataFrame:
    """Cohen's kappa with a percentile bootstrap over items: ``kappa, lo, hi, n``."""
    rows = pairs.select(F.col(key).alias("key"), F.col(a).alias("x"), F.col(b).alias("y"))
    cells = _resampled(rows, "key", resamples, seed).groupBy("b", "x", "y").agg(F.sum("w").alias("n"))
    total = cells.groupBy("b").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("b", F.col("x").alias("v")).agg(F.sum("n").alias("ra")), cells.groupBy("b", F.col("y").alias("v")).agg(F.sum("n").alias("rb"))
    chance = left.join(right, ["b", "v"]).groupBy("b").agg(F.sum(F.col("ra") * F.col("rb")).alias("c"))
    po, pe = F.try_divide(F.col("same"), F.col("n")), F.try_divide(F.coalesce("c", F.lit(0)), F.col("n") * F.col("n"))
    each = total.join(chance, "b", "left").where("n > 0").select(F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe)).alias("k"))
    interval = each.agg(F.percentile("k", F.lit(0.025)).alias("lo"), F.percentile("k", F.lit(0.975)).alias("hi"))
    return kappa(pairs, a, b).select("kappa", "n").crossJoin(interval).select("kappa", "lo", "hi", "n")


def nearest_rank_percentile(values: DataFrame, by: list[str], column: str, p: float) -> DataFrame:
    """Value at the index ``p * (n - 1)`` rounded half to even, in the group's order of values that are not null."""
    rows = values.where(F.col(column).isNotNull())
    totals = rows.groupBy(*by).agg(F.count("*").alias("_total")).select(*[F.col(c).alias(f"_{c}") for c in by], F.bround(F.lit(p) * (F.col("_total") - 1)).cast("long").alias("_index"))
    held = (F.col("_index") >= F.col("start")) & (F.col("_index") < F.col("start") + F.col("n"))
    return _counted(rows, by, column).join(totals, [held, *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]]).select(*by, F.col(column).alias("value"))
