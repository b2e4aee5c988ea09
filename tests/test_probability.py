"""Distribution functions against tabulated values and against each other."""

import math

import pytest
from pyspark.sql import functions as F

from granary.functions import probability as P


def test_normal(spark):
    # Quantiles of the normal distribution.
    known = {0.5: 0.0, 0.975: 1.959963984540054, 0.995: 2.5758293035489004, 0.9: 1.2815515655446004, 0.999: 3.090232306167813, 1e-6: -4.753424308822899, 1e-10: -6.361340902404056, 0.02: -2.053748910631823, 0.6: 0.2533471031357997}
    rows = spark.createDataFrame([(p, z) for p, z in known.items()], "p double, z double")
    for r in rows.select("p", "z", P.norm_ppf(F.col("p")).alias("x"), P.norm_cdf(F.col("z")).alias("c")).collect():
        assert r.x == pytest.approx(r.z, abs=1e-11) and r.c == pytest.approx(r.p, rel=1e-11)
    some = spark.range(-60, 61).select((F.col("id") / 10).alias("x")).select("x", P.norm_cdf(F.col("x")).alias("c"))
    for r in some.collect():
        assert r.c == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-12)
    assert [r.z for r in spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(P.norm_ppf(F.col("p")).alias("z")).collect()] == [None] * 3


def test_student(spark):
    # 97.5 % points of Student's distribution.
    known = {1: 12.706204736432095, 2: 4.302652729911275, 3: 3.182446305284263, 5: 2.570581835636314, 10: 2.2281388519649385, 30: 2.0422724563012373, 100: 1.9839715184496334, 200: 1.9718962236339095, 1000: 1.9623390808264078}
    rows = spark.createDataFrame([(float(d), t) for d, t in known.items()], "df double, t double")
    for r in rows.select("df", "t", P.t_ppf(F.lit(0.975), F.col("df")).alias("x"), P.t_cdf(F.col("t"), F.col("df")).alias("c"), P.t_cdf(-F.col("t"), F.col("df")).alias("d")).collect():
        assert r.x == pytest.approx(r.t, abs=1e-9), r
        if r.df <= 200:
            assert r.c == pytest.approx(0.975, abs=1e-11) and r.d == pytest.approx(0.025, abs=1e-11)
    back = spark.range(3, 60).select(F.col("id").cast("double").alias("df")).select("df", P.t_cdf(P.t_ppf(F.lit(0.8), F.col("df")), F.col("df")).alias("p"))
    assert all(r.p == pytest.approx(0.8, abs=1e-11) for r in back.collect())


def test_log_gamma(spark):
    rows = spark.createDataFrame([(x / 4,) for x in range(1, 200)], "x double").select("x", P.log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), abs=1e-12, rel=1e-12) for r in rows)
