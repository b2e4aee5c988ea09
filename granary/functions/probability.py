"""The normal and Student's t distributions as column expressions.

The normal distribution function is a power series near its middle and a continued fraction in its tails; its inverse starts from a rational
approximation and takes one step of Halley's method. Student's is the incomplete beta function by its continued fraction; its inverse takes Newton's steps. Only
arithmetic and folds over constant sequences are used, so SQL can repeat them.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the inverse normal distribution, numerators and denominators of its middle and its tails.
MIDDLE_OVER = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
MIDDLE_UNDER = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
TAIL_OVER = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
TAIL_UNDER = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
#: Where the tails begin, as a probability and as a number of standard deviations of the distribution function's two forms.
TAIL, FAR = 0.02425, 3.0
_SERIES, _FRACTION = 60, 80
_DENSITY = 1 / math.sqrt(2 * math.pi)


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def _down(count: int) -> Column:
    return F.sequence(F.lit(count), F.lit(1), F.lit(-1))


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) * _DENSITY


def norm_cdf(x: Column) -> Column:
    """The normal distribution function, to some 15 digits; in the lower tail of itself, not of 1."""
    near = 0.5 + norm_pdf(x) * x * F.aggregate(_down(_SERIES), F.lit(1.0), lambda s, k: 1 + x * x / (2 * k + 1) * s)
    far = F.abs(x)
    tail = norm_pdf(x) / F.aggregate(_down(_FRACTION), far, lambda d, k: far + k / d)
    return F.when(far <= FAR, near).when(x < 0, tail).otherwise(1 - tail)


def _start(p: Column) -> Column:
    q = p - 0.5
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    beyond = _polynomial(tail, TAIL_OVER) / _polynomial(tail, TAIL_UNDER)
    middle = _polynomial(q * q, MIDDLE_OVER) * q / _polynomial(q * q, MIDDLE_UNDER)
    return F.when(p < TAIL, beyond).when(p > 1 - TAIL, -beyond).otherwise(middle)


def norm_ppf(p: Column) -> Column:
    """The inverse of :func:`norm_cdf`; null outside 0 < p < 1."""
    # A fold over one element names the first guess, so that it isn't written out at each of its uses.
    stepped = F.element_at(F.transform(F.array(_start(p)), lambda x: F.element_at(F.transform(F.array((norm_cdf(x) - p) / norm_pdf(x)), lambda u: x - u / (1 + x * u / 2)), 1)), 1)
    return F.when((p > 0) & (p < 1), stepped)


def log_gamma(z: Column) -> Column:
    """The logarithm of the gamma function for positive numbers, by Stirling's series ten places up."""
    x = z + 10
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    return series - F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, i: s + F.log(z + i))


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function for 0 <= x <= 1: its continued fraction, from the side where it converges fast."""

    def fraction(x: Column, a: Column, b: Column) -> Column:
        # Pairs of terms, from the innermost out.
        def step(d: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + even / (1 + odd / d)

        inner = F.aggregate(_down(_FRACTION), F.lit(1.0), step)
        first = -(a + b) * x / (a + 1)
        front = F.exp(a * F.log(x) + b * F.log(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
        return front / (1 + first / inner)

    inside = F.when(x < (a + 1) / (a + b + 2), fraction(x, a, b)).otherwise(1 - fraction(1 - x, b, a))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)


def t_cdf(t: Column, df: Column) -> Column:
    """Student's distribution function."""
    half = incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5)) / 2
    return F.when(t < 0, half).otherwise(1 - half)


#: Beyond so many degrees of freedom the inverse is a series in their reciprocal.
MANY = 200


def t_ppf(p: Column, df: Column, steps: int = 8) -> Column:
    """The inverse of :func:`t_cdf` for 0.5 <= p < 1 and at least one degree of freedom, to nine digits and more; null elsewhere."""
    x = norm_ppf(p)

    def series(x: Column) -> Column:
        terms = [
            (x * x * x + x) / 4,
            (5 * F.pow(x, F.lit(5.0)) + 16 * x * x * x + 3 * x) / 96,
            (3 * F.pow(x, F.lit(7.0)) + 19 * F.pow(x, F.lit(5.0)) + 17 * x * x * x - 15 * x) / 384,
            (79 * F.pow(x, F.lit(9.0)) + 776 * F.pow(x, F.lit(7.0)) + 1482 * F.pow(x, F.lit(5.0)) - 1920 * x * x * x - 945 * x) / 92160,
        ]
        return x + sum(t / F.pow(df, F.lit(float(i + 1))) for i, t in enumerate(terms))

    log_scale = log_gamma((df + 1) / 2) - log_gamma(df / 2) - 0.5 * F.log(df * math.pi)
    density = lambda t: F.exp(log_scale - (df + 1) / 2 * F.log(1 + t * t / df))
    # Few degrees of freedom have heavy tails: one and two have closed forms, the others start at the series.
    start = F.element_at(F.transform(F.array(x), series), 1)
    newton = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda t, _: t - (t_cdf(t, df) - p) / density(t))
    one = F.tan(math.pi * (p - 0.5))
    two = (2 * p - 1) * F.sqrt(2 / (4 * p * (1 - p)))
    return F.when((p < 0.5) | (p >= 1) | (df < 1), F.lit(None)).when(df == 1, one).when(df == 2, two).when(df > MANY, start).otherwise(newton)


def norm_ppf_sql(p: str) -> str:
    """SQL of :func:`norm_ppf` over a query with a column ``p`` and others: adds ``z``."""
    poly = lambda x, cs: functools.reduce(lambda s, c: f"(({s}) * {x} + ({c!r}))", cs[1:], f"({cs[0]!r})")
    tail = "sqrt(-2 * ln(least(p, 1 - p)))"
    beyond = f"{poly('y', TAIL_OVER)} / {poly('y', TAIL_UNDER)}"
    middle = f"{poly('(q * q)', MIDDLE_OVER)} * q / {poly('(q * q)', MIDDLE_UNDER)}"
    down = lambda n, first: f"list_prepend({first}, list_transform(range({n}, 0, -1), lambda k: k::DOUBLE))"
    series = f"list_reduce({down(_SERIES, '1::DOUBLE')}, lambda s, k: 1 + x * x / (2 * k + 1) * s)"
    fraction = f"list_reduce({down(_FRACTION, 'abs(x)')}, lambda d, k: abs(x) + k / d)"
    return f"""SELECT * EXCLUDE (q, y, x, f, c), x - (c - p) / f / (1 + x * (c - p) / f / 2) AS z FROM
 (SELECT *, CASE WHEN abs(x) <= {FAR} THEN 0.5 + f * x * {series} WHEN x < 0 THEN f / {fraction} ELSE 1 - f / {fraction} END AS c FROM
 (SELECT *, exp(-x * x / 2) * {_DENSITY!r}::DOUBLE AS f FROM
 (SELECT *, CASE WHEN p < {TAIL} THEN {beyond} WHEN p > 1 - {TAIL} THEN -({beyond}) ELSE {middle} END AS x FROM
 (SELECT *, p - 0.5::DOUBLE AS q, {tail} AS y FROM ({p})))))"""
