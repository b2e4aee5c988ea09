"""Vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def l2_normalize(v: Column) -> Column:
    length = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def truncate(v: Column, dim: int) -> Column:
    """The first components, normalised again."""
    return l2_normalize(F.when(F.size(v) >= dim, F.slice(v, 1, dim)).otherwise(F.raise_error(F.lit(f"vector shorter than {dim}"))))


def sign_bits(v: Column, start: int, count: int) -> Column:
    """Signs of up to 63 components as bits of a long; the first component is the highest bit."""
    return F.aggregate(F.slice(v, start, count), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1) + F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))


def sign_words(v: Column, dim: int) -> Column:
    """Signs of all components as an array of 32-bit words."""
    return F.array(*[sign_bits(v, s + 1, min(32, dim - s)) for s in range(0, dim, 32)])


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two word arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def quantize_int8(v: Column, scale: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.bround(x / scale))).cast("int"))


def dequantize(v: Column, scale: Column) -> Column:
    return F.transform(v, lambda x: x * scale)


def blend(a: Column, b: Column, weight_a: float) -> Column:
    """``weight_a * a + (1 - weight_a) * b``, normalised."""
    return l2_normalize(F.zip_with(a, b, lambda x, y: x * weight_a + y * (1 - weight_a)))
