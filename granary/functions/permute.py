"""A permutation of ``0 .. n - 1`` that costs the same for every number, both ways.

A number is a pair of digits of about the same range. Rounds add to one digit a keyed function of the other, which can be undone whatever that
function is (a Feistel network). The pairs are a few more than n; a number that comes out beyond n goes through the rounds again until it is within.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
ROUNDS = 6
#: A column walks so often at most; the share of numbers that would walk longer is below n ** (-WALKS / 2).
WALKS = 16


def keys(*seed: object) -> list[tuple[int, int]]:
    """Factor and summand of each round."""
    raw = [hashlib.sha256("|".join(map(str, [*seed, i])).encode()).digest() for i in range(ROUNDS)]
    return [(1 + int.from_bytes(d[:8], "big") % (PRIME - 1), int.from_bytes(d[8:16], "big") % PRIME) for d in raw]


class Permutation:
    """A permutation of ``0 .. n - 1`` by a seed, for columns and for plain numbers alike."""

    def __init__(self, n: int, *seed: object):
        if not 1 <= n <= 1 << 61:
            raise ValueError("n must be from 1 to 2 ** 61")
        self.n, self.keys = n, keys(*seed)
        self.high = math.isqrt(n - 1) + 1
        self.low = -(-n // self.high)

    def _round(self, key: tuple[int, int], digit: int, most: int) -> int:
        x = (digit * key[0] + key[1]) % PRIME
        return x * x % PRIME % most

    def place_of(self, row: int) -> int:
        """Where a number goes."""
        while True:
            a, b, ma, mb = row // self.low, row % self.low, self.high, self.low
            for key in self.keys:
                a, b, ma, mb = b, (a + self._round(key, b, ma)) % ma, mb, ma
            row = a * self.low + b
            if row < self.n:
                return row

    def row_of(self, place: int) -> int:
        """Which number comes to a place."""
        while True:
            a, b, ma, mb = place // self.low, place % self.low, self.high, self.low
            for key in reversed(self.keys):
                a, b, ma, mb = (b - self._round(key, a, mb)) % mb, a, mb, ma
            place = a * self.low + b
            if place < self.n:
                return place

    def _column(self, x: Column, forward: bool) -> Column:
        moduli = [(self.high, self.low), (self.low, self.high)]
        steps = []
        for i, key in enumerate(self.keys):
            steps.append(F.struct(F.lit(key[0]).cast("long").alias("f"), F.lit(key[1]).cast("long").alias("s"), F.lit(moduli[i % 2][0]).cast("long").alias("m")))
        steps = F.array(*(steps if forward else steps[::-1]))
        mixed = lambda d, k: (d * k["f"] + k["s"]) % PRIME

        def one(s: Column, k: Column) -> Column:
            if forward:
                x = mixed(s["b"], k)
                return F.struct(s["b"].alias("a"), ((s["a"] + x * x % PRIME % k["m"]) % k["m"]).alias("b"))
            x = mixed(s["a"], k)
            return F.struct(F.pmod(s["b"] - x * x % PRIME % k["m"], k["m"]).alias("a"), s["a"].alias("b"))

        def through(v: Column) -> Column:
            digits = F.struct(F.call_function("div", v, F.lit(self.low).cast("long")).alias("a"), (v % self.low).alias("b"))
            return F.aggregate(steps, digits, one, lambda s: s["a"] * self.low + s["b"])

        walks = min(self.high * self.low - self.n, WALKS)
        out = through(x.cast("long"))
        if walks:
            out = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), out, lambda v, _: F.when(v >= self.n, through(v)).otherwise(v))
            out = F.when(out < self.n, out).otherwise(F.raise_error(F.lit("a number walked too long")).cast("long"))
        return F.when((x >= 0) & (x < self.n), out)

    def place(self, row: Column) -> Column:
        """:meth:`place_of` as a column; null outside ``0 .. n - 1``."""
        return self._column(row, True)

    def row(self, place: Column) -> Column:
        """:meth:`row_of` as a column."""
        return self._column(place, False)


def place_sql(numbers: str, *seed: object) -> str:
    """SQL for ``x, place``: the permutation of the column ``x`` of a query whose numbers are ``0 .. n - 1``."""
    pairs = "SELECT x, k, n, mh, ml, y // ml AS a, y % ml AS b FROM w WHERE NOT (k > 0 AND y < n)"
    for i, (f, s) in enumerate(keys(*seed)):
        m = "mh" if i % 2 == 0 else "ml"
        pairs = f"SELECT x, k, n, mh, ml, b AS a, (a + (t * t) % {PRIME} % {m}) % {m} AS b FROM (SELECT *, (b * {f} + {s}) % {PRIME} AS t FROM ({pairs}))"
    return f"""WITH RECURSIVE r AS ({numbers}), c AS (SELECT count(*)::BIGINT AS n, ceil(sqrt(count(*)))::BIGINT AS mh FROM r),
 w(x, k, n, mh, ml, y) AS (SELECT x::BIGINT, 0, n, mh, (n + mh - 1) // mh, x::BIGINT FROM r, c UNION ALL SELECT x, k + 1, n, mh, ml, a * ml + b FROM ({pairs}))
 SELECT x, y AS place FROM w WHERE k > 0 AND y < n"""
