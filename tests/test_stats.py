import random

import pandas as pd
import pytest

from granary.operators import packing, stats


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    some = [(i, draw.choice(["a", "b", None]), draw.choice([None, 0.0, -0.0, 5.0, round(draw.uniform(-9, 9), 2)])) for i in range(600)]
    return some + [(600 + i, "hot", 1.0) for i in range(400)] + [(2000, "only null", None), (2001, "a", float("inf"))]


def groups(rows):
    out = {}
    for i, g, v in rows:
        out.setdefault(g, []).append((i, v))
    return out


def test_mid_ranks(spark, rows):
    table = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r.id: r.mid_rank for r in stats.mid_ranks(table, "v", ["g"]).collect()}
    want = {}
    for members in groups(rows).values():
        values = pd.Series([v for _, v in members], dtype=float)
        want |= dict(zip([i for i, _ in members], values.rank(method="average", na_option="top"), strict=True))
    assert got == want
    alone = {r.id: r.mid_rank for r in stats.mid_ranks(table.where("v is not null"), "v").collect()}
    kept = [(i, v) for i, _, v in rows if v is not None]
    assert alone == dict(zip([i for i, _ in kept], pd.Series([v for _, v in kept]).rank(), strict=True))
    assert stats.mid_ranks(table.limit(0), "v", ["g"]).collect() == []


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_nearest_rank(spark, rows, p):
    table = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r.g: r.value for r in stats.nearest_rank_percentile(table, ["g"], "v", p).collect()}
    lists = {g: sorted(v for _, v in members if v is not None) for g, members in groups(rows).items()}
    assert got == {g: values[round(p * (len(values) - 1))] for g, values in lists.items() if values}
    assert [r.value for r in stats.nearest_rank_percentile(table.where("g = 'hot'"), [], "v", p).collect()] == [1.0]


def test_signed_ranks(spark):
    draw = random.Random(3)
    pairs = [(g, float(draw.randint(0, 40)), float(draw.randint(0, 40))) for g in ("a", "b") for _ in range(300)] + [("zero", 1.0, 1.0), ("one", 2.0, 1.0)]
    table = spark.createDataFrame(pairs, "g string, x double, y double")
    got = {r.g: (r.n, r.w_plus, r.w_minus, r.w) for r in stats.wilcoxon_sums(table, ["g"], "x", "y").collect()}
    want = {}
    for g in ("a", "b", "one"):
        d = pd.Series([x - y for k, x, y in pairs if k == g and x != y])
        ranks = d.abs().rank()
        plus, minus = ranks[d > 0].sum(), ranks[d < 0].sum()
        want[g] = (len(d), plus, minus, min(plus, minus))
    assert got == want


def test_sums_within_groups(spark):
    rows = [(g, i, i % 3) for g in ("a", None) for i in range(200)]
    table = spark.createDataFrame(rows, "g string, k long, n long")
    got = {(r.g, r.k): r.start for r in packing.prefix_sums(table, order="k", by=("g",)).collect()}
    assert got == {(g, k): sum(i % 3 for i in range(k)) for g, k, _ in rows}
