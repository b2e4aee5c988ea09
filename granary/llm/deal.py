"""Equi-joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of at least so many rows are dealt, the most frequent ones first, at most so many of them, over so many places each.
FREQUENT, HOTTEST, PLACES = 256, 1024, 64


def join_dealt(many: DataFrame, one: DataFrame, keys: list[str], count: str, by: Column, how: str = "inner", counts: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """``many`` joined with ``one``, which has a row per key and in ``count`` how many rows of ``many`` share it.

    The rows of the most frequent keys are dealt over several places by a hash of ``by``, and their rows in ``one`` are repeated there. The list of these keys is looked up
    first (in ``counts``, if that is cheaper to read than ``one``) and broadcast: it has :data:`HOTTEST` rows at most, whatever the data. All keys are joined alike; which of
    them are dealt changes the work's distribution only. ``how``: inner or left. ``tasks``: so many look the list up, if given.
    """
    often = (one if counts is None else counts).where(F.col(count) >= FREQUENT).select(*keys, count)
    found = (often.coalesce(tasks) if tasks else often).orderBy(F.desc(count), *keys).limit(HOTTEST).select(*keys).collect()
    if not found:
        return many.join(one, keys, how)
    hot = F.broadcast(many.sparkSession.createDataFrame(found, many.select(*keys).schema).withColumn("_hot", F.lit(True)))
    places = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PLACES - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(hot, keys, "left").withColumn("_place", F.explode(places)).drop("_hot")
    left = many.join(hot, keys, "left").withColumn("_place", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(PLACES)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    return left.join(right, [*keys, "_place"], how).drop("_place")
