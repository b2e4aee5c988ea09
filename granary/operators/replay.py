"""A semantic cache replayed in order of time.

A request is answered by the most similar of the entries stored before it, if that is similar enough, and stores nothing then; otherwise it becomes an entry. So whether
a request is stored depends on all before it. Requests are taken in blocks of time: a block meets the entries of earlier blocks in matrix products, all at once;
then it is replayed in order, against its own entries only. Blocks double from a small first one to a bounded size, and several thresholds are replayed together, so that there are few steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.operators.curate import _ensure_checkpoint
from granary.operators.packing import prefix_sums
from granary.operators.tiles import VECTOR_ROWS, _matrix

#: Requests of the largest block of time, and rows of a matrix product in it.
BLOCK, STEP = 16_384, 256


def _units(table: pa.Table) -> np.ndarray:
    x = _matrix(table.column("v"))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _sizes(rows: int, first: int) -> list[int]:
    """Sizes of the blocks of time: doubled from the first up to ``BLOCK``."""
    out, size = [], first
    while rows > 0:
        out.append(min(size, rows))
        rows, size = rows - size, max(size, min(2 * size, BLOCK))
    return out


def replay_semantic(requests: DataFrame, tau: float, block: int = BLOCK, digits: int = 12) -> DataFrame:
    """``qid, hit, entry, similarity, same`` for each of ``requests(qid, at, v, intent)`` in order of the number ``at`` and of ``qid``.

    ``entry`` is the most similar stored request, the earlier one on a tie (null while nothing is stored), ``similarity`` their cosine to ``digits`` digits, ``hit`` whether it reaches ``tau``, and
    ``same`` whether a hit's intents agree, which null ones never do. Requests with a null id, time or vector take no part; ids must differ. The first block has ``block`` requests, later ones up to ``BLOCK``.
    A block is one step: their number grows with the table, the work against earlier entries is spread over all tasks, that within the block is a task of its own.
    """
    return _replays(requests, [tau], block, digits).drop("t")


def _replays(requests: DataFrame, taus: list[float], block: int, digits: int) -> DataFrame:
    """The replay at each of ``taus``, whose place in the list is ``t``."""
    spark = requests.sparkSession
    _ensure_checkpoint(spark)
    clean = requests.where("qid is not null and at is not null and v is not null").select("qid", F.col("at").cast("double").alias("at"), "v", "intent")
    # Places in time, 0 and up; ids are looked up by place, so that ties go to the earlier one.
    starts = prefix_sums(clean.groupBy("at").agg(F.count("*").alias("n")), order="at").select("at", F.col("start").cast("long").alias("start"))
    within = F.row_number().over(Window.partitionBy("at").orderBy("qid")) - 1
    placed = clean.withColumn("within", within).join(starts, "at").select((F.col("start") + F.col("within")).alias("place"), "qid", "v", "intent").checkpoint()
    schema = "t int, place long, best long, score double"

    def against_stored(table: pa.Table) -> pa.Table:
        """The most similar entry of a tile for each request and threshold; ``stored`` tells at which thresholds a row is an entry, null for a request."""
        table = table.sort_by("place")
        asks = table.column("stored").is_null().to_numpy()
        held, now = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        x, q, places, asked = _units(held), _units(now), held.column("place").to_numpy(), now.column("place").to_numpy()
        masks, out = held.column("stored").to_numpy(), []
        kept = [np.flatnonzero(masks >> t & 1) for t in range(len(taus))]
        for at in range(0, len(q) if len(x) else 0, STEP):
            near = np.round(q[at : at + STEP] @ x.T, digits)
            for t, some in enumerate(kept):
                if len(some):
                    mine = near if len(some) == len(x) else near[:, some]
                    j = mine.argmax(1)
                    out.append((np.full(len(j), t), asked[at : at + STEP], places[some[j]], mine[np.arange(len(j)), j]))
        t, place, best, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 4
        return pa.table({"t": pa.array(t, pa.int32()), "place": pa.array(place, pa.int64()), "best": pa.array(best, pa.int64()), "score": pa.array(score, pa.float64())})

    def in_order(table: pa.Table) -> pa.Table:
        """A block at one threshold, request by request; earlier blocks' best entries are known."""
        table = table.sort_by("place")
        tau, x, places = taus[table.column("t")[0].as_py()], _units(table), table.column("place").to_numpy()
        best, score = table.column("best").to_pylist(), table.column("score").to_pylist()
        kept: list[int] = []
        for at in range(0, len(x), STEP):
            rows = x[at : at + STEP]
            before, inside = len(kept), np.round(rows @ rows.T, digits)
            if before:
                near = np.round(rows @ x[kept].T, digits)
                first = near.argmax(1)
            for i in range(len(rows)):
                n, found = at + i, []
                if before:
                    found.append((near[i, first[i]], kept[first[i]]))
                if len(kept) > before:
                    own = np.array(kept[before:])
                    j = int(inside[i, own - at].argmax())
                    found.append((inside[i, own[j] - at], int(own[j])))
                for s, j in found:  # the earlier one first, so it stays on a tie
                    if score[n] is None or s > score[n]:
                        best[n], score[n] = int(places[j]), float(s)
                if score[n] is None or score[n] < tau:
                    kept.append(n)
        return pa.table({"t": table.column("t"), "place": pa.array(places, pa.int64()), "best": pa.array(best, pa.int64()), "score": pa.array(score, pa.float64())})

    stored = decided = None
    entries, start = 0, 0
    every = F.explode(F.array(*[F.lit(t) for t in range(len(taus))]))
    misses = F.coalesce(F.element_at(F.array(*[F.lit(float(x)) for x in taus]), F.col("t") + 1) > F.col("score"), F.lit(True))
    for number, size in enumerate(_sizes(placed.count(), block)):
        now = placed.where((F.col("place") >= start) & (F.col("place") < start + size)).select("place", "v")
        start += size
        met = now.select(every.alias("t"), "place", "v")
        if stored is None:
            met = met.select("*", F.lit(None).cast("long").alias("best"), F.lit(None).cast("double").alias("score"))
        else:
            cells = max(1, -(-entries // VECTOR_ROWS))
            tiles = stored.select(F.pmod(F.xxhash64("place"), F.lit(cells)).cast("int").alias("b"), "place", "v", "stored").unionByName(now.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("b"), "place", "v", F.lit(None).cast("long").alias("stored")))
            near = tiles.groupBy("b").applyInArrow(against_stored, schema).groupBy("t", "place").agg(F.max(F.struct("score", (-F.col("best")).alias("last"))).alias("m"))
            met = met.join(near.select("t", "place", (-F.col("m.last")).alias("best"), F.col("m.score").alias("score")), ["t", "place"], "left")
        settled = met.groupBy("t").applyInArrow(in_order, schema).checkpoint()
        mask = F.sum(F.element_at(F.array(*[F.lit(1 << t).cast("long") for t in range(len(taus))]), F.col("t") + 1)).alias("stored")
        fresh = settled.where(misses).groupBy("place").agg(mask).join(now, "place").select("place", "v", "stored").checkpoint()
        entries += fresh.count()
        stored = fresh if stored is None else stored.unionByName(fresh)
        decided = settled if decided is None else decided.unionByName(settled)
        if number % 8 == 7:
            stored, decided = stored.checkpoint(), decided.checkpoint()
    if decided is None:
        return spark.createDataFrame([], "t int, qid long, hit boolean, entry long, similarity double, same boolean")
    out = placed.select("place", "qid", "intent").join(decided, "place")
    out = out.join(placed.select(F.col("place").alias("best"), F.col("qid").alias("entry"), F.col("intent").alias("had")), "best", "left")
    hit = ~misses
    return out.select("t", "qid", hit.alias("hit"), "entry", F.col("score").alias("similarity"), (hit & F.coalesce(F.col("intent") == F.col("had"), F.lit(False))).alias("same"))


def replayed_sweep(requests: DataFrame, taus: list[float], block: int = BLOCK) -> DataFrame:
    """``tau, hit_rate, false_of_hits, false_of_total`` of the replay at each threshold."""
    if len(taus) > 60:  # a bit for each in a long number
        return replayed_sweep(requests, taus[:60], block).unionByName(replayed_sweep(requests, taus[60:], block))
    n, hits = F.count("*"), F.count_if("hit")
    false = F.count_if(F.col("hit") & ~F.coalesce("same", F.lit(False)))
    rates = _replays(requests, taus, block, 12).groupBy("t").agg((hits / n).alias("hit_rate"), F.coalesce(F.try_divide(false, hits), F.lit(0.0)).alias("false_of_hits"), (false / n).alias("false_of_total"))
    named = requests.sparkSession.createDataFrame([(t, float(x)) for t, x in enumerate(taus)], "t int, tau double")
    return named.join(rates, "t", "left").select("tau", "hit_rate", "false_of_hits", "false_of_total")
