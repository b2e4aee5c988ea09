"""Caches in order of time, over tables and over streams."""

import datetime
import random
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from granary.operators import replay
from granary.streaming import caches


def brute_replay(rows, tau):
    stored, out = [], {}
    for qid, _, v, intent in sorted(rows, key=lambda r: (r[1], r[0])):
        best = None
        for other, u, had in stored:
            s = round(float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v)), 12)
            if best is None or s > best[1]:
                best = (other, s, had)
        hit = best is not None and best[1] >= tau
        out[qid] = (hit, best and best[0], best and best[1], hit and intent is not None and best[2] == intent)
        if not hit:
            stored.append((qid, np.array(v), intent))
    return out


def test_semantic_replay_in_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 6))
    rows = []
    for i in range(140):
        c = int(rng.integers(9))
        rows.append((i, float(rng.integers(0, 60)), (centres[c] + 0.35 * rng.normal(size=6)).tolist(), c if rng.random() < 0.8 else None))
    table = spark.createDataFrame([*rows, (500, None, [1.0] * 6, 1), (501, 1.0, None, 1)], "qid long, at double, v array<double>, intent int").repartition(3)
    for block in (30, 4096):
        got = {r.qid: (r.hit, r.entry, r.similarity, bool(r.same)) for r in replay.replay_semantic(table, 0.9, block).collect()}
        want = brute_replay(rows, 0.9)
        assert {q: (h, e) for q, (h, e, _, _) in got.items()} == {q: (h, e) for q, (h, e, _, _) in want.items()}
        assert all(abs((got[q][2] or 0) - (want[q][2] or 0)) < 1e-9 and got[q][3] == bool(want[q][3]) for q in want)
    assert replay.replay_semantic(table.where("false"), 0.9).count() == 0


def brute_cache(rows, ttl, capacity):
    held, out = {}, {}
    for request, shard, key, t in sorted(rows, key=lambda r: (r[3], r[0])):
        cache = held.setdefault(shard, OrderedDict())
        for k in [k for k, w in cache.items() if t >= w + ttl]:
            del cache[k]
        out[request] = key in cache
        cache[key] = cache.pop(key, t)
        if len(cache) > capacity:
            cache.popitem(last=False)
    return out


def requests_of(seed, n=300):
    rng = random.Random(seed)
    return [(i, rng.randint(0, 2), f"k{int(12 * rng.random() ** 2)}", rng.randint(0, 4000)) for i in range(n)]


def test_bounded_cache_over_a_table(spark):
    rows = requests_of(1)
    table = spark.createDataFrame([(a, b, c, datetime.datetime.fromtimestamp(d)) for a, b, c, d in rows], "request long, shard int, key string, ts timestamp")
    for ttl, capacity in ((500.0, 4), (1e9, 3), (50.0, 100)):
        found = caches.replay_bounded(table, ttl, capacity).collect()
        assert {r.request: r.hit for r in found} == brute_cache(rows, ttl, capacity) and max(r.size for r in found) <= capacity


def test_the_stream_gives_what_the_table_gives_also_after_a_restart(spark, tmp_path):
    rows = sorted(requests_of(2, 240), key=lambda r: (r[3], r[0]))
    folder = tmp_path / "in"
    folder.mkdir()

    def put(number, some):
        frame = pd.DataFrame([(a, b, c, pd.Timestamp(d, unit="s")) for a, b, c, d in some], columns=["request", "shard", "key", "ts"]).astype({"request": "int64", "shard": "int32"})
        pq.write_table(pa.Table.from_pandas(frame, preserve_index=False), folder / f"{number}.parquet", coerce_timestamps="us")

    def run():
        stream = spark.readStream.schema("request long, shard int, key string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
        return caches.run_to_table(caches.cached(stream, 500.0, 4, late="1 minute"), f"file://{tmp_path}/out")

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        for i in range(2):
            put(i, rows[60 * i : 60 * i + 60])
        assert run().count() == 120
        # The state is read back from the checkpoint; a row far behind the rest is dropped.
        put(2, rows[120:180])
        put(3, [*rows[180:], (9999, 0, "k0", 1)])
        got = {r.request: r.hit for r in run().collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == brute_cache(rows, 500.0, 4)


def test_replay_takes_few_blocks_and_thresholds_together(spark):
    rng = random.Random(11)
    rows = [(i, i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(400)]
    assert len(replay._sizes(100_000, 200)) < 15 and sum(replay._sizes(100_000, 200)) == 100_000 and max(replay._sizes(10**6, 200)) == replay.BLOCK
    table = spark.createDataFrame(rows, "qid long, at long, v array<double>, intent int")
    taus = [0.3, 0.9]
    for t, tau in enumerate(taus):
        got = {r.qid: (r.hit, r.entry, r.similarity) for r in replay._replays(table, taus, 30, 12).where(f"t = {t}").collect()}
        assert got == {r.qid: (r.hit, r.entry, r.similarity) for r in replay.replay_semantic(table, tau, 400).collect()}
