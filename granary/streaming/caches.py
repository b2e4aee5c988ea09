"""Caches as keyed state of a stream: entries with a time to live, the least recently used ones evicted.

A shard of the cache is one key of the state; its entries are a map. The same rules run over a table in order of time (:func:`replay_bounded`), so a stream that
is read to its end gives what the table gives.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DECIDED = StructType([StructField("request", LongType()), StructField("shard", LongType()), StructField("key", StringType()), StructField("hit", BooleanType()), StructField("size", LongType())])


class BoundedCache:
    """At most ``capacity`` entries that live ``ttl`` seconds from the miss that wrote them, in order of their last use."""

    def __init__(self, ttl: float, capacity: int):
        self.ttl, self.capacity = ttl, capacity
        #: By key: when it was written and when it was last used.
        self.entries: OrderedDict[str, tuple[float, float]] = OrderedDict()
        #: Keys in order of their writing; every time to live is the same, so the first one ends first.
        self.writes: OrderedDict[str, float] = OrderedDict()

    def load(self, entries: list[tuple[str, float, float]]) -> None:
        for key, written, used in sorted(entries, key=lambda e: (e[2], e[1], e[0])):
            self.entries[key] = (written, used)
        for key, written, _ in sorted(entries, key=lambda e: (e[1], e[2], e[0])):
            self.writes[key] = written

    def expire(self, now: float) -> None:
        while self.writes:
            key, written = next(iter(self.writes.items()))
            if now < written + self.ttl:
                return
            self.entries.pop(key)
            self.writes.pop(key)

    def request(self, key: str, now: float) -> bool:
        """Whether the cache holds the key; if not it is written."""
        self.expire(now)
        hit = key in self.entries
        self.entries[key] = (self.entries[key][0] if hit else now, now)
        self.entries.move_to_end(key)
        if not hit:
            self.writes[key] = now
            if len(self.entries) > self.capacity:
                gone, _ = self.entries.popitem(last=False)
                self.writes.pop(gone)
        return hit


class CacheProcessor(StatefulProcessor):
    """A shard's entries as map state; a timer clears what has expired when no request does."""

    def __init__(self, ttl: float, capacity: int):
        self.ttl, self.capacity = ttl, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("entries", StructType([StructField("key", StringType())]), StructType([StructField("written", DoubleType()), StructField("used", DoubleType())]))

    def _cache(self) -> tuple[BoundedCache, dict[str, tuple[float, float]]]:
        before = {k[0]: (v[0], v[1]) for k, v in self.held.iterator()}
        cache = BoundedCache(self.ttl, self.capacity)
        cache.load([(k, *v) for k, v in before.items()])
        return cache, before

    def _keep(self, cache: BoundedCache, before: dict[str, tuple[float, float]]) -> None:
        for key, value in cache.entries.items():
            if before.get(key) != value:
                self.held.updateValue((key,), value)
        for key in before:
            if key not in cache.entries:
                self.held.removeKey((key,))
        if cache.writes:
            end = int((next(iter(cache.writes.values())) + self.ttl) * 1000) + 1
            if end not in set(self.handle.listTimers()):
                self.handle.registerTimer(end)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        cache, before = self._cache()
        # A batch's requests in order of time.
        frame = pd.concat(list(rows)).sort_values(["ts", "request"])
        hits, sizes = [], []
        for k, t in zip(frame["key"], frame["ts"].map(lambda x: x.timestamp()), strict=True):
            hits.append(cache.request(k, t))
            sizes.append(len(cache.entries))
        self._keep(cache, before)
        yield pd.DataFrame({"request": frame["request"], "shard": key[0], "key": frame["key"], "hit": hits, "size": sizes})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        cache, before = self._cache()
        cache.expire(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self._keep(cache, before)
        return iter([])

    def close(self) -> None:
        pass


def cached(requests: DataFrame, ttl: float, capacity: int, late: str = "1 hour") -> DataFrame:
    """Every request of a stream ``request, shard, key, ts`` with ``hit`` and the shard's ``size`` after it.

    A shard's requests are taken batch by batch, in order of time within each; rows later than ``late`` behind the latest time are dropped. Needs the RocksDB state store, which is set here.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = requests.select("request", F.col("shard").cast("long").alias("shard"), F.col("key").cast("string").alias("key"), "ts").where("key is not null and ts is not null").withWatermark("ts", late)
    return marked.groupBy("shard").transformWithStateInPandas(CacheProcessor(ttl, capacity), _DECIDED, "append", "eventTime")


def replay_bounded(requests: DataFrame, ttl: float, capacity: int) -> DataFrame:
    """The same over a table: each shard's requests pass in order of ``ts`` and ``request`` through one cache; only its entries are kept in memory."""
    ordered = requests.select("request", F.col("shard").cast("long").alias("shard"), F.col("key").cast("string").alias("key"), (F.unix_micros("ts") / 1e6).alias("sec")).where("key is not null and sec is not null")
    ordered = ordered.repartition("shard").sortWithinPartitions("shard", "sec", "request")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cache = None, BoundedCache(ttl, capacity)
        for frame in frames:
            hits, sizes = [], []
            for shard, key, t in zip(frame["shard"], frame["key"], frame["sec"], strict=True):
                if shard != now:
                    now, cache = shard, BoundedCache(ttl, capacity)
                hits.append(cache.request(key, t))
                sizes.append(len(cache.entries))
            yield pd.DataFrame({"request": frame["request"], "shard": frame["shard"], "key": frame["key"], "hit": hits, "size": sizes})

    return ordered.mapInPandas(run, _DECIDED)


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there into a Parquet table in a shared folder, with its checkpoint beside it; run again, it goes on where it stopped."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
