"""Replay of caches, rate limits and request counters over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import text as T
from granary.operators import tiles


def embedding_key(text: Column, model: str) -> Column:
    return F.concat(F.lit(f"emb:{model}:"), F.sha2(F.concat(F.lit(model + "\n"), text), 256))


def response_key(query: Column, filters: Column, config: Column) -> Column:
    """Key of a request: a digest of its canonical JSON."""
    return F.concat(F.lit("resp:"), F.sha2(F.to_json(F.struct(config.alias("config"), filters.alias("filters"), query.alias("query"))), 256))


def idempotency_key(tool: Column, args: Column) -> Column:
    return F.substring(F.sha2(F.concat(tool, F.lit("\0"), args), 256), 1, 32)


def backoff(attempt: Column, base: float = 0.5, most: float = 8.0, key: Column | None = None) -> Column:
    """Seconds before an attempt is made again, doubling; with a hexadecimal ``key`` up to a tenth more, by the key."""
    wait = F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))
    return wait if key is None else wait + wait * 0.1 * (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % 1000) / 1000


def replay_exact(requests: DataFrame, key: str, order: list[str], latency: str) -> DataFrame:
    """Every request marked as hit or miss of an unbounded exact cache: ``hit`` and, for hits, the latency of the first as ``saved``."""
    w = Window.partitionBy(key).orderBy(*order)
    return requests.withColumn("hit", F.row_number().over(w) > 1).withColumn("saved", F.when(F.row_number().over(w) > 1, F.first(latency).over(w)))


def replay_ttl(requests: DataFrame, key: str, ts: str, ttl: float, tie: str) -> DataFrame:
    """Hits of a cache whose entries live ``ttl`` seconds from the miss that wrote them.

    Which miss wrote an entry depends on all earlier ones of the key, so each key's requests pass in order through one function; a key's
    history is read as a stream of batches and only the time of its entry is kept. Keys are grouped into hash partitions.
    """
    ordered = requests.withColumn("sec", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).repartition(F.col(key)).sortWithinPartitions(key, "sec", tie)
    fields = ordered.schema

    def run(frames):
        now, written = None, None
        for frame in frames:
            hits = []
            for k, t in zip(frame[key], frame["sec"], strict=True):
                if k != now:
                    now, written = k, None
                hit = written is not None and t < written + ttl
                if not hit:
                    written = t
                hits.append(hit)
            yield frame.assign(hit=hits)

    from pyspark.sql.types import BooleanType, StructType

    return ordered.mapInPandas(run, StructType(list(fields.fields)).add("hit", BooleanType())).drop("sec")


def hit_stats(replayed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``requests, hits, misses, hit_rate``."""
    n, hits = F.count("*"), F.sum(F.col("hit").cast("int"))
    return replayed.groupBy(*(by or [])).agg(n.alias("requests"), hits.alias("hits"), (n - hits).alias("misses"), (hits / n).alias("hit_rate"))


def nearest_entry(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """For every request ``(qid, q, q_intent)`` the most similar entry ``(doc_id, v, intent)``: ``qid, doc_id, similarity, same``."""
    best = tiles.nearest(entries, requests, 1, "cosine").select("qid", "doc_id", F.col("score").alias("similarity"))
    return best.join(entries.select("doc_id", "intent"), "doc_id").join(requests.select("qid", "q_intent"), "qid").select("qid", "doc_id", "similarity", (F.col("intent") == F.col("q_intent")).alias("same"))


def sweep_thresholds(nearest: DataFrame, taus: list[float]) -> DataFrame:
    """Hit rate and false hits of a semantic cache for each threshold: ``tau, hit_rate, false_of_hits, false_of_total``."""
    grid = nearest.sparkSession.createDataFrame([(float(t),) for t in taus], "tau double")
    n = F.count("*")
    hits = F.count_if(F.col("similarity") >= F.col("tau"))
    false = F.count_if((F.col("similarity") >= F.col("tau")) & ~F.col("same"))
    return nearest.crossJoin(F.broadcast(grid)).groupBy("tau").agg((hits / n).alias("hit_rate"), F.coalesce(F.try_divide(false, hits), F.lit(0.0)).alias("false_of_hits"), (false / n).alias("false_of_total"))


def operating_point(sweep: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """The threshold with the fewest false hits; within the tolerance the one with most hits, then the lowest."""
    least = sweep.agg(F.min("false_of_total").alias("least"))
    return sweep.crossJoin(F.broadcast(least)).where(F.col("false_of_total") <= F.col("least") + tolerance).orderBy(F.desc("hit_rate"), "tau").limit(1).drop("least")


def layered_lookup(exact: DataFrame, semantic: DataFrame) -> DataFrame:
    """``qid, answer, layer``: the exact cache's answer, else the semantic one's."""
    joined = exact.select("qid", F.col("answer").alias("e")).join(semantic.select("qid", F.col("answer").alias("s")), "qid", "full")
    return joined.select("qid", F.coalesce("e", "s").alias("answer"), F.when(F.col("e").isNotNull(), "exact").when(F.col("s").isNotNull(), "semantic").alias("layer"))


def token_bucket(requests: DataFrame, key: str, ts: str, tie: str, capacity: float = 10.0, rate: float = 1.0, cost: float = 1.0) -> DataFrame:
    """Token buckets: ``allowed`` and ``retry_after`` seconds for every request; one that is denied takes no tokens.

    A bucket's level depends on all earlier requests of its key; keys stream through in order and only one level is kept.
    """
    ordered = requests.withColumn("sec", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).repartition(F.col(key)).sortWithinPartitions(key, "sec", tie)

    def run(frames):
        now, level, last = None, capacity, 0.0
        for frame in frames:
            allowed, wait = [], []
            for k, t in zip(frame[key], frame["sec"], strict=True):
                if k != now:
                    now, level, last = k, capacity, t
                level = min(capacity, level + (t - last) * rate)
                last = t
                ok = level >= cost
                allowed.append(ok)
                wait.append(0.0 if ok else (cost - level) / rate)
                level -= cost if ok else 0.0
            yield frame.assign(allowed=allowed, retry_after=wait)

    from pyspark.sql.types import BooleanType, DoubleType, StructType

    schema = StructType(list(ordered.schema.fields)).add("allowed", BooleanType()).add("retry_after", DoubleType())
    return ordered.mapInPandas(run, schema).drop("sec")


def longest_prefix(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Longest shared token prefix of each request with any entry: ``qid, matched``.

    Every prefix is named by a hash that is chained token by token; prefixes meet in an equi-join. Of entries, only as many tokens are read
    as the longest request has.
    """
    def prefixes(table: DataFrame, key: str) -> DataFrame:
        # The hashes of all prefixes so far; the last one and the next token give the next.
        chained = F.reduce("tokens", F.array(F.lit(42).cast("long")), lambda hs, t: F.concat(hs, F.array(F.xxhash64(F.element_at(hs, -1), t))))
        named = table.where(F.size("tokens") > 0).select(key, F.posexplode(F.slice(chained, 2, F.size("tokens"))).alias("n", "h"))
        return named.select(key, (F.col("n") + 1).alias("n"), "h")

    longest = requests.agg(F.max(F.size("tokens"))).first()[0] or 0
    cut = entries.withColumn("tokens", F.slice("tokens", 1, max(longest, 0)))
    mine = prefixes(requests, "qid").join(prefixes(cut, "entry").select("n", "h").distinct(), ["n", "h"], "left_semi")
    found = mine.groupBy("qid").agg(F.max("n").alias("matched"))
    return requests.select("qid").join(found, "qid", "left").select("qid", F.coalesce("matched", F.lit(0)).alias("matched"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    stop = F.array_position(same, F.lit(False))
    return F.when(stop > 0, stop - 1).otherwise(F.least(F.size(a), F.size(b)))


def latency_report(events: DataFrame, by: str, value: str) -> DataFrame:
    """Exact linear percentiles and the mean of finite values per group."""
    kept = events.where(F.col(value).isNotNull() & ~F.isnan(value))
    return kept.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *[F.percentile(value, F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)])


# Upper bounds of the latency histogram, in seconds.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]


def histogram(events: DataFrame, by: str, value: str, bounds: list[float] | None = None) -> DataFrame:
    """Cumulative counts of values at or below each bound: ``by, le, n``."""
    bounds = bounds or LATENCY_BUCKETS
    counts = events.groupBy(by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]))
    return counts.select(by, rows.alias("r")).select(by, "r.le", "r.n")


def load_report(requests: DataFrame, ttft_slo: float = 0.5, tpot_slo: float = 0.05) -> DataFrame:
    """Requests, goodput (both limits kept) and latency percentiles of ``ttft, tpot, total``."""
    good = F.count_if((F.col("ttft") < ttft_slo) & (F.col("tpot") < tpot_slo))
    return requests.agg(F.count("*").alias("n"), good.alias("good"), (good / F.count("*")).alias("goodput"), F.percentile("ttft", F.lit(0.5)).alias("ttft_p50"), F.percentile("total", F.lit(0.95)).alias("total_p95"))


def static_search(asked: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """Canned web results: ``results(query, rank, title, url, snippet)`` of each of ``asked(qid, query)``, the first k."""
    return asked.join(results.where(F.col("rank") <= k), "query").select("qid", "rank", "title", "url", "snippet")


def verdict_rates(verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``hits, wrong, false_hit_rate`` of verdicts ``correct`` on answers that a cache gave."""
    return verdicts.groupBy(*(by or [])).agg(F.count("*").alias("hits"), F.count_if(~F.col("correct")).alias("wrong"), (F.count_if(~F.col("correct")) / F.count("*")).alias("false_hit_rate"))


def evict_oldest(entries: DataFrame, keep: int = 256) -> DataFrame:
    """The newest entries of a bounded cache."""
    return entries.orderBy(F.desc("ts"), "key").limit(keep)


def poisson_arrivals(requests: DataFrame, rate: float, key: str, seed: int = 0) -> DataFrame:
    """``key, at``: arrival times for the rows of a table in order of a numeric key, with exponential gaps; a row's gap depends on its key and the seed alone."""
    from granary.operators.packing import prefix_sums

    u = (T.draw(seed, F.col(key)) + 0.5) / float(1 << 60)
    gaps = requests.select(key, (-F.log(u) / rate).alias("gap"))
    return prefix_sums(gaps, order=key, value="gap").select(key, (F.col("start") + F.col("gap")).alias("at"))
