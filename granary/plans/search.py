"""Queries over graphs, pruned indexes and caches in order of time, with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from granary.functions import permute, probability
from granary.operators import ann, block_max, graph_search, late, replay, stats
from granary.plans.catalogue import _bm_sql
from granary.plans.registry import asked, docs, items, query, vecs
from granary.sources import shard_source
from granary.sources.readers import table
from granary.streaming import caches, events


@query()
def graph_recall_curve(spark, d):
    """Recall of ten neighbours against the beam's width, and vectors looked at per query."""
    v, q = vecs(spark, d).select("doc_id", "v"), asked(spark, d).select("qid", "q")
    graph = graph_search.build_graph(v)
    found = graph_search.beam_search(graph, v, q, 10, [10, 20, 40, 80])
    return graph_search.recall_curve(found, ann.exact(v, q, 10)).orderBy("width")


@query(f"SELECT x AS row, place, x AS back, count(*) OVER (PARTITION BY place) AS sharers FROM ({permute.place_sql('SELECT event_id AS x FROM events', 'epoch', 3, 1)})")
def epoch_places(spark, d):
    """Where an epoch's order puts each row, and which row the place leads back to."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("row"))
    order = permute.Permutation(rows.count(), "epoch", 3, 1)
    placed = rows.withColumn("place", order.place(F.col("row"))).withColumn("back", order.row(F.col("place")))
    shared = placed.groupBy("place").agg(F.count("*").alias("sharers"))
    return placed.join(shared, "place").select("row", "place", "back", "sharers")


@query("SELECT o_orderkey // 10 AS row, string_agg(o_custkey, ',' ORDER BY o_custkey) AS tokens FROM orders GROUP BY 1")
def committed_shards(spark, d):
    """Rows written as shards in one commit and read back whole."""
    from granary.plans.requests import _folder

    rows = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 10).alias("row")).agg(F.sort_array(F.collect_list("o_custkey")).cast("array<int>").alias("tokens"))
    path = _folder(spark, "committed")
    shard_source.write(rows, path, rows_per_shard=100)
    return shard_source.read(spark, path).select("row", F.array_join("tokens", ",").alias("tokens"))


def _vectors_of(spark, d):
    """Documents and queries of four vectors each: the quarters of an embedding."""
    tokens = vecs(spark, d).select("doc_id", F.explode(F.array(*[F.slice("v", i * 16 + 1, 16) for i in range(4)])).alias("v"))
    wanted = asked(spark, d).select("qid", F.posexplode(F.array(*[F.slice("q", i * 16 + 1, 16) for i in range(4)])).alias("pos", "q"))
    return tokens, wanted


@query()
def late_pruned_recall(spark, d):
    """Recall of the pruned late interaction against all documents scored."""
    tokens, wanted = _vectors_of(spark, d)
    found = late.LateIndex(tokens).search(wanted, 10)
    return late.recall(found, late.exact(tokens, wanted, 10), tokens.select("doc_id").distinct().count())


@query(_bm_sql(1.5, 10, "SELECT qid, doc_id, rank, round(round(score, 9), 6) AS score FROM r WHERE rank <= {k}"))
def bm25_block_max(spark, d):
    """The rows of an exhaustive BM25 search from the blocks that can hold them."""
    return block_max.ImpactIndex(docs(spark, d)).search(items(spark, d), 10).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


@query()
def bm25_postings_read(spark, d):
    """How many of the postings of the queries' terms that search reads."""
    return block_max.ImpactIndex(docs(spark, d)).read_share(items(spark, d), 10)


def _replay_sql(taus: str, rows: str) -> str:
    """SQL of the semantic cache in order of ids, a step of a recursion for each request."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v, label AS intent, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
 u AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM v), t AS (SELECT unnest({taus})::DOUBLE AS tau),
 p AS (SELECT a.i, b.i AS j, round(list_dot_product(a.v, b.v) / a.n / b.n, 12) AS s FROM u a JOIN u b ON b.i < a.i),
 w(tau, i, j, s, stored) AS (SELECT tau, 1::BIGINT, NULL::BIGINT, NULL::DOUBLE, [1::BIGINT] FROM t
  UNION ALL SELECT tau, i, j, s, CASE WHEN s IS NOT NULL AND s >= tau THEN stored ELSE list_append(stored, i) END FROM
   (SELECT w.tau, w.i + 1 AS i, w.stored, (m.m).j AS j, (m.m).s AS s FROM w JOIN (SELECT w.tau, w.i, max({{'s': p.s, 'k': -p.j, 'j': p.j}}) AS m FROM w JOIN p ON p.i = w.i + 1 AND list_contains(w.stored, p.j) GROUP BY w.tau, w.i) m ON m.tau = w.tau AND m.i = w.i)),
 r AS (SELECT w.tau, a.qid, coalesce(w.s >= w.tau, FALSE) AS hit, b.qid AS entry, w.s AS similarity, coalesce(w.s >= w.tau, FALSE) AND coalesce(a.intent = b.intent, FALSE) AS same FROM w JOIN v a ON a.i = w.i LEFT JOIN v b ON b.i = w.j) {rows}"""


def _timed(spark, d):
    return vecs(spark, d).select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("at"), "v", F.col("label").alias("intent"))


@query(_replay_sql("[0.5]", "SELECT qid, hit, entry, round(similarity, 6) AS similarity, same FROM r"))
def semantic_replay(spark, d):
    """A semantic cache in order of time: what each request finds among the entries stored before it."""
    found = replay.replay_semantic(_timed(spark, d), 0.5, block=200)
    return found.select("qid", "hit", "entry", F.round("similarity", 6).alias("similarity"), F.coalesce("same", F.lit(False)).alias("same"))


@query(_replay_sql("[0.3, 0.6, 0.9]", "SELECT tau, round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate, round(coalesce(count(*) FILTER (WHERE hit AND NOT same) / nullif(count(*) FILTER (WHERE hit), 0), 0), 6) AS false_of_hits, round(count(*) FILTER (WHERE hit AND NOT same) / count(*), 6) AS false_of_total FROM r GROUP BY tau"))
def semantic_replay_sweep(spark, d):
    """Hit rate and false hits of the replayed cache by threshold."""
    found = replay.replayed_sweep(_timed(spark, d), [0.3, 0.6, 0.9], block=1000)
    return found.select("tau", *[F.round(c, 6).alias(c) for c in ("hit_rate", "false_of_hits", "false_of_total")])


_TTL_SQL = """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 m(user_id, i, t) AS (SELECT user_id, i, t FROM o WHERE i = 1 UNION ALL SELECT user_id, i, t FROM (SELECT o.user_id, o.i, o.t, row_number() OVER (PARTITION BY o.user_id ORDER BY o.i) AS k FROM m JOIN o ON o.user_id = m.user_id AND o.i > m.i AND o.t >= m.t + 86400) WHERE k = 1)
 SELECT o.event_id AS request, o.user_id % 8 AS shard, m.i IS NULL AS hit FROM o LEFT JOIN m ON m.user_id = o.user_id AND m.i = o.i"""


@query(_TTL_SQL)
def cache_stream(spark, d):
    """A cache with a time to live as streaming state, its shards large enough for all keys: hits and misses of the stream of events."""
    from granary.plans.requests import _folder

    requests = events.read_events(spark, d).select(F.col("event_id").alias("request"), (F.col("user_id") % 8).alias("shard"), F.col("user_id").alias("key"), "ts")
    return caches.run_to_table(caches.cached(requests, 86_400.0, 1 << 20, late="40 days"), _folder(spark, "cache")).select("request", "shard", "hit")


@query()
def bounded_cache_replay(spark, d):
    """Hits of a cache of sixteen entries a shard, the least recently used one evicted."""
    requests = table(spark, d, "events").select(F.col("event_id").alias("request"), (F.col("user_id") % 8).alias("shard"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return caches.replay_bounded(requests, 86_400.0, 16).groupBy("shard").agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"), F.max("size").alias("largest"))


_PLACES = "SELECT event_id, event_type, (rank() OVER w - 1 + (count(*) OVER (PARTITION BY event_type, value) + 1) / 2.0::DOUBLE - 0.375::DOUBLE) / (count(*) OVER (PARTITION BY event_type) + 0.25::DOUBLE) AS p FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)"


@query(f"SELECT event_id, event_type, round(p, 12) AS p, round(z, 9) AS z FROM ({probability.norm_ppf_sql(_PLACES)})")
def normal_scores(spark, d):
    """The normal score of every event's value within its type."""
    return stats.normal_scores(table(spark, d, "events"), "event_type", "value", "event_id").select("event_id", "event_type", F.round("p", 12).alias("p"), F.round("z", 9).alias("z"))


_X, _DF = stats.Z, "(n - 1)"


@query(f"""WITH s AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM events GROUP BY event_type),
 t AS (SELECT *, x + (x**3 + x) / 4 / {_DF} + (5 * x**5 + 16 * x**3 + 3 * x) / 96 / {_DF}**2 + (3 * x**7 + 19 * x**5 + 17 * x**3 - 15 * x) / 384 / {_DF}**3 + (79 * x**9 + 776 * x**7 + 1482 * x**5 - 1920 * x**3 - 945 * x) / 92160 / {_DF}**4 AS t FROM (SELECT *, {_X!r}::DOUBLE AS x FROM s))
 SELECT event_type, round(mean, 6) AS mean, round(mean - t * sd / sqrt(n), 6) AS lo, round(mean + t * sd / sqrt(n), 6) AS hi, n FROM t""")
def exact_mean_interval(spark, d):
    """Means of events' values by type with intervals from Student's distribution."""
    found = stats.exact_mean_interval(table(spark, d, "events"), ["event_type"], "value")
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")], "n")
