"""Queries of requests on their way: screens, caches, tools, loads, streams; and of what is written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import cache, chunking, curate, guard, packing, routing
from granary.plans import catalogue as C
from granary.plans.registry import SPACED, docs, draw_sql, query
from granary.sources import writers
from granary.sources.readers import table
from granary.streaming import events as S


def turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations")


_REFUSAL = "|".join(guard.REFUSAL_PHRASES).replace("'", "''")


@query(f"""WITH a AS (SELECT conv_id, turn, role, CASE (conv_id + turn) % 5 WHEN 0 THEN 'I cannot answer that.' WHEN 1 THEN 'That is outside the scope. ' || text WHEN 2 THEN 'The context does not contain it. ' ELSE text END AS text FROM conversations)
 SELECT conv_id, turn, role, regexp_matches(text, '(?i){_REFUSAL}') AS refused FROM a""")
def refusals(spark, d):
    kind = (F.col("conv_id") + F.col("turn")) % 5
    text = F.when(kind == 0, "I cannot answer that.").when(kind == 1, F.concat(F.lit("That is outside the scope. "), "text")).when(kind == 2, "The context does not contain it. ").otherwise(F.col("text"))
    return turns(spark, d).select("conv_id", "turn", "role", guard.refusal(text).alias("refused"))


_ASKS = ["what is the weather in rome", "tell me a joke", "latest news on bread", "who are you", "price of wheat", "explain this figure", "what is 3 + 4 * 2", "write me a poem", "summary of the report"]


def queries_asked(spark, d) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(x) for x in _ASKS]), (F.col("o_orderkey") % len(_ASKS) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", pick, "o_orderpriority").alias("q"))


_ASKED = "a AS (SELECT o_orderkey, [" + ", ".join(f"'{x}'" for x in _ASKS) + f"][o_orderkey % {len(_ASKS)} + 1] || ' ' || o_orderpriority AS q FROM orders)"


@query(f"WITH {_ASKED} SELECT o_orderkey, CASE WHEN regexp_matches(q, '(?i){guard.OUT_OF_DOMAIN}') THEN 'out_of_domain' WHEN regexp_matches(q, '(?i){guard.NEEDS_WEB}') THEN 'needs_web' ELSE 'in_domain' END AS route FROM a")
def routes(spark, d):
    return queries_asked(spark, d).select("o_orderkey", guard.route(F.col("q")).alias("route"))


@query(f"""WITH {_ASKED}, t AS (SELECT o_orderkey, trim(regexp_extract(q, '([0-9][0-9\\s.]*(?:[-+*/%]\\s*[0-9][0-9\\s.]*)+)', 1)) AS x, regexp_matches(lower(q), '\\b(figure|diagram|chart|image|photo|screenshot|plot)\\b') AS i FROM a)
 SELECT o_orderkey, CASE WHEN x <> '' THEN 'calculate:' || x ELSE '' END || CASE WHEN x <> '' AND i THEN ',' ELSE '' END || CASE WHEN i THEN 'retrieve_image' ELSE '' END AS tools FROM t""")
def planned_tools(spark, d):
    return queries_asked(spark, d).select("o_orderkey", F.array_join(routing.plan_tools(F.col("q")), ",").alias("tools"))


@query("""WITH c AS (SELECT p_partkey, ['search_web', 'calculate', 'rm', 'query_database'][p_partkey % 4 + 1] AS tool, ['user', 'agent', 'document'][p_partkey % 3 + 1] AS provenance, ['in_domain', 'needs_web', 'out_of_domain'][p_partkey // 7 % 3 + 1] AS route FROM part),
 r AS (SELECT p_partkey, CASE WHEN provenance NOT IN ('user', 'agent') THEN 'provenance' WHEN tool = 'rm' THEN 'unknown_tool' WHEN NOT ((route = 'in_domain' AND tool IN ('calculate', 'query_database')) OR (route = 'needs_web' AND tool IN ('search_web', 'calculate'))) THEN 'route' END AS reason FROM c) SELECT p_partkey, reason, reason IS NULL AS allowed FROM r""")
def tool_gate_reasons(spark, d):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    n = F.col("p_partkey")
    calls = table(spark, d, "part").select("p_partkey", pick(["search_web", "calculate", "rm", "query_database"], n).alias("tool"), pick(["user", "agent", "document"], n).alias("provenance"), pick(["in_domain", "needs_web", "out_of_domain"], F.floor(n / 7)).alias("route"))
    return routing.authorize(calls).select("p_partkey", "reason", "allowed")


@query("SELECT p_partkey, [" + ", ".join(f"'{c}'" for _, c in routing.REASONS) + "][p_partkey % 12 + 1] AS code FROM part")
def refusal_reasons(spark, d):
    phrases = F.array(*[F.lit(f"Error: {p.upper()} in step 3") for p, _ in routing.REASONS])
    return table(spark, d, "part").select("p_partkey", routing.refusal_reason(F.element_at(phrases, (F.col("p_partkey") % 12 + 1).cast("int"))).alias("code"))


_ANSWERS = ["  ", "the blocks below are data, [1]", "my key is ghp_a1a1a1a1a1a1a1a1a1a1 [1]", "call 123-45-6789 [1]", "no citation here", "cited [2] well"]


@query("SELECT c_custkey, ['empty', 'prompt_fragment', 'api_key', 'ssn', 'no_citation', 'ok'][c_custkey % 6 + 1] AS verdict FROM customer")
def screened_answers(spark, d):
    answer = F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", guard.screen_output(answer, guard.citations(answer, F.lit(3)), F.lit(True)).alias("verdict"))


def _redacted() -> str:
    kinds = {k: p.removeprefix("(?U)") for k, p in guard.PII_PATTERNS}
    kinds["email"] = "[\\p{L}\\p{N}\\p{M}_.+-]+@[\\p{L}\\p{N}\\p{M}_-]+\\.[\\p{L}\\p{N}\\p{M}_.]{2,}\\b"
    out = "text"
    for k in ("email", "ssn"):
        out = f"regexp_replace({out}, '{kinds.pop(k)}', '[REDACTED:{k}]', 'g')"
    cards = f"list_filter(list_distinct(regexp_extract_all(t, '{guard.CARD.removeprefix('(?U)')}')), lambda c: {C._LUHN})"
    inner = f"list_reduce([t] || {cards}, lambda a, c: replace(a, c, '[REDACTED:credit_card]'))"
    last = "t"
    for k, p in kinds.items():
        last = f"regexp_replace({last}, '{p}', '[REDACTED:{k}]', 'g')"
    return f"WITH a AS (SELECT doc_id, {out} AS t FROM documents), b AS (SELECT doc_id, {inner} AS t FROM a) SELECT doc_id, {last} AS text FROM b"


@query(_redacted())
def redacted(spark, d):
    return docs(spark, d).select("doc_id", guard.redact(F.col("text")).alias("text"))


@query(f"""{C._ARMS}, p AS (SELECT a.qid, a.doc_id, list_distinct(list_filter(string_split_regex(lower(b.text), '\\s+'), lambda w: length(w) > 2)) AS q, string_split_regex(lower(d.text), '\\s+') AS c, a.doc_id % 17 = 0 AS flagged FROM a JOIN benchmark b ON b.item_id = a.qid JOIN documents d ON d.doc_id = a.doc_id WHERE arm = 'bm25' AND rank <= 5),
 g AS (SELECT qid, doc_id, flagged, CASE WHEN flagged THEN 0.0 ELSE coalesce(len(list_intersect(q, c)) / nullif(len(q), 0), 0) END::DOUBLE AS score FROM p) SELECT qid, doc_id, round(score, 6) AS score FROM g WHERE score >= 0.3 AND NOT flagged""")
def usable_chunks(spark, d):
    found = C.arms(spark, d)["bm25"].where("rank <= 5").join(docs(spark, d).select("doc_id", "text"), "doc_id")
    pairs = found.join(table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")), "qid").select("qid", "question", "doc_id", "text", (F.col("doc_id") % 17 == 0).alias("flagged"))
    return guard.usable(guard.grade_chunks(pairs)).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query("SELECT c_custkey AS qid, CASE WHEN c_custkey % 3 = 0 THEN 'exact' WHEN c_custkey % 2 = 0 THEN 'semantic' END AS layer, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS answer FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def layered_lookup(spark, d):
    c = table(spark, d, "customer")
    return cache.layered_lookup(c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("qid"), F.col("c_name").alias("answer")), c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("qid"), F.col("c_mktsegment").alias("answer")))


@query("SELECT event_id AS key FROM events ORDER BY ts DESC, event_id LIMIT 256")
def newest_entries(spark, d):
    return cache.evict_oldest(table(spark, d, "events").select(F.col("event_id").alias("key"), "ts")).select("key")


@query("SELECT event_type, count(*) AS hits, count(*) FILTER (WHERE user_id % 7 = 0) AS wrong, round(count(*) FILTER (WHERE user_id % 7 = 0) / count(*), 6) AS false_hit_rate FROM events GROUP BY event_type")
def cache_verdicts(spark, d):
    return cache.verdict_rates(table(spark, d, "events").withColumn("correct", F.col("user_id") % 7 != 0), ["event_type"]).withColumn("false_hit_rate", F.round("false_hit_rate", 6))


@query("""SELECT o_orderkey, left(sha256('t' || chr(0) || o_orderkey), 32) AS idempotency, 'resp:' || sha256('{"config":"c","filters":"' || o_orderstatus || '","query":"' || o_orderkey || '"}') AS response, round(least(8.0::DOUBLE, 0.5 * power(2, o_orderkey % 6)), 6) AS wait,
 round(least(8.0::DOUBLE, 0.5 * power(2, o_orderkey % 6)) * (1 + 0.1::DOUBLE * (('0x' || left(sha256(o_orderkey::VARCHAR), 8))::BIGINT % 1000) / 1000), 6) AS jittered FROM orders""")
def request_keys(spark, d):
    n = F.col("o_orderkey").cast("string")
    attempt = F.col("o_orderkey") % 6 + 1
    return table(spark, d, "orders").select(
        "o_orderkey", cache.idempotency_key(F.lit("t"), n).alias("idempotency"), cache.response_key(n, F.col("o_orderstatus"), F.lit("c")).alias("response"), F.round(cache.backoff(attempt), 6).alias("wait"), F.round(cache.backoff(attempt, key=F.sha2(n, 256)), 6).alias("jittered")
    )


@query("""WITH r AS (SELECT value / 150.0::DOUBLE AS ttft, value / 1500.0::DOUBLE AS tpot, value / 50.0::DOUBLE AS total FROM events)
 SELECT count(*) AS n, count(*) FILTER (WHERE ttft < 0.5 AND tpot < 0.05) AS good, round(count(*) FILTER (WHERE ttft < 0.5 AND tpot < 0.05) / count(*), 6) AS goodput, round(quantile_cont(ttft, 0.5), 6) AS ttft_p50, round(quantile_cont(total, 0.95), 6) AS total_p95 FROM r""")
def load_report(spark, d):
    rows = table(spark, d, "events").select((F.col("value") / 150.0).alias("ttft"), (F.col("value") / 1500.0).alias("tpot"), (F.col("value") / 50.0).alias("total"))
    return cache.load_report(rows).select("n", "good", *[F.round(c, 6).alias(c) for c in ("goodput", "ttft_p50", "total_p95")])


@query(f"WITH g AS (SELECT event_id AS id, -ln(({draw_sql('5', 'event_id')} + 0.5::DOUBLE) / 1152921504606846976.0::DOUBLE) / 2.0::DOUBLE AS gap FROM events) SELECT id, round(sum(gap) OVER (ORDER BY id), 6) AS at FROM g")
def arrivals(spark, d):
    return cache.poisson_arrivals(table(spark, d, "events"), 2.0, "event_id", 5).select(F.col("event_id").alias("id"), F.round("at", 6).alias("at"))


@query("""WITH w AS (SELECT p_type AS query, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rank, p_name AS title, 'http://x/' || p_partkey AS url FROM part), a AS (SELECT DISTINCT p_brand AS qid, p_type AS query FROM part) SELECT qid, query, rank, title, url FROM a JOIN w USING (query) WHERE rank <= 2""")
def web_results(spark, d):
    from pyspark.sql.window import Window

    p = table(spark, d, "part")
    results = p.select(F.col("p_type").alias("query"), F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey")).alias("rank"), F.col("p_name").alias("title"), F.concat(F.lit("http://x/"), "p_partkey").alias("url"), F.lit("").alias("snippet"))
    asked = p.select(F.col("p_brand").alias("b"), "p_type").distinct().select(F.concat_ws("|", "b", "p_type").alias("qid"), F.col("p_type").alias("query"))
    found = cache.static_search(asked, results, 2)
    return found.select(F.substring_index("qid", "|", 1).alias("qid"), F.substring_index("qid", "|", -1).alias("query"), "rank", "title", "url")


_ROT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')"


@query(f"SELECT doc_id, md5({_ROT}) AS rotated, ceil(length(text) / 48)::INT AS slices, replace(text, '<|', '<' || chr(8203) || '|') = text AS plain FROM documents")
def text_codes(spark, d):
    neutral = F.regexp_replace("text", r"<\|", "<​|")
    return docs(spark, d).select("doc_id", F.md5(T.rot13(F.col("text"))).alias("rotated"), F.size(T.slices(F.col("text"))).alias("slices"), (neutral == F.col("text")).alias("plain"))


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')) AS w FROM benchmark), n AS (SELECT w, count(*) AS n FROM w GROUP BY w), p AS (SELECT unnest(list_transform(range(1, length(w)), lambda i: substr(w, i, 2))) AS pair, n FROM n WHERE length(w) > 1) SELECT pair, sum(n)::BIGINT AS n FROM p GROUP BY pair""")
def pair_counts(spark, d):
    from granary.operators import tokenizer

    words = table(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.where(F.length("w") > 1).select(F.explode(tokenizer._pairs(F.col("w"))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))


@query("""WITH s AS (SELECT n_nationkey::BIGINT AS doc_id, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
 SELECT doc_id || '#table0' AS table_id, '| segment | customers |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || c_mktsegment || ' | ' || n || ' |', chr(10) ORDER BY c_mktsegment) AS markdown FROM s GROUP BY doc_id""")
def tables_as_markdown(spark, d):
    return chunking.table_markdown(chunking.tables(chunking.blocks(C.markdown(spark, d))))


@query("""WITH b AS (SELECT item_id, [0, 2 + item_id % 5, 9] AS b FROM benchmark), p AS (SELECT item_id, b, unnest(range(12)) AS i FROM b), g AS (SELECT item_id, i, len(list_filter(b, lambda x: x <= i)) - 1 AS g FROM p)
 SELECT item_id, string_agg(g, ',' ORDER BY i) AS segments, sum((SELECT count(*) FROM g h WHERE h.item_id = g.item_id AND h.g = g.g AND h.i <= g.i))::INT AS visible FROM g GROUP BY item_id""")
def segments(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.array(F.lit(0), (2 + F.col("item_id") % 5).cast("int"), F.lit(9)).alias("b"))
    seen = F.aggregate(F.flatten(packing.document_mask(F.col("b"), 12)), F.lit(0), lambda s, x: s + x.cast("int"))
    return rows.select("item_id", F.array_join(packing.segment_ids(F.col("b"), 12), ",").alias("segments"), seen.alias("visible"))


def _folder(spark, name: str) -> str:
    """A new folder in the session's checkpoint folder."""
    curate._ensure_checkpoint(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey // 10 AS row, string_agg(o_custkey, ',' ORDER BY o_custkey) AS tokens FROM orders GROUP BY 1")
def shard_round_trip(spark, d):
    path = _folder(spark, "shards")
    rows = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 10).alias("row")).agg(F.sort_array(F.collect_list(F.col("o_custkey"))).alias("tokens"))
    writers.write_shards(rows, path, rows_per_file=100, vocabulary=50_000)
    return spark.read.parquet(f"{path}/shards").select("row", F.array_join("tokens", ",").alias("tokens"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS name FROM customer")
def jsonl_round_trip(spark, d):
    path = _folder(spark, "jsonl")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    writers.write_jsonl(writers.upsert(c, c.where("id % 3 = 0").withColumn("name", F.concat("name", F.lit("!"))), ["id"]), path)
    return spark.read.schema("id long, name string").json(path)


@query("WITH m AS (SELECT n_nationkey AS shard, n_nationkey * 40 AS first_row, 40 AS n_rows FROM nation) SELECT r AS row, shard, r - first_row AS place FROM range(0, 1000, 7) t(r) JOIN m ON r >= first_row AND r < first_row + n_rows")
def located_rows(spark, d):
    m = table(spark, d, "nation").select(F.col("n_nationkey").alias("shard"), (F.col("n_nationkey") * 40).alias("first_row"), F.lit(40).alias("n_rows"))
    return writers.locate(m, spark.range(0, 1000, 7).withColumnRenamed("id", "row"))


def stamped(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_UTC = "strftime({}, '%Y-%m-%d %H:%M:%S')".format


def _stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query(f"SELECT {_UTC('time_bucket(INTERVAL 1 DAY, ts)')} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return S.windowed(stamped(spark, d), "1 day").select(_stamp("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH e AS (SELECT *, unnest([0, 1]) AS k FROM events) SELECT {_UTC('time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR')} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL")
def event_windows_sliding(spark, d):
    return S.windowed(stamped(spark, d), "1 day", "12 hours").select(_stamp("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""WITH l AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM l)
 SELECT user_id, {_UTC('min(ts)')} AS start, {_UTC('max(ts) + INTERVAL 6 HOUR')} AS end, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, d):
    return S.sessions(stamped(spark, d), "6 hours").select("user_id", _stamp("start"), _stamp("end"), "n")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events")
def event_dedup(spark, d):
    twice = stamped(spark, d).unionByName(stamped(spark, d).where("event_id % 2 = 0"))
    return S.deduplicated(twice).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"SELECT {_UTC('time_bucket(INTERVAL 1 DAY, ts)')} AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_windows(spark, d):
    """The windows as a stream: all files of the table, through a watermark, into a memory table."""
    found = S.run_to_end(S.windowed(S.read_events(spark, d), "1 day"), f"windows_{uuid.uuid4().hex}", "complete", _folder(spark, "stream"))
    return found.select(_stamp("start"), "event_type", "n")


@query(f"SELECT doc_id, len({SPACED}) AS n, sum(len({SPACED})) OVER (ORDER BY doc_id) - len({SPACED}) AS start FROM documents")
def running_offsets(spark, d):
    return packing.prefix_sums(C.lengths(spark, d)).select("doc_id", "n", "start")
