"""Queries of metrics, judges, evaluation sets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import text as T
from granary.functions import vector as V
from granary.operators import ablation, ann, injection, judging, metrics, report, retrieval, routing, training
from granary.plans import catalogue as C
from granary.plans.registry import SPACED, asked, docs, draw_sql, items, query, vecs
from granary.sources import datasets, readers
from granary.sources.readers import table

_RUN = "r AS (SELECT user_id AS qid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, floor(value)::BIGINT % 3 AS relevance FROM events)"


@query(f"""WITH {_RUN}, k AS (SELECT * FROM r WHERE rank <= 10), b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, rank) AS best FROM k)
 SELECT qid, round(coalesce(sum(relevance / log2(rank + 1)) / nullif(sum(relevance / log2(best + 1)), 0), 0), 6) AS ndcg FROM b GROUP BY qid""")
def graded_ndcg(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.row_number().over(order).alias("rank"), (F.floor("value") % 3).alias("relevance"))
    return metrics.graded_ndcg(run, 10).select("qid", F.round("ndcg", 6).alias("ndcg"))


@query(f"{C._METRICS}, hq AS (SELECT sz.qid, CASE WHEN min(a.rank) IS NULL THEN 0.0::DOUBLE ELSE 1 END AS hit FROM sz LEFT JOIN rel ON rel.qid = sz.qid LEFT JOIN a ON a.qid = rel.qid AND a.doc_id = rel.doc_id AND a.arm = 'bm25' AND a.rank <= 5 GROUP BY sz.qid) SELECT round(avg(hit), 6) AS recall FROM hq")
def hit_rate(spark, d):
    return metrics.hit_rate(C.arms(spark, d)["bm25"], C.qrels(spark, d), 5).select(F.round("recall", 6).alias("recall"))


@query("""WITH c AS (SELECT l_orderkey, list_distinct(list(l_partkey) FILTER (WHERE l_linenumber <= 3)) AS cited, list_distinct(list(l_partkey) FILTER (WHERE l_linenumber >= 2)) AS expected FROM lineitem GROUP BY l_orderkey)
 SELECT l_orderkey, round(coalesce(len(list_intersect(cited, expected)) / nullif(len(cited), 0), 0), 6) AS p, round(coalesce(len(list_intersect(cited, expected)) / nullif(len(expected), 0), 0), 6) AS r FROM (SELECT l_orderkey, coalesce(cited, []) AS cited, coalesce(expected, []) AS expected FROM c)""")
def citation_scores(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_partkey"))).alias("cited"), F.collect_set(F.when(F.col("l_linenumber") >= 2, F.col("l_partkey"))).alias("expected"))
    p, r = metrics.citation_scores(F.col("cited"), F.col("expected"))
    return lines.select("l_orderkey", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"))


_PROBABILITIES = "p AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: abs(x) / list_sum(list_transform(embedding::DOUBLE[], lambda y: abs(y)))) AS p FROM embeddings)"


@query(f"""WITH {_PROBABILITIES}, k AS (SELECT vec_id, list_filter(p, lambda x: x >= list_reverse_sort(p)[8]) AS k, list_filter(p, lambda x: coalesce(list_sum(list_filter(p, lambda y: y > x)), 0) < 0.9) AS n, list_filter(p, lambda x: x >= 0.5 * list_max(p)) AS m FROM p)
 SELECT vec_id, len(k) AS top_k, round(list_sum(k), 6) AS top_k_mass, len(n) AS top_p, round(list_sum(n), 6) AS top_p_mass, len(m) AS min_p, round(list_sum(m), 6) AS min_p_mass FROM k""")
def sampling_filters(spark, d):
    rows = vecs(spark, d).select(F.col("doc_id").alias("vec_id"), F.transform("v", lambda x: F.abs(x)).alias("a"))
    rows = rows.select("vec_id", F.transform("a", lambda x: x / V._sum(F.col("a"))).alias("p"))
    kept = rows.select("vec_id", metrics.top_k_filter(F.col("p"), 8).alias("top_k"), metrics.top_p_filter(F.col("p"), 0.9).alias("top_p"), metrics.min_p_filter(F.col("p"), 0.5).alias("min_p"))
    return kept.select("vec_id", *[c for n in ("top_k", "top_p", "min_p") for c in (F.size(F.filter(n, lambda x: x > 0)).alias(n), F.round(V._sum(F.col(n)), 6).alias(f"{n}_mass"))])


@query("SELECT event_id, round(CASE WHEN stddev_pop(value) OVER w = 0 THEN 0 ELSE (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6) END, 6) AS advantage FROM events WINDOW w AS (PARTITION BY event_type, user_id % 10)")
def group_advantages(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat_ws(" ", "event_type", F.col("user_id") % 10).alias("prompt"), F.col("value").alias("reward"))
    return metrics.group_advantages(rows).select("event_id", F.round("advantage", 6).alias("advantage"))


@query("SELECT p_partkey, round(exp(least(p_size / 2.0::DOUBLE, 20)), 4) AS perplexity, round(p_size / 2.0::DOUBLE / ln(2) / 4.2::DOUBLE, 6) AS bits FROM part")
def loss_measures(spark, d):
    loss = F.col("p_size") / 2.0
    return table(spark, d, "part").select("p_partkey", F.round(metrics.perplexity(loss), 4).alias("perplexity"), F.round(metrics.bits_per_byte(loss, F.lit(4.2)), 6).alias("bits"))


@query("""WITH g AS (SELECT c_custkey, c_acctbal / 4000.0::DOUBLE AS gap, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS cur, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 4000.0::DOUBLE END AS base FROM customer)
 SELECT c_custkey, CASE WHEN abs(gap) < 0.3 THEN 'tie' WHEN abs(gap) < 1.0 THEN 'slight' ELSE 'clear' END AS gap, CASE WHEN base IS NULL THEN 'skip' WHEN cur IS NULL THEN 'error' WHEN cur < base - abs(base) * 0.02 THEN 'fail' ELSE 'pass' END AS gate, CASE WHEN c_custkey % 3 = 0 THEN 'B' WHEN c_custkey % 3 = 1 THEN 'A' ELSE 'tie' END AS flipped FROM g""")
def verdicts(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 4000.0).alias("gap"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("cur"), F.when(F.col("c_custkey") % 5 != 0, F.lit(4000.0)).alias("base"))
    verdict = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("tie")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return rows.select("c_custkey", metrics.verdict_for_gap(F.col("gap")).alias("gap"), metrics.check_regression(F.col("cur"), F.col("base")).alias("gate"), metrics.flip(verdict).alias("flipped"))


_CLEAN = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))".format


@query(f"""WITH c AS (SELECT conv_id, turn, text, lead(text) OVER w AS a, lead(text, 2) OVER w AS b FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)), t AS (SELECT conv_id, turn, {_CLEAN('text')} AS c, {_CLEAN('a')} AS a, {_CLEAN('b')} AS b FROM c WHERE b IS NOT NULL),
 g AS (SELECT conv_id, turn, coalesce(len(list_intersect(a, c)) / nullif(len(a), 0), 0) AS a, coalesce(len(list_intersect(b, c)) / nullif(len(b), 0), 0) AS b FROM t)
 SELECT conv_id, turn, round(a, 6) AS a, round(b, 6) AS b, CASE WHEN abs(a - b) < 0.05 THEN 'tie' WHEN a > b THEN 'A' ELSE 'B' END AS verdict, a >= 0.6 AS supported, CASE WHEN abs(a - b) < 0.05 THEN 0.5 WHEN a > b THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM g""")
def judge_grounding(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    rows = table(spark, d, "conversations").where("role <> 'system'").select("conv_id", "turn", "text", F.lead("text").over(w).alias("a"), F.lead("text", 2).over(w).alias("b")).where("b is not null")
    words = rows.select("conv_id", "turn", *[judging.letters_and_digits(F.col(c)).alias(n) for c, n in (("text", "c"), ("a", "wa"), ("b", "wb"))])
    held = words.select("conv_id", "turn", judging.grounding(F.col("wa"), F.col("c")).alias("a"), judging.grounding(F.col("wb"), F.col("c")).alias("b"))
    verdict = judging.compare(F.col("a"), F.col("b"))
    return held.select("conv_id", "turn", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), verdict.alias("verdict"), judging.supports(F.col("a")).alias("supported"), judging.win_score(verdict).alias("score"))


def judged(spark, d) -> DataFrame:
    """Verdicts of people and of a judge in both orders, made of the customers' numbers."""
    pick = lambda n: F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("tie")), (n % 3 + 1).cast("int"))
    return table(spark, d, "customer").select(pick(F.col("c_custkey")).alias("human"), pick(F.col("c_custkey") + F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0)).alias("forward"), pick(F.col("c_nationkey")).alias("backward"))


_JUDGED = "j AS (SELECT ['A', 'B', 'tie'][c_custkey % 3 + 1] AS human, ['A', 'B', 'tie'][(c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END) % 3 + 1] AS forward, ['A', 'B', 'tie'][c_nationkey % 3 + 1] AS backward FROM customer)"


@query(f"WITH {_JUDGED}, v AS (SELECT unnest(['A', 'B', 'tie']) AS v) SELECT h.v AS human, f.v AS verdict, count(j.human) AS n FROM v h CROSS JOIN v f LEFT JOIN j ON j.human = h.v AND j.forward = f.v GROUP BY ALL")
def judge_confusion(spark, d):
    return judging.confusion(judged(spark, d))


@query(f"""WITH {_JUDGED}, t AS (SELECT count(*) AS n, avg((human = forward)::INT) AS po, avg((forward <> CASE backward WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE 'tie' END)::INT) AS swap, avg((forward = 'A' AND backward = 'A')::INT) AS first FROM j),
 e AS (SELECT sum(x.c * y.c)::DOUBLE AS c FROM (SELECT human AS v, count(*) AS c FROM j GROUP BY 1) x JOIN (SELECT forward AS v, count(*) AS c FROM j GROUP BY 1) y USING (v))
 SELECT n, round(po, 6) AS agreement, round((po - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa, round(swap, 6) AS swap_rate, round(first, 6) AS first_rate, (po - c / (n * n)) / (1 - c / (n * n)) >= 0.6 AS trusted FROM t, e""")
def judge_calibration(spark, d):
    return judging.calibration(judged(spark, d)).select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "kappa", "swap_rate", "first_rate")], "trusted")


@query(f"""WITH x AS ({C._PLANTED_SQL}), {C._families_sql()}, v AS (SELECT doc_id, sum(weight) >= 0.85 AS flagged FROM m GROUP BY doc_id), c AS (SELECT doc_id AS id, ['a', 'b', 'c'][doc_id % 3 + 1] AS family, doc_id % 12 < 9 AS attack FROM documents), k AS (SELECT c.*, coalesce(flagged, FALSE) AS flagged FROM c LEFT JOIN v ON v.doc_id = c.id)
 SELECT family, count(*) FILTER (WHERE attack) AS attacks, count(*) FILTER (WHERE attack AND flagged) AS blocked, count(*) FILTER (WHERE NOT attack) AS benign, count(*) FILTER (WHERE NOT attack AND flagged) AS false_alarms, count(*) FILTER (WHERE attack AND NOT flagged) AS missed FROM k GROUP BY ROLLUP (family)""")
def injection_evaluation(spark, d):
    found = injection.scan_plain(C.planted(spark, d)).groupBy(F.col("doc_id").alias("id")).agg((F.least(F.lit(1.0), F.sum("weight")) >= injection.THRESHOLD).alias("flagged"))
    cases = docs(spark, d).select(F.col("doc_id").alias("id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("doc_id") % 3 + 1).cast("int")).alias("family"), F.when(F.col("doc_id") % 12 < 9, "attack").otherwise("benign").alias("label"))
    return injection.evaluate(found, cases).withColumn("missed", F.size("missed").cast("long"))


_PAYLOADS = """p AS (SELECT n_nationkey, n_name, CASE n_nationkey % 4 WHEN 0 THEN '{"metrics": {"ndcg@10": {"mean": 0.' || n_nationkey || ', "lo": 0}}}' WHEN 1 THEN '{"metrics": {"ndcg_at_10": 0.' || n_nationkey || '}}' WHEN 2 THEN '{"summary": {"ndcg@10": {"mean": 0.' || n_nationkey || '}}}' ELSE '{"other": 1}' END AS payload FROM nation)"""


def payloads(spark, d) -> DataFrame:
    """Result files of four shapes, one per nation."""
    n = F.col("n_nationkey").cast("string")
    shapes = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit('{"metrics": {"ndcg@10": {"mean": 0.'), n, F.lit(', "lo": 0}}}'))).when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit('{"metrics": {"ndcg_at_10": 0.'), n, F.lit("}}")))
    shapes = shapes.when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit('{"summary": {"ndcg@10": {"mean": 0.'), n, F.lit("}}}"))).otherwise('{"other": 1}')
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("run"), shapes.alias("payload"))


@query("SELECT n_nationkey AS run, CASE WHEN n_nationkey % 4 < 3 THEN ('0.' || n_nationkey)::DOUBLE END AS value FROM nation")
def extracted_metrics(spark, d):
    return payloads(spark, d).select("run", report.extract_metric(F.col("payload"), "ndcg@10").alias("value"))


@query("SELECT n_nationkey AS run, unnest(['q1', 'q2']) AS qid, unnest([n_nationkey / 4.0::DOUBLE, n_regionkey / 2.0::DOUBLE]) AS value FROM nation")
def per_question_values(spark, d):
    body = F.to_json(F.struct(F.struct(F.create_map(F.lit("q1"), F.col("n_nationkey") / 4.0, F.lit("q2"), F.col("n_regionkey") / 2.0).alias("ndcg_at_10")).alias("per_question")))
    return report.per_question(table(spark, d, "nation").select(F.col("n_nationkey").alias("run"), body.alias("payload")), "ndcg@10")


@query("SELECT '| ' || l_returnflag || ' | ' || printf('%.3f [%.3f, %.3f]', round(avg(l_discount), 3), min(l_discount), max(l_discount)) || ' |' AS line FROM lineitem GROUP BY l_returnflag")
def markdown_report(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.struct(F.round(F.avg("l_discount"), 3).alias("mean"), F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi")).alias("discount"))
    return report.markdown(rows, "l_returnflag", ["discount"])


def golden(spark, d) -> DataFrame:
    """Benchmark items as questions, with a few faults."""
    n = F.col("item_id")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    ids = F.when(n % 9 == 5, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("d"), n % 4), F.concat(F.lit("d"), n % 3)))
    return table(spark, d, "benchmark").select(
        F.concat(F.lit("q"), n % 37).alias("id"), F.col("text").alias("question"), pick(datasets.CATEGORIES[:6], n).alias("category"), pick(datasets.DIFFICULTIES, n).alias("difficulty"), ids.alias("expected_doc_ids"),
        F.when(n % 2 == 0, F.array(F.concat(F.lit("d"), n % 4, F.lit("#0")))).otherwise(F.array().cast("array<string>")).alias("expected_chunk_ids"), (n % 11 != 3).alias("verified"), F.when(n % 13 == 0, "canary").otherwise("").alias("injection_canary"),
    )


_CATEGORY = "[" + ", ".join(f"'{c}'" for c in datasets.CATEGORIES[:6]) + "][item_id % 6 + 1]"
_GOLDEN = f"""g AS (SELECT 'q' || item_id % 37 AS id, text AS question, {_CATEGORY} AS category, ['easy', 'medium', 'hard'][item_id % 3 + 1] AS difficulty, CASE WHEN item_id % 9 = 5 THEN [] ELSE ['d' || item_id % 4, 'd' || item_id % 3] END AS docs, CASE WHEN item_id % 2 = 0 THEN ['d' || item_id % 4 || '#0'] ELSE [] END AS chunks, item_id % 11 <> 3 AS verified, CASE WHEN item_id % 13 = 0 THEN 'canary' ELSE '' END AS canary FROM benchmark)"""


@query(f"""WITH {_GOLDEN} SELECT id, 'out of domain with documents' AS problem FROM g WHERE category = 'out-of-domain' AND len(docs) > 0 UNION ALL SELECT id, 'chunk outside the documents' FROM g WHERE len(list_filter(chunks, lambda c: NOT list_contains(docs, split_part(c, '#', 1)))) > 0
 UNION ALL SELECT id, 'canary without attack or attack without canary' FROM g WHERE (canary <> '') <> (category = 'adversarial-injection') UNION ALL SELECT id, 'repeated document' FROM g WHERE len(list_distinct(docs)) < len(docs) UNION ALL SELECT id, 'repeated id' FROM g GROUP BY id HAVING count(*) > 1""")
def golden_violations(spark, d):
    return readers.golden_violations(golden(spark, d))


@query(f"WITH {_GOLDEN}, c AS (SELECT unnest([{', '.join(repr(c) for c in datasets.CATEGORIES)}]) AS category) SELECT c.category, count(g.id) AS n FROM c LEFT JOIN g USING (category) GROUP BY c.category")
def category_counts(spark, d):
    return datasets.counts(golden(spark, d), "category", datasets.CATEGORIES)


@query(f"WITH {_GOLDEN}, c AS (SELECT unnest(['easy', 'medium', 'hard', 'expert']) AS difficulty) SELECT c.difficulty, count(g.id) AS n FROM c LEFT JOIN g USING (difficulty) GROUP BY c.difficulty")
def difficulty_counts(spark, d):
    return datasets.counts(golden(spark, d), "difficulty", [*datasets.DIFFICULTIES, "expert"])


@query(f"""WITH {_GOLDEN}, c AS (SELECT unnest([{', '.join(repr(c) for c in datasets.CATEGORIES)}]) AS category), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT verified) AS u FROM g)
 SELECT 'no question of category ' || category AS problem FROM c WHERE category NOT IN (SELECT category FROM g) UNION ALL SELECT 'no unanswerable question' WHERE NOT EXISTS (SELECT 1 FROM g WHERE len(docs) = 0) UNION ALL SELECT 'no adversarial question' WHERE NOT EXISTS (SELECT 1 FROM g WHERE category = 'adversarial-injection')
 UNION ALL SELECT u || ' unverified questions' FROM t WHERE u > 0 UNION ALL SELECT n || ' questions, not 150 to 300' FROM t WHERE n NOT BETWEEN 150 AND 300""")
def coverage_problems(spark, d):
    return datasets.coverage_problems(golden(spark, d))


@query(f"WITH {_GOLDEN} SELECT id, category, difficulty FROM g WHERE category IN ('table', 'figure') AND difficulty <> 'easy' AND len(docs) > 0")
def golden_filter(spark, d):
    return datasets.chosen(golden(spark, d), ["table", "figure"], ["medium", "hard"], answerable=True).select("id", "category", "difficulty")


@query(f"WITH {_GOLDEN} SELECT id, CASE WHEN len(chunks) > 0 THEN 'chunk' ELSE 'document' END AS level, array_to_string(list_sort(list_distinct(CASE WHEN len(chunks) > 0 THEN chunks ELSE docs END)), ',') AS relevant FROM g")
def relevant_sets(spark, d):
    return datasets.relevant(golden(spark, d)).select("id", "level", F.array_join(F.sort_array("relevant"), ",").alias("relevant"))


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#12', 'Brand#23')")
def metadata_filter(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("metadata"))
    return rows.where(datasets.matches(F.col("metadata"), {"brand": ["Brand#1", "Brand#12", "Brand#23"]})).select("p_partkey")


@query("SELECT p_partkey || '#0' AS chunk_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 1 ELSE p_partkey END AS doc_id FROM part WHERE p_partkey % 3 = 0")
def stray_chunks(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.col("p_partkey"), F.lit("#0")).alias("chunk_id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") + 1).otherwise(F.col("p_partkey")).alias("doc_id"))
    return datasets.stray_chunks(rows)


@query("SELECT DISTINCT c_custkey AS id, c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")
def promoted(spark, d):
    candidates = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return datasets.promote(candidates, table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id")))


_HASH = "sha256(count(*) || '|' || sum({}::HUGEINT))".format


@query(f"SELECT 'nation' AS name, count(*) AS rows, {_HASH(draw_sql('n_nationkey', 'n_name'))} AS hash FROM nation UNION ALL SELECT 'documents', count(*), {_HASH(draw_sql('doc_id', 'text'))} FROM documents")
def corpus_hashes(spark, d):
    one = lambda name, columns: datasets.content_hash(table(spark, d, name), columns).select(F.lit(name).alias("name"), "rows", "hash")
    return one("nation", ["n_nationkey", "n_name"]).unionByName(one("documents", ["doc_id", "text"]))


@query("SELECT coalesce(e.name, a.name) AS name, CASE WHEN a.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'unexpected' WHEN e.h = a.h THEN 'ok' ELSE 'changed' END AS status FROM (SELECT n_name AS name, n_nationkey AS h FROM nation WHERE n_nationkey < 20) e FULL JOIN (SELECT n_name AS name, n_nationkey + n_nationkey % 2 AS h FROM nation WHERE n_nationkey > 4) a USING (name)")
def manifest_check(spark, d):
    n = table(spark, d, "nation")
    expected = n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("hash"))
    return datasets.verified(expected, n.where("n_nationkey > 4").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + F.col("n_nationkey") % 2).cast("string").alias("hash")))


@query(f"""WITH c AS (SELECT l_orderkey || '#' || l_linenumber AS chunk_id, l_orderkey % 50 AS doc_id FROM lineitem), o AS (SELECT *, row_number() OVER (ORDER BY {draw_sql('11', 'chunk_id')}) AS i FROM c)
 SELECT a.chunk_id AS first, b.chunk_id AS second FROM o a JOIN o b ON b.i = a.i + 1 WHERE a.doc_id <> b.doc_id""")
def two_document_pairs(spark, d):
    chunks = table(spark, d, "lineitem").select(F.concat(F.col("l_orderkey"), F.lit("#"), F.col("l_linenumber")).alias("chunk_id"), (F.col("l_orderkey") % 50).alias("doc_id"))
    return datasets.other_document_pairs(chunks, 11)


@query("""WITH q AS (SELECT p_partkey AS id, p_type AS category, p_name AS question, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}\\p{M}_]+') AS w FROM part), f AS (SELECT *, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')))) AS s FROM q WHERE len(w) BETWEEN 1 AND 64),
 u AS (SELECT f.* FROM f WHERE len(w) < 3 OR id = (SELECT min(g.id) FROM f g WHERE g.s = f.s)) SELECT id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS r FROM u) WHERE r <= 5""")
def question_candidates(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_name").alias("question"))
    return datasets.candidates(rows, quota=5, least=1).select("id", "category")


_TERMS = "q AS (SELECT item_id AS qid, item_id AS doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS terms FROM benchmark)"


def _ablation_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""(WITH {_TERMS}, w AS (SELECT doc_id, {SPACED} AS w FROM documents), c AS (SELECT doc_id AS cd, idx, array_to_string(list_slice(w, idx * {step} + 1, idx * {step} + {size}), ' ') AS text FROM (SELECT doc_id, w, unnest(range(greatest(0, ceil((len(w) - {size}) / {step}::DOUBLE))::BIGINT + 1)) AS idx FROM w WHERE len(w) > 0)),
 t AS (SELECT cd, idx, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM c), a AS (SELECT qid, doc_id, unnest(terms) AS term FROM q),
 h AS (SELECT qid, doc_id, cd, idx, count(*) AS hits FROM t JOIN a USING (term) GROUP BY ALL), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, cd, idx) AS rank FROM h) WHERE rank <= 10),
 r AS (SELECT k.qid, rank, CASE WHEN k.cd = k.doc_id AND len(list_filter(q.terms, lambda x: contains(lower(c.text), x))) >= least(2, len(q.terms)) THEN 1.0::DOUBLE ELSE 0 END AS rel FROM k JOIN c USING (cd, idx) JOIN q ON q.qid = k.qid),
 b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rank) AS best FROM r), p AS (SELECT qid, coalesce(sum(rel / log2(rank + 1)) / nullif(sum(rel / log2(best + 1)), 0), 0) AS ndcg FROM b GROUP BY qid)
 SELECT 'fixed' AS strategy, {size} AS size, {overlap} AS overlap, round(avg(ndcg), 6) AS ndcg, count(*) AS questions FROM p)"""


@query(" UNION ALL ".join(_ablation_sql(s, o) for s, o in ((64, 0), (128, 32))))
def chunk_ablation(spark, d):
    tokens = F.array_sort(F.array_distinct(T.search_tokens(F.col("text"))))
    questions = items(spark, d).select("qid", F.col("qid").alias("doc_id"), tokens.alias("terms"))
    return ablation.compare(docs(spark, d).select("doc_id", "text"), questions, [("fixed", 64, 0), ("fixed", 128, 32)]).withColumn("ndcg", F.round("ndcg", 6))


@query("SELECT model, count(*) AS chunks, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, round(sum(greatest(1, length(text) // 4)) / 1000.0::DOUBLE * price, 6) AS cost, count(*) * ms AS milliseconds FROM documents, (VALUES ('local', 0.0::DOUBLE, 20.0::DOUBLE), ('hosted', 0.002::DOUBLE, 350.0::DOUBLE)) r(model, price, ms) GROUP BY model, price, ms")
def context_costs(spark, d):
    return ablation.context_cost(docs(spark, d), {"local": (0.0, 20.0), "hosted": (0.002, 350.0)}).withColumn("cost", F.round("cost", 6))


@query("SELECT o_orderkey, 0.5::DOUBLE * (o_orderkey % 4 <> 3)::INT + 0.5::DOUBLE * (o_orderkey % 4 <> 3 AND o_orderstatus = 'O')::INT AS reward FROM orders")
def rewards(spark, d):
    body = F.when(F.col("o_orderkey") % 4 == 3, "no json").otherwise(F.concat(F.lit('{"label": "'), F.col("o_orderstatus"), F.lit('"}')))
    return table(spark, d, "orders").select("o_orderkey", training.reward(body, F.lit("O")).alias("reward"))


@query("""WITH s AS (SELECT user_id AS run, row_number() OVER w AS step, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), p AS (SELECT *, lag(value) OVER (PARTITION BY run ORDER BY step) AS pv, lag(step) OVER (PARTITION BY run ORDER BY step) AS ps FROM s)
 SELECT run, round(min(CASE WHEN pv IS NULL THEN step ELSE ps + (step - ps) * (500 - pv) / (value - pv) END), 6) AS crossing FROM p WHERE value >= 500 AND (pv IS NULL OR pv < 500) GROUP BY run""")
def first_crossings(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    history = table(spark, d, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("step"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("value"))
    return training.first_crossing(history, 500.0).select("run", F.round("crossing", 6).alias("crossing"))


_V = C._V


@query(f"""WITH {_V}, k AS (SELECT vec_id, unnest(range(4)) AS g, v FROM v), p AS (SELECT vec_id, g, list_slice(v, g * 16 + 1, g * 16 + 16) AS x FROM k), s AS (SELECT *, greatest(list_max(list_transform(x, lambda y: abs(y))) / 7.0::DOUBLE, 1e-12) AS scale FROM p)
 SELECT vec_id, round(sum(scale), 9) AS scales, sum(list_sum(list_transform(x, lambda y: round_even(y / scale, 0))))::BIGINT AS total FROM s GROUP BY vec_id""")
def int4_codes(spark, d):
    coded = vecs(spark, d).select(F.col("doc_id").alias("vec_id"), F.explode(ann.quantize_int4(F.col("v"), 16)).alias("g"))
    return coded.groupBy("vec_id").agg(F.round(F.sum("g.scale"), 9).alias("scales"), F.sum(F.aggregate("g.q", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total"))


@query(f"""WITH {_V}, i AS (SELECT unnest(range(4)) AS i), j AS (SELECT unnest(range(4)) AS j),
 m AS (SELECT qid, j, vec_id, max(1 - 2 * list_sum(list_transform(list_zip(list_slice(v, i * 16 + 1, i * 16 + 16), list_slice(q, j * 16 + 1, j * 16 + 16)), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) / 16.0::DOUBLE) AS m FROM v, q, i, j GROUP BY ALL),
 s AS (SELECT qid, vec_id AS doc_id, round(sum(m), 9) AS score FROM m GROUP BY ALL) SELECT qid, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def sign_maxsim(spark, d):
    tokens = vecs(spark, d).select("doc_id", F.explode(F.array(*[F.slice("v", i * 16 + 1, 16) for i in range(4)])).alias("v"))
    wanted = asked(spark, d).select("qid", F.posexplode(F.array(*[F.slice("q", i * 16 + 1, 16) for i in range(4)])).alias("pos", "q"))
    return ann.sign_maxsim(tokens, wanted, 16, 10).select("qid", "doc_id", "rank", "score")


@query(f"""{C._ARMS}, pre AS (SELECT a.qid, a.doc_id, a.score, row_number() OVER (PARTITION BY a.qid ORDER BY a.score DESC, a.doc_id) AS rank FROM a JOIN documents d ON d.doc_id = a.doc_id WHERE arm = 'bm25' AND lang = 'en'),
 post AS (SELECT a.qid, a.doc_id, a.score, row_number() OVER (PARTITION BY a.qid ORDER BY a.score DESC, a.doc_id) AS rank FROM a JOIN documents d ON d.doc_id = a.doc_id WHERE arm = 'bm25' AND a.rank <= 12 AND lang = 'en')
 SELECT 'pre' AS plan, qid, doc_id, rank, round(score, 6) AS score FROM pre WHERE rank <= 3 UNION ALL SELECT 'post', qid, doc_id, rank, round(score, 6) FROM post WHERE rank <= 3""")
def filtered_search(spark, d):
    hits, corpus = C.arms(spark, d)["bm25"], docs(spark, d).select("doc_id", "lang")
    both = [retrieval.filtered_search(hits, corpus, F.col("lang") == "en", 3, prefilter=p).select(F.lit(n).alias("plan"), "qid", "doc_id", "rank", F.round("score", 6).alias("score")) for p, n in ((True, "pre"), (False, "post"))]
    return both[0].unionByName(both[1])


@query(f"WITH {_V}, s AS (SELECT qid, vec_id AS doc_id, round(list_dot_product(list_slice(v, 1, 16), list_slice(q, 1, 16)) / sqrt(list_dot_product(list_slice(v, 1, 16), list_slice(v, 1, 16))) / sqrt(list_dot_product(list_slice(q, 1, 16), list_slice(q, 1, 16))), 9) AS score FROM v, q WHERE vec_id <> qid) SELECT qid, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def mrl_prefix_only(spark, d):
    from granary.operators import tiles

    return tiles.nearest(vecs(spark, d), asked(spark, d), 10, "cosine", 16, digits=9).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("SELECT item_id, 'CATEGORY: table' || chr(10) || '<chunk id=\"' || item_id || '#0\">' || chr(10) || text || chr(10) || '</chunk>' AS prompt FROM benchmark")
def question_prompts(spark, d):
    chunk = F.array(F.struct(F.concat(F.col("item_id"), F.lit("#0")).alias("id"), F.col("text").alias("text")))
    return table(spark, d, "benchmark").select("item_id", routing.build_prompt(F.lit("table"), chunk).alias("prompt"))
