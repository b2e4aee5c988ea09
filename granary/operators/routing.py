"""Requests on their way: tools, rewriting, prompts and reasons, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T

# Tools that each route may call.
ROUTE_TOOLS = {"in_domain": ["search_documents", "retrieve_image", "summarize_document", "calculate", "query_database"], "needs_web": ["search_documents", "search_web", "calculate"], "out_of_domain": []}


# Phrases of reasons for a refusal, and the codes that callers see.
REASONS = [
    ("out of domain", "out_of_domain"),
    ("no relevant evidence", "insufficient_evidence"),
    ("no sources to ground", "insufficient_evidence"),
    ("no generator", "generator_unavailable"),
    ("generator unavailable", "generator_unavailable"),
    ("budget exhausted", "budget_exhausted"),
    ("cap reached", "budget_exhausted"),
    ("unsupported claim", "unverified_answer"),
    ("citation-required", "uncited_answer"),
    ("rate limit", "rate_limited"),
    ("prompt injection", "blocked_input"),
    ("internal error", "internal_error"),
]


def authorize(calls: DataFrame) -> DataFrame:
    """``allowed`` and ``reason`` for ``calls(tool, provenance, route)``: asked for by user or agent, and on the route's list."""
    spark = calls.sparkSession
    lists = F.broadcast(spark.createDataFrame([(r, t) for r, ts in ROUTE_TOOLS.items() for t in ts], "route string, tool string").withColumn("listed", F.lit(True)))
    known = sorted({t for ts in ROUTE_TOOLS.values() for t in ts})
    joined = calls.join(lists, ["route", "tool"], "left")
    reason = F.when(~F.col("provenance").isin("user", "agent"), "provenance").when(~F.col("tool").isin(known), "unknown_tool").when(F.col("listed").isNull(), "route")
    return joined.withColumn("reason", reason).withColumn("allowed", reason.isNull()).drop("listed")


def plan_tools(query: Column) -> Column:
    """Tools that a query's words ask for: arithmetic and pictures."""
    arithmetic = F.regexp_extract(query, r"(\d[\d\s.]*(?:[-+*/%]\s*\d[\d\s.]*)+)", 1)
    return F.array_compact(F.array(F.when(arithmetic != "", F.concat(F.lit("calculate:"), F.trim(arithmetic))), F.when(F.lower(query).rlike(r"\b(figure|diagram|chart|image|photo|screenshot|plot)\b"), F.lit("retrieve_image"))))


def build_prompt(category: Column, chunks: Column) -> Column:
    """A prompt for a question of a category over chunks ``array<struct<id, text>>``, each in a tag with its id."""
    tagged = F.transform(chunks, lambda c: F.concat(F.lit('<chunk id="'), c["id"], F.lit('">\n'), c["text"], F.lit("\n</chunk>")))
    return F.concat(F.lit("CATEGORY: "), category, F.lit("\n"), F.array_join(tagged, "\n"))


def split_claims(answer: Column, most: int = 8, least_chars: int = 12) -> Column:
    """The sentences of an answer without its citations, those of at least ``least_chars`` characters, at most ``most``."""
    plain = F.regexp_replace(answer, r"\[\d{1,2}\]", " ")
    return F.slice(F.filter(F.transform(F.split(plain, r"(?U)(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least_chars), 1, most)


def rewrite(query: Column, context: Column, attempt: Column, longest: int = 300) -> Column:
    """A query without stop words; from the first retry on without its last word but with up to two new words of the context."""
    words = F.filter(F.split(T.normalize_query(query), " "), lambda w: ~w.isin(T.ANSWER_STOPWORDS))
    more = F.slice(F.array_except(F.filter(F.split(F.lower(context), r"\W+"), lambda w: F.length(w) > 4), words), 1, 2)
    changed = F.concat(F.slice(words, 1, F.greatest(F.lit(1), F.size(words) - 1)), more)
    return F.substring(F.array_join(F.when(attempt >= 1, changed).otherwise(words), " "), 1, longest)


def refusal_reason(reason: Column) -> Column:
    """A reason in a closed vocabulary: the code of the first phrase that it holds, ``refused`` without one, empty for an empty reason."""
    low, code = F.lower(reason), None
    for phrase, name in REASONS:
        code = F.when(low.contains(phrase), name) if code is None else code.when(low.contains(phrase), name)
    return code.otherwise(F.when(F.coalesce(reason, F.lit("")) == "", "").otherwise("refused"))


def first_json(text: Column, schema: str) -> Column:
    """The first JSON object in a text, or null."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)


def render_context(chunks: DataFrame) -> DataFrame:
    """Numbered, fenced context of ``chunks(qid, rank, doc_id, text)``: a row per query."""
    from granary.operators.guard import wrap_untrusted

    line = F.concat(F.lit("["), F.col("rank"), F.lit("] source_id="), F.col("doc_id"), F.lit("\n"), wrap_untrusted(F.col("text"), F.col("doc_id")))
    return chunks.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda r: r["l"]), "\n\n").alias("context"))


def stable_hash(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 32 bits, as a long."""
    hexed = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("(..)"), F.lit(1))
    return F.aggregate(hexed, F.lit(0x811C9DC5).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(F.conv(b, 16, 10).cast("long")) * F.lit(0x01000193).cast("long"), F.lit(1 << 32)))
