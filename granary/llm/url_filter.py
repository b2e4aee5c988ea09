"""URL rules by host-suffix and path-prefix expressions.

Every URL is expanded into its host suffixes combined with those prefixes of its path whose lengths some
rule has. The expressions meet the rules in an equi-join on a short prefix of their SHA-256; a match must
then agree in the full digest. Among the confirmed rules of a URL the longest wins. URLs with the same host and
beginning of a path are expanded once; what was found goes back to them in a join that deals popular ones over several tasks.

Only built-in DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .deal import join_dealt

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are broadcast up to this many rows; beyond it the join shuffles both sides.
BROADCAST_RULES = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    no_query = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(no_query, r"(?s)^([^/]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(no_query, r"(?s)^[^/]*(.*)$", 1)
    return host, path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """``rules(action, host, path)`` applied to every row of ``pages``.

    Returns ``id_col, host, path, rule, verdict``, a row for each row of ``pages``; ``rule`` is host and path of
    the longest rule that fits (longest host and path together, then longest host, then ``block`` before
    ``allow``), else null, and ``verdict`` its action, else ``default``. A rule fits its host and every subdomain if
    the URL's path starts with the rule's. Null and malformed URLs have an empty host and path, and get the
    default (a rule with an empty host fits no URL). Other columns of ``pages`` are not read, so names cannot
    clash; repeated rows stay repeated; URLs of any length are looked at whole, but only as much of a path as the longest rule has is expanded; an empty table gives no rows.
    """
    rules = rules.select(F.col("action"), F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")).where("r_host <> ''").distinct()
    head = rules.agg(F.count("*"), F.sort_array(F.collect_set(F.length("r_path")))).first()
    count, lengths = head[0], head[1]  # at most as many lengths as the longest path has characters
    rules = rules.withColumn("digest", _digest(F.col("r_host"), F.col("r_path")))
    rules = rules.withColumn("short", F.substring("digest", 1, prefix_hex))
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    urls = urls.select("id", host.alias("host"), path.alias("path"))
    if not count:
        return urls.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    longest = max(lengths)
    urls = urls.withColumn("lead", F.substring("path", 1, max(longest, 1)))
    keys = urls.groupBy("host", "lead").agg(F.count("*").alias("urls"))  # null and malformed URLs are a key of their own, dealt like any other
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("lead")), lambda n: F.expr("lead").substr(F.lit(1), n))
    expanded = keys.where("host <> ''").withColumn("s", F.explode(suffixes)).withColumn("p", F.explode(prefixes)).where("s <> ''")
    expanded = expanded.withColumn("full", _digest(F.col("s"), F.col("p"))).withColumn("short", F.substring("full", 1, prefix_hex)).drop("s", "p")
    side = F.broadcast(rules) if count <= BROADCAST_RULES else rules
    hits = expanded.join(side, "short").where("full = digest")
    best = hits.groupBy("host", "lead").agg(
        F.max("urls").alias("urls"),
        F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("action") == "block").alias("b"), "r_host", "r_path", "action")).alias("best"),
    )
    joined = join_dealt(urls, best, ["host", "lead"], "urls", F.struct("id", "path"), "left", keys)
    return joined.select(F.col("id").alias(id_col), "host", "path", F.concat("best.r_host", "best.r_path").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


#: The fixed rules of the query: (action, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
