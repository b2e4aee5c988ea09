"""Scan for injected instructions: readings of a text as columns, and patterns weighed by family.

A pattern is tried on a reading only if the reading holds one of the words that every match of it must hold; looking for a word is many times
as fast. All of it is native but for the compatibility form of Unicode, which only texts beyond ASCII take.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T

# Characters of no width.
ZERO_WIDTH = [0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0xFEFF, 0x00AD]

# Cyrillic and Greek letters and the Latin ones they look like.
LOOKALIKES = {
    "\u0430": "a",
    "\u0435": "e",
    "\u043e": "o",
    "\u0440": "p",
    "\u0441": "c",
    "\u0445": "x",
    "\u0443": "y",
    "\u0456": "i",
    "\u04bb": "h",
    "\u03bf": "o",
    "\u03b1": "a",
    "\u03b5": "e",
    "\u0455": "s",
    "\u0501": "d",
    "\u043d": "h",
    "\u043a": "k",
    "\u043c": "m",
    "\u0442": "t",
    "\u0432": "b",
}

# Digits and signs that are read as letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

# Families of injected instructions: (family, pattern over a lower-case reading, weight). The words at the end are this module's
# own: every match of the pattern holds one of them.
INJECTION_PATTERNS = [
    ("instruction_override", r"ignor\w*\s*(?:all\s*|any\s*|the\s*)?(?:previous|prior|above|preceding|earlier|last)\s*(?:instruction|prompt|direction|rule|command|context|message)", 1.0, ["ignor"]),
    ("instruction_override", r"disregard\s*(?:all\s*|any\s*|the\s*|everything\s*)?(?:previous|prior|above|earlier|system|instruction|you)", 1.0, ["disregard"]),
    ("instruction_override", r"forget\s*(?:everything|all|what|your|previous|the\s*above)", 1.0, ["forget"]),
    ("instruction_override", r"(?:new|updated|revised|real|actual|true)\s*(?:instruction|system\s*prompt|directive|task)s?\s*[:\-]", 1.0, ["instruction", "prompt", "directive", "task"]),
    ("instruction_override", r"(?:override|bypass|ignore|disable|relax|lift)\s*(?:your|all|the|any|its|their|our|these|those)?\s*(?:instruction|rule|safety|guardrail|restriction|filter|polic)", 1.0, ["override", "bypass", "ignore", "disable", "relax", "lift"]),
    ("instruction_override", r"stop\s*(?:following|obeying)\s*(?:the\s*)?(?:previous|prior|user|system)", 1.0, ["following", "obeying"]),
    ("instruction_override", r"your\s*(?:real|actual|only|true)\s*(?:task|job|instruction|purpose)\s*is", 1.0, ["your"]),
    ("role_hijack", r"you\s*are\s*(?:now|actually|really)\s*(?:a|an|the|no\s*longer|in|[a-z]*(?:bot|gpt|ai|assistant)\b)", 1.0, ["now", "actually", "really"]),
    ("role_hijack", r"(?:without|no|free\s*of)\s*(?:any\s*)?(?:content\s*)?(?:restriction|limitation|guardrail|safety\s*filter)s?", 0.9, ["restriction", "limitation", "guardrail", "filter"]),
    ("role_hijack", r"(?:^|\n)\s*(?:system|assistant|developer|user)\s*:\s*", 0.9, ["system", "assistant", "developer", "user"]),
    ("role_hijack", r"<\|?\s*(?:im_start|im_end|system|endoftext|assistant|user)\s*\|?>", 1.0, ["<"]),
    ("role_hijack", r"\[/?inst\]|<<sys>>|###\s*(?:system|instruction|new\s*prompt)", 1.0, ["inst]", "<<sys>>", "###"]),
    ("role_hijack", r"you\s*must\s*(?:now\s*)?(?:obey|comply|follow|execute)\s*(?:this|these|the\s*following)", 1.0, ["must"]),
    ("role_hijack", r"(?:pretend|imagine)\s*(?:you\s*are|to\s*be)\s*(?:a|an|the)", 0.9, ["pretend", "imagine"]),
    ("role_hijack", r"enter\s*(?:developer|debug|maintenance|unrestricted)\s*mode", 1.0, ["mode"]),
    ("exfiltration", r"(?:reveal|print|repeat|output|show|disclose|dump|display|list)\s*(?:me\s*)?(?:your|the|all)\s*(?:system\s*prompt|initial\s*prompt|instruction|hidden\s*rule|configuration|api\s*key|secret|credential)", 1.0, ["prompt", "instruction", "rule", "configuration", "key", "secret", "credential"]),
    ("exfiltration", r"(?:send|post|upload|forward|transmit|exfiltrate|leak|report|deliver)\b[^.\n]{0,60}?(?:to\s*)?(?:https?://|www\.|[\w.+-]+@[\w-]+\.)", 1.0, ["http", "www.", "@"]),
    ("exfiltration", r"(?:api\s*key|access\s*token|password|secret\s*key|credential|private\s*key|env\s*var)[^.\n]{0,50}\b(?:send|includ|append|attach|encod|embed|disclos|reveal|print|output|in\s*the\s*url)", 1.0, ["key", "token", "password", "credential", "var"]),
    ("exfiltration", r"!\[[^\]]*\]\(\s*https?://[^)]*(?:\{|\$\{|%s|<)", 1.0, ["!["]),
    ("exfiltration", r"""(?:curl|wget|fetch|xhr|navigator\.sendbeacon)\s*[\(\"']?\s*https?://""", 1.0, ["http"]),
    ("exfiltration", r"(?:append|attach|add|embed)\s*(?:the\s*)?[\w\s]{0,30}?(?:conversation|context|history|chunk|document|text|answer|response)[^.\n]{0,40}url", 1.0, ["url"]),
    ("tool_coercion", r"\b(?:call|invoke|run|execute|use|trigger)\b[^.\n]{0,30}\b(?:search_web|search_documents|query_database|calculate|retrieve_image|summarize_document|tool|function)\b", 1.0, ["search_", "query_database", "calculate", "retrieve_image", "summarize_document", "tool", "function"]),
    ("tool_coercion", r'"(?:tool|function|tool_name|name)"\s*:\s*"', 0.9, ['"']),
    ("tool_coercion", r"<\s*/?\s*(?:tool_call|function_call|tool_use|action)\s*>", 1.0, ["<"]),
    ("tool_coercion", r"\b(?:drop|delete|truncate|alter|insert\s*into|update)\b\s*(?:table|from|database|\w+\s*set)", 1.0, ["drop", "delete", "truncate", "alter", "insert", "update"]),
    ("tool_coercion", r"select\s+.{0,40}\bfrom\s+(?:users|credentials|secrets|accounts|passwords)", 1.0, ["select"]),
    ("delimiter_escape", r"(?:end|close|terminate)\s*of\s*(?:the\s*)?(?:document|context|data|untrusted|input)", 1.0, ["document", "context", "data", "untrusted", "input"]),
    ("delimiter_escape", r"</?\s*(?:untrusted[_a-z]*|document|context|retrieved_data)\s*>", 1.0, ["<"]),
    ("delimiter_escape", r"""nonce\s*=\s*[\"']?[0-9a-f]{6,}""", 1.0, ["nonce"]),
    ("delimiter_escape", r"```\s*(?:end|/document|system|instructions)", 0.9, ["```"]),
    ("delimiter_escape", r"-{3,}\s*(?:end\s*of|system|new\s*instruction)", 0.9, ["---"]),
    ("refusal_suppression", r"(?:do\s*not|don'?t|never)\s*(?:refuse|decline|mention|cite|warn|apologi[sz]e|tell\s*the\s*user|reveal\s*that|say\s*anything)", 1.0, ["refuse", "decline", "mention", "cite", "warn", "apologi", "tell", "reveal", "say"]),
    ("refusal_suppression", r"without\s*(?:any\s*)?(?:citation|source|warning|disclaimer|explanation)", 0.7, ["without"]),
    ("refusal_suppression", r"(?:this|the)\s*(?:message|instruction)\s*is\s*(?:invisible|hidden|secret)", 1.0, ["invisible", "hidden", "secret"]),
    ("authority", r"(?:system\s*override|admin(?:istrator)?\s*(?:mode|command|override|notice)|developer\s*mode|god\s*mode|dan\s*mode|root\s*access|security\s*update\s*from)", 1.0, ["override", "admin", "mode", "root", "security"]),
    ("authority", r"(?:important|urgent|attention|notice|warning)\s*[:!][^.\n]{0,60}\b(?:ai|assistant|model|llm|agent|chatbot)\b", 0.9, ["important", "urgent", "attention", "notice", "warning"]),
    ("memory_implant", r"(?:remember|store|memori[sz]e|keep\s*in\s*mind|note)\b[^.\n]{0,60}(?:for\s*later|next\s*time|future|when\s*(?:the\s*)?user|whenever)", 1.0, ["later", "time", "future", "when"]),
    ("memory_implant", r"from\s*now\s*on|going\s*forward|in\s*all\s*(?:future|subsequent)\s*(?:response|answer|turn)", 1.0, ["now", "forward", "future", "subsequent"]),
    ("encoded", r"(?:base64|rot13|hex|url)\s*[- ]?\s*(?:decode|encoded|decoding)", 0.8, ["decod", "encod"]),
    ("encoded", r"decode\s*(?:the\s*)?following\s*(?:and|then)?\s*(?:execute|follow|obey|run)", 1.0, ["decode"]),
]
THRESHOLD = 0.85

Rule = tuple[str, str, float, list[str]]


def _plain(text: Column) -> Column:
    """Lower case, look-alikes as the letters they look like, nothing without width, blanks collapsed."""
    letters, others = "".join(LOOKALIKES), "".join(map(chr, ZERO_WIDTH))
    return F.replace(F.regexp_replace(F.lower(F.translate(text, letters + others, "".join(LOOKALIKES.values()))), "[ \t]+", " "), F.lit("ı"), F.lit("i"))


def _hidden(text: Column) -> Column:
    """What runs of Base64, ``\\xNN`` and ``%NN`` in a text stand for, joined by blanks; runs that aren't mostly printable UTF-8 are left out."""
    runs = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    padded = lambda x: F.rpad(x, (F.ceil(F.length(x) / 4) * 4).cast("int"), "=")
    told = F.transform(runs("[A-Za-z0-9+/]{16,}={0,2}"), lambda x: F.call_function("try_validate_utf8", F.try_to_binary(padded(x), F.lit("base64")).cast("string")))
    told = F.filter(told, lambda s: (F.length(s) > 0) & (F.length(F.regexp_replace(s, r"[\p{C}&&[^\s]]", "")) > 0.85 * F.length(s)))
    escaped = F.transform(runs(r"(?:\\x[0-9a-fA-F]{2}){4,}"), lambda x: F.decode(F.unhex(F.replace(x, F.lit("\\x"), F.lit(""))), "ISO-8859-1"))
    percent = F.transform(runs(r"(?:%[0-9a-fA-F]{2}){4,}"), lambda x: F.call_function("try_url_decode", x))
    return F.array_join(F.concat(told, escaped, percent), " ")


#: Stands between readings: no pattern reaches across it, and a reading begins on a line of its own.
_BETWEEN = "\0" * 64 + "])>.\n"


def readings(text: Column, raw: Column) -> tuple[Column, Column]:
    """The readings in which an instruction may hide, one after the other; and the one without white space. ``raw`` is the text before any normalisation."""
    base, hidden = _plain(text), _hidden(raw)
    several = [base, F.translate(base, "".join(LEET), "".join(LEET.values())), F.when(hidden != "", _plain(hidden)), T.rot13(base), F.reverse(base)]
    return F.concat_ws(_BETWEEN, *several), F.regexp_replace(base, r"(?U)\s+", "")


def _without_space(pattern: str) -> str:
    return re.sub(r"\\s[*+]?| ", "", pattern)


def _holds(text: Column, pattern: str, words: list[str]) -> Column:
    may = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    return may & text.rlike("(?sU)" + pattern)


def families(text: Column, rules: list[Rule], close: Column | None = None) -> dict[str, Column]:
    """For each family the greatest weight of its rules that match a text, 0.0 if none does; in ``close``, which has no white space, patterns are tried without theirs."""
    found: dict[str, list[Column]] = {}
    for family, pattern, weight, words in rules:
        hit = _holds(text, pattern, words)
        if close is not None:
            hit = hit | _holds(close, _without_space(pattern), words)
        found.setdefault(family, []).append(F.when(hit, F.lit(weight)).otherwise(F.lit(0.0)))
    return {f: F.greatest(*ws) if len(ws) > 1 else ws[0] for f, ws in found.items()}


def _compatible(docs: DataFrame, key: str) -> DataFrame:
    """``key, raw, text``: texts in Unicode's compatibility form, which ASCII is in already."""

    def run(batches):
        for batch in batches:
            texts = [unicodedata.normalize("NFKC", t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [key, "raw", "text"])

    rows = docs.select(key, F.coalesce("text", F.lit("")).alias("raw"))
    odd = F.col("raw").rlike(r"[^\x00-\x7F]")
    kind = docs.schema[key].dataType.simpleString()
    return rows.where(~odd).withColumn("text", F.col("raw")).unionByName(rows.where(odd).mapInArrow(run, f"`{key}` {kind}, raw string, text string"))


def scan(docs: DataFrame, key: str = "doc_id", rules: list[Rule] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``key, score, flagged, family``: the greatest weight of each family over all readings, summed up to 1; the family that weighs most.

    Whole texts are read, in all readings, however long. A null text counts as empty; repeated rows stay repeated.
    """
    rules = rules or INJECTION_PATTERNS
    made = _compatible(docs, key)
    several, close = readings(F.col("text"), F.col("raw"))
    weighed = families(F.col("_several"), rules, F.col("_close"))
    made = made.select(key, several.alias("_several"), close.alias("_close")).select(key, *[c.alias(f"w_{f}") for f, c in weighed.items()])
    score = F.least(F.lit(1.0), reduce(lambda a, b: a + b, [F.col(f"w_{f}") for f in weighed]))
    top = F.greatest(*[F.struct(F.col(f"w_{f}").alias("w"), F.lit(f).alias("f")) for f in weighed])
    return made.select(key, score.alias("score"), (score >= threshold).alias("flagged"), F.when(score > 0, top["f"]).alias("family"))


def scan_plain(docs: DataFrame, key: str = "doc_id", rules: list[Rule] | None = None) -> DataFrame:
    """``key, family, weight`` of the families found in the text in lower case alone, its other readings left out."""
    rules = rules or INJECTION_PATTERNS
    low = docs.select(key, F.lower(F.coalesce("text", F.lit(""))).alias("_plain"))
    weighed = families(F.col("_plain"), rules)
    rows = low.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("family"), c.alias("weight")) for f, c in weighed.items()])).alias("r"))
    return rows.select(key, "r.family", "r.weight").where("weight > 0")


def layered(verdicts: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Several classifiers' ``key, score, flagged`` as one: flagged if any flags, the greatest score. One that says nothing about a row abstains."""
    every = reduce(lambda a, b: a.unionByName(b), [v.select(key, "score", "flagged") for v in verdicts])
    return every.groupBy(key).agg(F.max("score").alias("score"), F.bool_or("flagged").alias("flagged"))


def evaluate(verdicts: DataFrame, cases: DataFrame) -> DataFrame:
    """How a classifier does on ``cases(id, family, label)`` (attack or benign) given ``verdicts(id, flagged)``, by family and over all.

    ``family, attacks, blocked, benign, false_alarms, missed`` (ids of attacks that passed); over all: family is null.
    """
    joined = cases.join(verdicts.select("id", "flagged"), "id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False))).withColumn("attack", F.col("label") == "attack")
    out = joined.rollup("family").agg(F.count_if("attack").alias("attacks"), F.count_if(F.col("attack") & F.col("flagged")).alias("blocked"), F.count_if(~F.col("attack")).alias("benign"), F.count_if(~F.col("attack") & F.col("flagged")).alias("false_alarms"), F.sort_array(F.collect_list(F.when(F.col("attack") & ~F.col("flagged"), F.col("id")))).alias("missed"))
    return out
