"""Chunks of documents, and blocks, tables and figures of Markdown texts."""

from __future__ import annotations

import bisect
import functools
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import text as T

#: Characters of chunks that leave a task at once, and texts made into vectors at once.
OUT_CHARS, VECTOR_ROWS = 1 << 21, 256

_WORD = re.compile(r"\S+")
_BORDER = re.compile(r"(?<=[.!?])\s+|\n\s*\n")


def fixed(docs: DataFrame, size: int = 512, overlap: int = 0) -> DataFrame:
    """Windows of ``size`` words with a stride of ``size - overlap``, until one reaches the end.

    ``doc_id, idx, chunk_id, size_tokens, overlap_tokens, text``; the text keeps the words, joined by single blanks.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")
    stride = size - overlap
    words = docs.select("doc_id", T.spaced_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / stride)).cast("int")
    # Windows are cut before they are exploded, so that none carries all words of its text; the outer form keeps Spark from cutting them twice.
    rows = words.select("doc_id", F.posexplode_outer(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i * stride + 1, size))).alias("idx", "part"))
    part, start = F.col("part"), F.col("idx") * stride
    return rows.select("doc_id", "idx", F.concat_ws("#", "doc_id", "idx").alias("chunk_id"), F.size(part).alias("size_tokens"), F.least(F.lit(overlap), start).alias("overlap_tokens"), F.array_join(part, " ").alias("text"))


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    spans, at = [], 0
    for m in [*_BORDER.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            spans.append((at, end))
        at = m.end() if m else end
    return spans


def _recursive(text: str, size: int, overlap: int, least: float) -> list[tuple[int, int, int, int]]:
    spans = word_spans(text)
    starts = [a for a, _ in spans]
    borders = sorted({bisect.bisect_left(starts, m.end()) for m in _BORDER.finditer(text)} - {0})
    out, i, n = [], 0, len(spans)
    shortest = max(1, int(size * least))
    while i < n:
        hard = min(i + size, n)
        k = bisect.bisect_right(borders, hard) - 1
        end = borders[k] if k >= 0 and borders[k] >= i + shortest else hard
        out.append((spans[i][0], spans[end - 1][1], end - i, min(overlap, i)))
        if end >= n:
            break
        i = max(end - overlap, i + 1)
    return out


@functools.lru_cache(1 << 17)
def _place(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=4).digest(), "little")


def _vectors(sentences: list[str], dim: int = 64) -> np.ndarray:
    """Hashed unigrams and bigrams, normalised: a stand-in for a sentence encoder."""
    out = np.zeros((len(sentences), dim))
    for row, s in zip(out, sentences, strict=True):
        tokens = re.findall(r"[a-z0-9]+", s.lower())
        for t in [*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False))]:
            row[_place(t) % dim] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _semantic(text: str, limit: int, z: float) -> list[tuple[int, int, int, int]]:
    spans = sentence_spans(text)
    if not spans:
        return []
    parts = [text[a:b] for a, b in spans]
    v = _vectors(parts)
    gap = 1 - (v[:-1] * v[1:]).sum(1)
    cut = gap.mean() + z * gap.std() if len(gap) else 1.0
    sizes = [len(p.split()) for p in parts]
    groups, now, words = [], [], 0
    for i in range(len(parts)):
        if now and (gap[i - 1] > cut or words + sizes[i] > limit):
            groups.append(now)
            now, words = [], 0
        now.append(i)
        words += sizes[i]
    groups.append(now)
    return [(spans[g[0]][0], spans[g[-1]][1], sum(sizes[i] for i in g), 0) for g in groups]


_CHUNK = "doc_id long, idx int, chunk_id string, start int, end int, size_tokens int, overlap_tokens int, text string"


def _spanned(docs: DataFrame, cut) -> DataFrame:
    names = [c.split()[0] for c in _CHUNK.split(", ")]

    def run(frames):
        for frame in frames:
            rows, chars = [], 0
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                for i, (a, b, n, o) in enumerate(cut(text or "")):
                    rows.append((doc, i, f"{doc}#{i}", a, b, n, o, text[a:b]))
                    chars += b - a
                    if chars > OUT_CHARS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, chars = [], 0
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", "text").mapInPandas(run, _CHUNK)


def recursive(docs: DataFrame, size: int = 512, overlap: int = 0, least: float = 0.5) -> DataFrame:
    """Windows whose end moves back to the last sentence or paragraph border in their second half."""
    return _spanned(docs, lambda text: _recursive(text, size, overlap, least))


def semantic(docs: DataFrame, max_size: int = 512, z: float = 1.0) -> DataFrame:
    """Sentences cut where neighbours differ by more than the mean plus ``z`` deviations, and at ``max_size`` words."""
    return _spanned(docs, lambda text: _semantic(text, max_size, z))


def contextual(docs: DataFrame, size: int = 512, overlap: int = 0) -> DataFrame:
    """Recursive chunks with the document's opening sentences as ``context`` and both as ``full_text``."""
    opening = docs.select("doc_id", F.concat(F.lit("This passage is from a document that begins: "), T.summary(F.col("text"))).alias("context"))
    chunks = recursive(docs, size, overlap).join(opening, "doc_id")
    return chunks.withColumn("full_text", F.when(F.col("context") != "", F.concat_ws("\n\n", "context", "text")).otherwise(F.col("text")))


def late(docs: DataFrame, size: int = 512, overlap: int = 0, weight: float = 0.3, dim: int = 64) -> DataFrame:
    """Fixed chunks whose vector is blended with their document's: ``vector`` array<double>."""
    chunks = fixed(docs, size, overlap)

    def whole(frames):
        for frame in frames:
            for at in range(0, len(frame), VECTOR_ROWS):
                part = frame[at : at + VECTOR_ROWS]
                yield pd.DataFrame({"doc_id": part["doc_id"], "whole": list(_vectors(list(part["text"]), dim))})

    def run(frames):
        for frame in frames:
            mixed = weight * np.stack(frame["whole"].to_list()) + (1 - weight) * _vectors(list(frame["text"]), dim) if len(frame) else np.zeros((0, dim))
            mixed /= np.maximum(np.linalg.norm(mixed, axis=1, keepdims=True), 1e-12)
            yield frame.drop(columns="whole").assign(vector=list(mixed))

    # A document's vector travels to its chunks, not its text: a long one has many.
    named = docs.where("text is not null").select("doc_id", "text")
    joined = chunks.join(named.mapInPandas(whole, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, whole array<double>"), "doc_id")
    return joined.select(*chunks.columns, "whole").mapInPandas(run, chunks.schema.simpleString()[7:-1].replace(":", " ") + ", vector array<double>")


def chunk(docs: DataFrame, strategy: str, size: int = 512, overlap: int = 0) -> DataFrame:
    """Chunks by the name of a strategy."""
    if strategy == "semantic":
        return semantic(docs, size)
    return {"fixed": fixed, "recursive": recursive, "late": late, "contextual": contextual}[strategy](docs, size, overlap)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n"), F.avg("size_tokens").alias("mean_size"), F.min("size_tokens").alias("min_size"), F.max("size_tokens").alias("max_size"), F.avg("overlap_tokens").alias("mean_overlap"))


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of a Markdown text in order: ``doc_id, ord, kind, content``; kind is heading, table, figure or paragraph.

    Blank lines part blocks; what follows a heading line in its block is a paragraph of its own.
    """
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"(?U)\n\s*\n")).alias("b", "body")).withColumn("body", F.trim("body")).where("body <> ''")
    heading = F.col("body").rlike(r"^#{1,6}\s+\S")
    first, rest = F.substring_index("body", "\n", 1), F.trim(F.expr("substring(body, length(substring_index(body, '\n', 1)) + 2)"))
    pieces = F.when(heading & (rest != ""), F.array(first, rest)).otherwise(F.array("body"))
    rows = parts.select("doc_id", "b", F.posexplode(pieces).alias("p", "content"))
    lines = F.split("content", "\n")
    table = (F.size(lines) >= 2) & F.element_at(lines, 1).contains("|") & F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
    kind = F.when(F.col("content").rlike(r"^#{1,6}\s+\S"), "heading").when(F.col("content").rlike(r"^!\[[^\]]*\]\([^)]*\)"), "figure").when(table, "table").otherwise("paragraph")
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("b", "p")).alias("ord"), kind.alias("kind"), "content")


def tables(found: DataFrame) -> DataFrame:
    """Cells of the tables among blocks: ``doc_id, table_id, row, col, value``; row 0 holds the headers."""
    only = found.where("kind = 'table'").withColumn("t", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1)
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = only.select("doc_id", F.concat(F.col("doc_id"), F.lit("#table"), F.col("t")).alias("table_id"), F.posexplode(lines).alias("line", "body")).where("line <> 1")
    return rows.select("doc_id", "table_id", F.when(F.col("line") == 0, 0).otherwise(F.col("line") - 1).alias("row"), F.posexplode(T.split_table_row(F.col("body"))).alias("col", "value"))


def figures(found: DataFrame) -> DataFrame:
    """Figures among blocks with their caption: the alternative text, or a stand-in."""
    only = found.where("kind = 'figure'").withColumn("f", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1)
    alt = F.regexp_extract("content", r"^!\[([^\]]*)\]", 1)
    return only.select("doc_id", F.concat(F.col("doc_id"), F.lit("#fig"), F.col("f")).alias("figure_id"), F.regexp_extract("content", r"\(([^)\s]*)", 1).alias("path"), F.when(alt != "", alt).otherwise(F.concat(F.lit("Figure "), F.col("f") + 1)).alias("caption"))


def table_markdown(cells: DataFrame) -> DataFrame:
    """Tables rendered again, short rows padded and long ones cut to the header's width."""
    width = cells.where("row = 0").groupBy("table_id").agg((F.max("col") + 1).alias("width"))
    kept = cells.join(width, "table_id").where("col < width")
    rows = kept.groupBy("table_id", "row", "width").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("c"))
    padded = F.concat(F.col("c.value"), F.array_repeat(F.lit(""), F.col("width") - F.size("c")))
    line = F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), F.col("width")), "|"), F.lit("|"))
    text = rows.select("table_id", "row", F.when(F.col("row") == 0, F.concat_ws("\n", line, rule)).otherwise(line).alias("line"))
    return text.groupBy("table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n").alias("markdown"))
