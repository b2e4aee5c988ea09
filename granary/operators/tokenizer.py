"""Byte-pair tokenizers trained on word frequencies: training over all pre-tokens, encoding as an Arrow function.

Counting pre-tokens and their pairs of symbols is the distributed part; the driver holds a count for each pair of symbols, never the pre-tokens.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators.curate import _ensure_checkpoint

#: Ids that are given out together, and characters of a word whose ids are kept.
IDS, KNOWN_CHARS = 1_000_000, 64
_PATTERN = T.PRETOKEN_PATTERN.removeprefix("(?U)")


def train(docs: DataFrame, merges: int = 256) -> list[tuple[int, int]]:
    """Merges in order, from all pre-tokens; ties go to the smaller pair.

    A word is a string with a character for each symbol, so that a merge is a replacement. Only words that hold a merged pair are counted
    again. A round makes every merge that :func:`_certain` allows; words are cut from their lineage after some merges.
    """
    if merges > 0xD800 - 256:
        raise ValueError("too many merges for a character each")
    _ensure_checkpoint(docs.sparkSession)
    counts = docs.select(F.explode(T.pretokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    words = counts.select(F.decode(F.encode("token", "UTF-8"), "ISO-8859-1").alias("w"), "n").where(F.length("w") > 1).checkpoint()
    pairs: Counter[tuple[int, int]] = Counter()
    _add(pairs, words.select(F.explode(_pairs(F.col("w"))).alias("pair"), "n"))
    out: list[tuple[int, int]] = []
    pending = 0
    while len(out) < merges and (batch := _certain(pairs, merges - len(out))):
        old, new, held = F.col("w"), F.col("w"), F.lit(False)
        for pair in batch:
            text = "".join(map(chr, pair))
            held = held | F.contains(old, F.lit(text))
            new = F.replace(new, F.lit(text), F.lit(chr(256 + len(out))))
            out.append(pair)
        if len(out) == merges:
            break
        changed = words.where(held).select("w", new.alias("v"), "n")
        gone = changed.select(F.explode(_pairs(F.col("w"))).alias("pair"), (-F.col("n")).alias("n"))
        come = changed.select(F.explode(_pairs(F.col("v"))).alias("pair"), "n")
        _add(pairs, gone.unionByName(come))
        words, pending = words.select(new.alias("w"), "n").where(F.length("w") > 1), pending + len(batch)
        if pending >= 8:
            words, pending = words.checkpoint(), 0
    return out


def _pairs(word: Column) -> Column:
    """Neighbouring characters of a string of two or more; none of a shorter one."""
    chars = F.split(word, "")
    return F.filter(F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b)), lambda p: p.isNotNull())


def _add(pairs: Counter[tuple[int, int]], found: DataFrame) -> None:
    for row in found.groupBy("pair").agg(F.sum("n").alias("n")).where("n <> 0").collect():
        pair = (ord(row["pair"][0]), ord(row["pair"][1]))
        pairs[pair] += row["n"]
        if not pairs[pair]:
            del pairs[pair]


def _certain(pairs: Counter[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The next merge, and those after it whose place no earlier one of them can change.

    A merge of (a, b) changes the counts of pairs that end with a or begin with b only, and no new pair is more frequent than one of those.
    So pairs follow in order as long as they are more frequent than all that are changed so far.
    """
    order = sorted(pairs, key=lambda p: (-pairs[p], p))
    out, limit = [], 0
    for a, b in order[:most]:
        if out and pairs[a, b] <= limit:
            break
        out.append((a, b))
        limit = max([limit] + [n for p, n in pairs.items() if p[1] == a or p[0] == b])
    return out


def learn(words: dict[tuple[int, ...], int], merges: int) -> list[tuple[int, int]]:
    """Merges of weighted words. Only words that hold the merged pair are counted again."""
    texts, weights = [list(w) for w in words], list(words.values())
    pairs: Counter[tuple[int, int]] = Counter()
    holders: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, w in enumerate(texts):
        for p in zip(w, w[1:], strict=False):
            pairs[p] += weights[i]
            holders[p].add(i)
    heap = [(-n, p) for p, n in pairs.items()]
    heapq.heapify(heap)
    out: list[tuple[int, int]] = []
    while heap and len(out) < merges:
        n, pair = heapq.heappop(heap)
        if pairs.get(pair, 0) != -n or not n:
            continue
        made = 256 + len(out)
        out.append(pair)
        changed = set()
        for i in list(holders.pop(pair, ())):
            w = texts[i]
            for p in zip(w, w[1:], strict=False):
                pairs[p] -= weights[i]
                changed.add(p)
            w = texts[i] = merge(w, pair, made)
            for p in zip(w, w[1:], strict=False):
                pairs[p] += weights[i]
                holders[p].add(i)
                changed.add(p)
        for p in changed:
            if pairs[p] > 0:
                heapq.heappush(heap, (-pairs[p], p))
    return out


def merge(word: list[int], pair: tuple[int, int], made: int) -> list[int]:
    """Every occurrence of a pair, from the left, put together."""
    out, i = [], 0
    while i < len(word):
        if i + 1 < len(word) and (word[i], word[i + 1]) == pair:
            out.append(made)
            i += 2
        else:
            out.append(word[i])
            i += 1
    return out


class Tokenizer:
    """Merges with their encoder; ids below 256 are bytes."""

    def __init__(self, merges: list[tuple[int, int]]):
        import regex

        self.merges = [tuple(p) for p in merges]
        self.rank = {p: i for i, p in enumerate(self.merges)}
        self.bytes = [bytes([b]) for b in range(256)]
        for a, b in self.merges:
            self.bytes.append(self.bytes[a] + self.bytes[b])
        self.pattern, self.known = regex.compile(_PATTERN), {}

    def _word(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            found = list(word.encode())
            while len(found) > 1:
                best = min(zip(found, found[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
                if best not in self.rank:
                    break
                found = merge(found, best, 256 + self.rank[best])
            if len(word) > KNOWN_CHARS:
                return found
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [i for w in self.pattern.findall(text) for i in self._word(w)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8")

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"merges": self.merges}, f)

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            return cls([tuple(p) for p in json.load(f)["merges"]])


def encode(docs: DataFrame, merges: list[tuple[int, int]], key: str = "doc_id") -> DataFrame:
    """``key, ids, n_tokens, n_bytes`` of every text. Rows are given out as soon as they hold :data:`IDS` ids, so memory doesn't grow with the rows of a batch."""

    def run(batches):
        own = Tokenizer(merges)
        for batch in batches:
            ids, ends, sizes, at = array("i"), [0], [], 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                ids.extend(own.encode(text))
                ends.append(len(ids))
                sizes.append(len(text.encode()))
                if len(ids) >= IDS or i + 1 == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), lists, pa.array(np.diff(ends), pa.int64()), pa.array(sizes, pa.int64())], [key, "ids", "n_tokens", "n_bytes"])
                    ids, ends, sizes, at = array("i"), [0], [], i + 1

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>, n_tokens long, n_bytes long")


def efficiency(encoded: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Bytes per token and tokens per word."""
    words = docs.agg(F.sum(F.size(T.spaced_words(F.col("text")))).alias("words"))
    return encoded.agg(F.sum("n_bytes").alias("b"), F.sum("n_tokens").alias("t")).crossJoin(words).select((F.col("b") / F.col("t")).alias("bytes_per_token"), (F.col("t") / F.col("words")).alias("fertility"))


def neutral(text: str) -> str:
    """Special marks in a text broken by a zero-width space."""
    return re.sub(r"<\|", "<​|", text)
