"""Token counts at every prefix of a text, by dynamic programming.

For each pre-token a table holds the exact token count of every one of its prefixes: the last token of a prefix
is the one vocabulary entry that ends there and is compatible with the last token of what stands before it, so a
count is the earlier count plus one. The counts of a text are the running sums of those tables. From them follow the whole
count, the longest prefix within a budget and the count of any truncation, without encoding again.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe as B
from .worker import enter, keeps

_CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")
#: Unicode's White_Space property.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class PrefixCounter:
    """Prefix tables over a :class:`granary.llm.bpe.ByteBPE`."""

    def __init__(self, vocabulary: B.ByteBPE):
        self.bpe = vocabulary
        self.tables: dict[str, tuple[int, ...] | bytes] = {}
        self.totals: dict[str, int] = {}

    def table(self, word: str) -> tuple[int, ...] | bytes:
        """Token counts of the prefixes of a pre-token, by UTF-8 bytes, 0 first."""
        found = self.tables.get(word)
        if found is None:
            counts = self.bpe.prefix_counts(word.encode())
            found = bytes(counts) if max(counts) < 256 else tuple(counts)  # a prefix may have more tokens than the whole
            if len(word) <= 64:
                if len(self.tables) >= B.CACHE_ENTRIES:
                    self.tables.clear()
                    self.totals.clear()
                self.tables[word] = found
                self.totals[word] = counts[-1]
        return found

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        total, known = 0, self.totals
        for part, special in B.split_special(text, self.bpe.specials):
            total += 1 if special is not None else sum([known.get(w) or self.table(w)[-1] for w in self.bpe.pieces(part)])
        return total

    def counts(self, text: str) -> list[int]:
        """``counts(text)[i]`` is the token count of ``text[:i]`` encoded on its own, for every i.

        A prefix may cut a pre-token so that what is left splits differently: white space before a word, and
        contractions, are counted as the prefix itself would be. A prefix that ends inside a special token is ordinary text.
        """
        out, before, start, plain, edge = [0], 0, 0, 0, 0
        for part, special in B.split_special(text, self.bpe.specials):
            if special is None:
                before = self._plain(part, before, out)
            else:
                # Cut off, the special token's head joins the plain text before it.
                out.extend(edge + self._fresh(text[plain : start + i]) for i in range(1, len(part)))
                before += 1
                out.append(before)
                plain, edge = start + len(part), before
            start += len(part)
        return out

    def _fresh(self, text: str) -> int:
        return sum(self.table(w)[-1] for w in self.bpe.pieces(text))

    def _plain(self, part: str, before: int, out: list[int]) -> int:
        """Append the counts of the prefixes of ``part``; return the count of the whole."""
        run, base = "", before  # white space so far, and the count before it: a prefix that ends in it is one pre-token there
        for word in self.bpe.pieces(part):
            table = self.table(word)
            if _CONTRACTION.fullmatch(word):
                out.extend(before + self._fresh(word[:i]) for i in range(1, len(word) + 1))
            elif not word.strip(_SPACES):
                run, base = run + word, base if run else before
                out.extend(base + self.table(run[:i])[-1] for i in range(len(run) - len(word) + 1, len(run) + 1))
                before += table[-1]
                continue
            else:
                at = 0
                for k, c in enumerate(word):
                    at += len(c.encode())
                    out.append(base + self.table(run + c)[-1] if run and k == 0 and c in _SPACES else before + table[at])
            before += table[-1]
            run = ""
        return before

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix with at most ``budget`` tokens such that every shorter prefix also fits."""
        counts = self.counts(text)
        peak, tops = 0, []
        for c in counts:
            peak = max(peak, c)
            tops.append(peak)
        return text[: max(0, bisect.bisect_right(tops, budget) - 1)]


_counters: dict[int, PrefixCounter] = {}


def forget() -> None:
    _counters.clear()
    B._loaded.cache_clear()


def counter(source: str) -> PrefixCounter:
    vocabulary = B.load(source)
    return _counters.setdefault(id(vocabulary), PrefixCounter(vocabulary))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", keep_prefix: bool = False) -> DataFrame:
    """Exact token count of every whole text.

    A row for each row of ``docs``: the id column, ``n_bytes`` long, ``n_tokens`` long, ``over_limit`` boolean (more than
    ``limit`` tokens) and, if ``keep_prefix``, ``prefix_counts`` array<int> (by code points) and ``within`` string (the
    longest prefix within the limit). A null or empty text has 0 tokens, repeated rows stay repeated, a null id stays null, an empty table gives no rows; texts and
    pre-tokens may be of any length. Only the two columns named are read, so others can't clash.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(B.read_vocabulary(tokenizer_path))

    def run(batches):
        enter("counts")
        own = counter(held.value)
        keeps("counts", forget)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [own.count(t) for t in texts]
            cols = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            names = [id_col, "n_bytes", "n_tokens", "over_limit"]
            if keep_prefix:
                cols += [pa.array([own.counts(t) for t in texts], pa.list_(pa.int32())), pa.array([own.truncate(t, limit) for t in texts], pa.string())]
                names += ["prefix_counts", "within"]
            yield pa.RecordBatch.from_arrays(cols, names)

    source = docs.select(id_col, docs[text_col].cast("string").alias("text"))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean" + ", prefix_counts array<int>, within string" * keep_prefix)
