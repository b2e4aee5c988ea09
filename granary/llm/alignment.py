"""Alignment of two tokenizers' tokens over the same bytes.

Both encodings of a text become one label string, a label for each byte: no token ends here, one of A ends, one of B ends, or both do. A regular
expression scans it for spans up to each byte where both end; the labels of a span count the tokens of a group, and every label is the end of one
link, as two tokens overlap up to where the first of them ends. So groups and links need no walk over pairs of tokens.

How often an id of A is linked with one of B in the whole corpus is counted per document, per batch and by Spark, in this order. The most frequent pairs
(a bounded number) are looked up in the tasks that hold the documents; only the others meet their counts in a join, and none of those
is frequent.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, scratch
from .worker import enter, keeps, tidy

#: Pairs whose counts every task gets, at most.
FREQUENT_PAIRS = 1 << 18
#: Texts longer than this are given to the libraries in stretches that no token joins; a longer run without a break goes to the backtracking encoder.
STRETCH, UNBROKEN = 1 << 16, 1 << 11
#: Labels of a byte.
A_END, B_END, BOTH = 1, 2, 3
_SPAN = re.compile(rb"[\x01\x02]*\x03")
#: Where B breaks whatever stands around it, given that no piece goes on from another character to a space.
_CUT_B = re.compile(r"(?<=[^ ])(?= [^ ])")
#: Where A always breaks.
_CUT_A = re.compile(r"(?<=\S)(?= )")
# Fixed value: the pattern of byte-level pre-tokens.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _SpanCounts(dict):
    """How many tokens of A and of B a span of labels has, as one number, A's times 2 ** 32."""

    def __missing__(self, span: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        both = span.count(BOTH)
        self[span] = found = (span.count(A_END) + both << 32) + span.count(B_END) + both
        return found


def labels_of(sizes_a: np.ndarray, sizes_b: np.ndarray) -> bytes:
    """The label string of two encodings of as many bytes, given their tokens' lengths."""
    out = np.zeros(int(sizes_a.sum()), np.uint8)
    out[np.cumsum(sizes_a) - 1] |= A_END
    out[np.cumsum(sizes_b) - 1] |= B_END
    return out.tobytes()


def stretches(text: str, cut: re.Pattern) -> list[str]:
    """A text in parts of at least :data:`STRETCH` characters, the last one perhaps shorter, that begin where ``cut`` fits."""
    if len(text) <= STRETCH:
        return [text]
    borders = [0]
    for m in cut.finditer(text):
        if m.start() - borders[-1] >= STRETCH:
            borders.append(m.start())
    return [text[at:end] for at, end in zip(borders, [*borders[1:], len(text)], strict=True)]


class Aligner:
    """Two vocabularies: byte-level BPE (A) and pieces with byte fallback (B)."""

    def __init__(self, source_a: str, model_b: bytes):
        import sentencepiece
        import tiktoken

        self.a = bpe.load(source_a)
        ids = self.a.id_of[256:]
        #: A library for the same vocabulary, where its order of merges is that of ids.
        self.fast = None
        if min(self.a.id_of) >= 0 and all(x < y for x, y in zip(ids, ids[1:], strict=False)) and max(self.a.id_of[:256]) < min(ids, default=256):
            raw = {self.a.blob[self.a.offsets[i] : self.a.offsets[i + 1]].tobytes(): i for i in self.a.id_of}
            self.fast = tiktoken.Encoding("alignment", pat_str=_PRE_TOKENS, mergeable_ranks=raw, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        raw = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.raw_b = raw
        self.can_cut = not any(re.search("[^▁]▁", p) for p in pieces)
        self.size_b = len(pieces)
        digits = [str(i) for i in range(max(len(self.a.offsets) - 1, self.size_b))]
        self.written = [d + mark for mark in (",", "|", ";") for d in digits]
        self.digits = len(digits)
        self.spans = _SpanCounts()

    def encode_a(self, text: str) -> np.ndarray:
        """Ids of A, the strings of special tokens taken as plain text."""
        own, out = self.a, []
        for part in stretches(text, _CUT_A):
            if self.fast is not None and max(map(len, part.split(" "))) <= UNBROKEN and " " * UNBROKEN not in part:
                out.append(np.array(self.fast.encode_ordinary(part), np.int64))
            else:
                out.append(np.frombuffer(b"".join([own.words.get(w) or own._ids(w) for w in own.pieces(part)]), "<u4").astype(np.int64))
        return np.concatenate(out)

    def encode_b(self, text: str) -> np.ndarray:
        """Ids of B, which puts a space before the text itself."""
        parts = stretches(text, _CUT_B) if self.can_cut else [text]
        return np.concatenate([np.array(self.b.encode(x[i > 0 :], out_type=int), np.int64) for i, x in enumerate(parts)])  # B adds the space at a part's head itself

    def align(self, text: str | None) -> dict[str, np.ndarray] | None:
        """Ids of a text, how many tokens each group has, and the ids that each link holds; None if it has no tokens."""
        if not text:
            return None
        raw = b" " + text.encode()
        a, b = self.encode_a(" " + text), self.encode_b(text)
        sizes_a = self.a.offsets[a + 1] - self.a.offsets[a]
        sizes_b = self.b_offsets[b + 1] - self.b_offsets[b]
        if not len(b) or int(sizes_a.sum()) != len(raw) or int(sizes_b.sum()) != len(raw):
            return None
        if b"".join(map(self.raw_b.__getitem__, b.tolist())) != raw:  # A's vocabulary has every byte and gives back any text
            return None
        marks = labels_of(sizes_a, sizes_b).translate(None, b"\x00")  # a byte where nothing ends counts for nothing
        found = _SPAN.findall(marks)
        counts = np.fromiter(map(self.spans.__getitem__, found), np.int64, len(found))
        groups = np.stack([counts >> 32, counts & 0xFFFFFFFF], axis=1)
        label = np.frombuffer(marks, np.uint8)
        ends_a, ends_b = (label & 1).astype(np.int64), (label >> 1).astype(np.int64)
        return {"a": a, "b": b, "groups": groups, "link_a": a[np.cumsum(ends_a) - ends_a], "link_b": b[np.cumsum(ends_b) - ends_b]}

    def render(self, found: dict[str, np.ndarray]) -> str:
        """Groups as ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b = found["groups"][:, 0], found["groups"][:, 1]
        before = np.concatenate([[0], np.cumsum(n_a + n_b)])
        out = np.zeros(int(before[-1]), np.int64)
        out[np.arange(len(found["a"])) + np.repeat(before[:-1] - (np.cumsum(n_a) - n_a), n_a)] = found["a"]
        out[np.arange(len(found["b"])) + np.repeat(before[:-1] + n_a - (np.cumsum(n_b) - n_b), n_b)] = found["b"]
        out[before[:-1] + n_a - 1] += self.digits
        out[before[1:] - 1] += 2 * self.digits
        return "".join(map(self.written.__getitem__, out.tolist()))[:-1]


@functools.lru_cache(maxsize=2)
def _loaded(digest: str, source_a: str, model_b: bytes) -> Aligner:
    return Aligner(source_a, model_b)


def load(source_a: str, model_b: bytes) -> Aligner:
    """One pair of vocabularies per worker process."""
    return _loaded(hashlib.sha256(source_a.encode() + model_b).hexdigest(), source_a, model_b)


_DOCS = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs binary, times binary"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a binary column of 64-bit integers, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.int64), np.array([len(r) // 8 for r in rows], np.int64)


def align_documents(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, keep_groups: bool = False, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """Align A's tokens of a space and the text with B's tokens of the text, for every whole text of ``docs(doc_id, text)``.

    A is a byte-level BPE file (tokenizers), B a sentencepiece model that adds a space. Returns a row for each row, repeated ones and ones with a null
    ``doc_id`` too: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, with ``keep_groups``, ``groups`` as decimal ids. Groups lie between bytes
    where tokens of both end; links are overlapping tokens; a pair's count is the number of links of all documents that hold its two ids;
    ``n_best`` counts a document's links whose count is the greatest of their B id, ties included; ``count_sum`` adds up its links' counts. Null and empty texts, and those whose bytes one of the two
    doesn't give back, have no tokens: zeros and an empty digest. Texts of any length are taken whole, an empty table gives no rows, other columns aren't read.
    """
    spark = docs.sparkSession
    with open(tokenizer_b, "rb") as f:
        held = spark.sparkContext.broadcast((bpe.read_vocabulary(tokenizer_a), f.read()))

    def encode(batches):
        enter("alignment")
        own = load(*held.value)
        keeps("alignment", _loaded.cache_clear)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(2):
                found = own.align(text.as_py())
                if found is None:
                    out.append((0, 0, 0, 0, "", "", b"", b""))
                    continue
                pairs, times = np.unique(found["link_a"] * own.size_b + found["link_b"], return_counts=True)
                written = own.render(found)
                out.append((len(found["a"]), len(found["b"]), len(found["groups"]), len(found["link_a"]), hashlib.sha256(written.encode()).hexdigest(), written if keep_groups else "", pairs.tobytes(), times.astype(np.int64).tobytes()))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.binary()] * 2
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"])
        tidy()

    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = scratch.materialize(source.mapInArrow(encode, _DOCS), "aligned")

    def count(batches):
        pairs, times, waiting = [], [], 0

        def merged():
            values, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
            return values, np.bincount(inverse, np.concatenate(times), len(values)).astype(np.int64)  # exact up to 2 ** 53 links a task

        def row(values, total):
            return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(total, pa.int64())], ["pair", "n"])

        for batch in batches:
            found, _ = _flat(batch.column(0))
            pairs.append(found)
            times.append(_flat(batch.column(1))[0])
            waiting += len(found)
            if waiting > 1 << 22:
                values, total = merged()
                pairs, times, waiting = [values], [total], 0
                if len(values) > 1 << 21:
                    yield row(values, total)
                    pairs, times = [], []
        if pairs:
            yield row(*merged())
        tidy()

    size_b = load(*held.value).size_b
    counts = scratch.materialize(every.select("pairs", "times").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    # One row for each id of B: bounded by its vocabulary.
    best = counts.groupBy(F.pmod("pair", F.lit(size_b)).alias("b")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("b", F.pmod("pair", F.lit(size_b))).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    # The least count that no more than ``frequent`` pairs reach, by classes of counts an eighth of an octave wide.
    classes = counts.groupBy(F.floor(8 * F.log2("n")).alias("k")).agg(F.count("*").alias("m"), F.min("n").alias("from")).orderBy(F.desc("k")).collect()  # at most 512
    least, room = None, frequent
    for c in classes:
        room -= c["m"]
        if room < 0:
            break
        least = c["from"]
    some = counts.where(F.col("n") >= least).orderBy("pair").collect() if least is not None else []  # at most ``frequent``
    known = spark.sparkContext.broadcast((np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.int64), np.array([r[2] for r in some], np.int64)))
    del some

    def looked_up(batch):
        """Of a batch's pairs: the document's place, how often, whether it is a known one, and where."""
        pairs, sizes = _flat(batch.column(1))
        times = _flat(batch.column(2))[0]
        values = known.value[0]
        at = np.minimum(np.searchsorted(values, pairs), max(len(values) - 1, 0))
        hit = values[at] == pairs if len(values) else np.zeros(len(pairs), bool)
        return pairs, np.repeat(np.arange(len(sizes)), sizes), times, hit, at

    def settled(batches):
        for batch in batches:
            _, doc, times, hit, at = looked_up(batch)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], doc[hit], times[hit] * known.value[2][at[hit]])
            np.add.at(sums[1], doc[hit], times[hit] * known.value[1][at[hit]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1])], ["uid", "n_best", "count_sum"])

    def others(batches):
        for batch in batches:
            pairs, doc, times, hit, _ = looked_up(batch)
            rare = ~hit
            uid = batch.column(0).to_numpy()[doc[rare]]
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(pairs[rare]), pa.array(times[rare])], ["uid", "pair", "times"])

    links = every.where("n_links > 0").select("uid", "pairs", "times")
    rare = links.mapInArrow(others, "uid long, pair long, times long").join(counts, "pair")
    rare = rare.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = links.mapInArrow(settled, "uid long, n_best long, count_sum long").unionByName(rare).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = every.drop("pairs", "times").join(sums, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *["groups"] * keep_groups)
