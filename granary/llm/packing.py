"""Sum-of-squares packing of token sequences.

Open bins are counted by residual gap. A piece goes where the sum of the squared counts becomes smallest: into an open bin
of some gap or into a new bin. Only the 2,047 counts are looked at, never the bins
themselves, so a placement costs the same however many bins are open.

Every task packs the pieces it has just tokenized, without a shuffle. What then stands in bins that are
not nearly full is packed once more in groups from all tasks, without weighing new bins; only that remainder is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .bpe import PLAIN_CHARS, read_vocabulary
from .worker import enter, keeps

#: Words of a worker's table, about 200 bytes each.
WORD_ENTRIES = 800_000
#: Text, about, that is looked up at once.
CHUNK_BYTES = 16 << 20


def _class(chars: list[str]) -> str:
    """A character class of a regular expression for some characters."""
    codes = sorted(map(ord, chars))
    return "[^" + "".join(f"\\x{{{c:x}}}" for c in codes) + "]"


def _lower_safe() -> list[str]:
    """Characters that stay apart from their neighbours, and whose lower case and white space Arrow knows as Python does."""
    some = sorted(c for c in PLAIN_CHARS if unicodedata.is_normalized("NFC", c) and c != "Σ" and len(c.lower()) == 1 and c.lower() in PLAIN_CHARS)
    lower = pc.utf8_lower(pa.array(some)).to_pylist()
    parts = pc.list_value_length(pc.utf8_split_whitespace(pa.array([f"a{c}a" for c in some]))).to_pylist()
    return [c for c, x, n in zip(some, lower, parts, strict=True) if x == c.lower() and (n == 2) == c.isspace()]


def _gathered(first: np.ndarray, flat: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The lists ``which``, one after the other; list i is ``flat[first[i]:first[i + 1]]``."""
    lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.uint32()))
    return lists.take(pa.array(which)).values.to_numpy()


class WordTokenizer:
    """Ids of whole texts as the tokenizers library gives them, with a bounded table of words met before.

    For vocabularies whose pre-tokens are those of ``PATTERN`` after lower-casing and whose words end in a token of their own
    kind. Such a pre-token holds no white space, so a run of characters between white space gets the same ids wherever it
    stands. The runs of many texts are numbered at once, distinct ones are cut into words, and words that are not in the table are encoded
    by the library. A text with a character outside the safe set, or with a special token's string, is encoded by the library as a whole.
    """

    PATTERN = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+|\n")
    UNSAFE = _class(_lower_safe())

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The same model for words that stand between blanks, without normalizing or splitting again.
        spec = json.loads(source)
        spec["normalizer"], spec["post_processor"] = None, None
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.plain = Tokenizer.from_str(json.dumps(spec))
        self.plain.no_truncation()
        self.plain.no_padding()
        suffix = spec["model"]["end_of_word_suffix"]
        vocabulary = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        """Empty the table; entry 0 is the line feed that parts two runs and has no ids."""
        self.known = {"\n": 0}
        self.first, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Put words into the table, encoded by the library's model, many at once."""
        found = []
        for at in range(0, len(words), 500):  # short enough for the library's buffers to stay in the cache
            found += self.plain.encode_batch_fast([" ".join(words[at : at + 500])], add_special_tokens=False)[0].ids
        ids = np.array(found, np.uint32)
        edges = np.flatnonzero(self.ends[ids]) + 1
        if len(edges) != len(words):
            raise ValueError(f"{len(edges)} word ends for {len(words)} words")
        have, count = len(self.known), int(self.first[len(self.known)])
        for name, need in (("first", have + len(words) + 1), ("flat", count + len(ids))):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need - len(held), len(held)), held.dtype)]))
        self.flat[count : count + len(ids)] = ids
        self.first[have + 1 : have + len(words) + 1] = count + edges
        self.known.update(zip(words, range(have, have + len(words)), strict=True))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Places of words in the table; those that it lacks are put in."""
        found = list(map(self.known.get, pieces))
        gaps = [i for i, n in enumerate(found) if n is None]
        if gaps:
            new = list(dict.fromkeys([pieces[i] for i in gaps]))
            if len(self.known) + len(new) > WORD_ENTRIES and len(self.known) > 1:
                self.forget()
                return self._numbers(pieces)
            self._learn(new)
            for i in gaps:
                found[i] = self.known[pieces[i]]
        return np.array(found, np.int64)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of safe texts one after the other, and the number of each."""
        split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        runs = split.flatten().dictionary_encode()
        if not len(runs):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        words = self._numbers(self.PATTERN.findall("\n".join(runs.dictionary.to_pylist()) + "\n"))
        # Ids of each distinct run, then of each run.
        sizes = np.concatenate([[0], np.cumsum(np.diff(self.first[: len(self.known) + 1])[words])])
        run_first = np.concatenate([[0], sizes[np.flatnonzero(words == 0) + 1]])
        run_ids = _gathered(self.first[: len(self.known) + 1], self.flat[: self.first[len(self.known)]], words)
        which = runs.indices.to_numpy()
        total = np.concatenate([[0], np.cumsum(np.diff(run_first)[which])])
        return _gathered(run_first, run_ids, which), np.diff(total[split.offsets.to_numpy() - split.offsets[0].as_py()])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls), one after the other, and the number of ids of each."""
        odd = pc.match_substring_regex(texts, self.UNSAFE)
        for s in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        out, counts = [], np.zeros(len(texts), np.int64)
        # Stretches of safe texts of some MB, and odd texts one by one, in order.
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
        at = 0
        while at < len(texts):
            if odd[at]:
                ids = np.array(self.tokenizer.encode(texts[at].as_py(), add_special_tokens=False).ids, np.uint32)
                counts[at] = len(ids)
                stop = at + 1
            else:
                after = np.flatnonzero(odd[at:])
                stop = min(at + int(after[0]) if len(after) else len(texts), max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHUNK_BYTES, side="right")) - 1))
                ids, counts[at:stop] = self._plain(texts.slice(at, stop - at))
            out.append(ids)
            at = stop
        return np.concatenate([*out, np.zeros(0, np.uint32)]), counts

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


@functools.lru_cache(maxsize=4)
def _loaded(digest: str, source: str) -> WordTokenizer:
    return WordTokenizer(source)


def pack(lengths: np.ndarray, capacity: int, weigh: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-of-squares packing of pieces in the order given.

    Each piece goes where the sum of the squared counts of open bins per gap becomes smallest, a new bin being one of the
    choices; on a tie into an open bin, of these into the one that is left with the smallest gap. Without ``weigh`` a new bin is opened only
    where no open one has room: a variety of gaps is of no use to pieces that are the last ones. Returns for each piece its bin and its
    offset there, and for each bin its gap.
    """
    counts = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, size in enumerate(lengths.tolist()):
        # A bin of gap h becomes one of gap h - size: the squares change by 2 * (N(h - size) - N(h) + 1); a bin that fills is counted no more.
        there = counts[size:capacity]
        open_ = np.flatnonzero(there)
        fresh = 2 * counts[capacity - size] + 1 if size < capacity else 0
        at = -1
        if len(open_):
            change = 2 * (counts[open_] - there[open_] + 1)
            change[open_ == 0] = 1 - 2 * there[0]
            at = int(np.argmin(change))
            if weigh and change[at] > fresh:
                at = -1
        if at >= 0:
            left = int(open_[at])
            gap = left + size
            b = waiting[gap].pop()
            counts[gap] -= 1
        else:
            b, gap = len(gaps), capacity
            left = capacity - size
            gaps.append(capacity)
        bins[i], offsets[i], gaps[b] = b, capacity - gap, left
        if left:
            counts[left] += 1
            waiting[left].append(b)
    return bins, offsets, np.array(gaps, np.int64)


_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")
_ROWS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("settled", pa.bool_())])
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, settled boolean"


def _placed(rows: pa.Table, capacity: int, base: int, slack: int | None) -> tuple[pa.Table, int]:
    """Pack rows, longest first, into bins numbered from ``base``; bins with a gap beyond ``slack`` aren't settled. Returns the rows and the number of bins."""
    length = rows.column("length").to_numpy()
    order = np.lexsort((rows.column("ids_crc32").to_numpy(), rows.column("piece").to_numpy(), rows.column("doc_id").fill_null(0).to_numpy(), -length))
    bins, offsets, gaps = pack(length[order], capacity, weigh=slack is not None)
    settled = np.ones(len(order), bool) if slack is None else gaps[bins] <= slack
    found = rows.take(pa.array(order))
    return pa.Table.from_arrays([*[found.column(c) for c in _COLUMNS], pa.array(base + bins), pa.array(offsets), pa.array(settled)], names=_ROWS.names).cast(_ROWS), len(gaps)


def _pieces(docs: pa.Array, ids: np.ndarray, counts: np.ndarray, capacity: int, end_id: int) -> pa.Table:
    """The pieces of documents whose ids stand one after the other, each document with the end id behind."""
    whole = counts + 1
    parts = -(-whole // capacity)
    owner = np.repeat(np.arange(len(counts)), parts)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = piece * capacity
    length = np.minimum(whole[owner] - start, capacity)
    # Bytes of each piece; the end id, which the last piece of a document holds, is added to its checksum afterwards.
    raw, ending = memoryview(ids.astype("<u4").view(np.uint8)), np.array([end_id], "<u4").tobytes()
    first = (np.cumsum(counts) - counts)[owner] + start
    last = piece == parts[owner] - 1
    crc = [zlib.crc32(ending, zlib.crc32(raw[4 * a : 4 * (a + n - 1)])) if end else zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n, end in zip(first.tolist(), length.tolist(), last.tolist(), strict=True)]
    return pa.table({"doc_id": docs.take(pa.array(owner)), "piece": pa.array(piece, pa.int32()), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64())})


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, slack: int = 16, again: int = 8192, together: int = 1 << 18) -> DataFrame:
    """Tokenize every whole text, end it with ``end_id`` and pack all texts into sequences of ``capacity`` tokens.

    Reads ``doc_id`` and ``text`` only, so other columns can't clash. A text longer than a sequence is cut into full pieces and a last one, others
    stay whole, however long the text. A null or empty text is the end id alone; an empty table gives no rows. Returns a row for each piece:
    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Repeated rows, and rows with a null ``doc_id``, are packed like any
    others. Pieces of equal length are placed in order of ``doc_id``, piece and checksum. A task packs at most about ``together`` pieces at once.
    ``slack``: a bin with at most so many free tokens is done after the first pass; ``again``: pieces in a group of the second pass, about.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(read_vocabulary(tokenizer_path))

    def tokenize(batches):
        from pyspark import TaskContext

        enter("packing")
        keeps("packing", _loaded.cache_clear)
        source = held.value
        own = _loaded(hashlib.sha256(source.encode()).hexdigest(), source)
        base = TaskContext.get().partitionId() << 32
        waiting: list[pa.Table] = []
        for batch in batches:
            ids, counts = own.encode_column(batch.column(1))
            waiting.append(_pieces(batch.column(0), ids, counts, capacity, end_id))
            if sum(map(len, waiting)) >= together:
                placed, bins = _placed(pa.concat_tables(waiting), capacity, base, slack)
                base += bins
                waiting = []
                yield from placed.to_batches()
        if sum(map(len, waiting)):
            yield from _placed(pa.concat_tables(waiting), capacity, base, slack)[0].to_batches()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first = scratch.materialize(source.mapInArrow(tokenize, _SCHEMA), "packed")
    rest = first.where("not settled")
    groups = max(1, -(-rest.count() // again))

    def repack(key, table):
        return _placed(table.select(_COLUMNS), capacity, -((key[0].as_py() + 1) << 32), None)[0]

    keyed = rest.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "sequence_id"), F.lit(groups)))
    second = keyed.groupBy("g").applyInArrow(repack, _SCHEMA)
    return first.where("settled").unionByName(second).drop("settled")
