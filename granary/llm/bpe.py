"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table.

The encoder never applies merges. An Aho-Corasick automaton over the vocabulary gives the longest token at
each place of a pre-token; a pair-compatibility test (would merging the two tokens' texts keep this border?)
says whether two neighbours can stand in a real encoding. Where they cannot, the encoder takes the next
shorter token or steps back. A place that failed once is never tried again, so time is linear.

Texts are cut into pre-tokens by a regular expression of the standard library where every character of the
text is in a set on which it agrees with the tokenizer's own pre-tokenizer; any other text goes through that
pre-tokenizer. Pre-tokens that were met before come from a bounded table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .worker import enter, keeps

CACHE_ENTRIES = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, as stand-in -> byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _same_class(c: str) -> bool:
    """The standard library's classes agree with Unicode's L, N and White_Space on this character."""
    kind = unicodedata.category(c)
    letter, space = re.fullmatch(r"[^\W\d_]", c) is not None, c.isspace()
    if "\x1c" <= c <= "\x1f" or c == "\x85" or unicodedata.combining(c):
        return False
    return letter == (kind[0] == "L") and (re.fullmatch(r"\d", c) is not None) == (kind[0] == "N") and space == (kind[0] == "Z" or c in "\t\n\r\x0b\x0c")


PLAIN_CHARS = frozenset(c for c in map(chr, [*range(0x530), *range(0x2010, 0x205F), *range(0x20A0, 0x20C0)]) if _same_class(c))


def split_special(text: str, specials: dict[str, int]) -> list[tuple[str, int | None]]:
    """Pieces of a text and, for those that are special tokens, their ids."""
    if not specials or not any(s in text for s in specials):
        return [(text, None)]
    pattern = "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))
    return [(part, specials.get(part)) for part in re.split(f"({pattern})", text) if part]


class ByteBPE:
    """A byte-level BPE vocabulary from the text of a tokenizers ``.json`` file."""

    PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

    def __init__(self, source: str):
        import ahocorasick
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model, alphabet = spec["model"], byte_alphabet()
        if spec.get("normalizer") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("not a plain byte-level BPE file")
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        # Tokens are numbered by rank: bytes first, then merges in their order.
        texts, rank_of = [bytes([b]) for b in range(256)], {bytes([b]): b for b in range(256)}
        self.split, self.pairs = [(b, b) for b in range(256)], {}
        for merge in model["merges"]:
            left, right = map(to_bytes, merge.split(" ") if isinstance(merge, str) else merge)
            a, b = rank_of[left], rank_of[right]
            if left + right not in rank_of:
                rank_of[left + right] = len(texts)
                texts.append(left + right)
                self.split.append((a, b))
            self.pairs.setdefault((a, b), rank_of[left + right])
        ids = {to_bytes(s): i for s, i in model["vocab"].items() if s not in self.specials}
        self.id_of = [ids.get(t, -1) for t in texts]
        self.texts, self.lengths = texts, [len(t) for t in texts]
        self.shorter = [next((rank_of[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in rank_of), -1) for t in texts]
        self.automaton = ahocorasick.Automaton()
        for rank, t in enumerate(texts):
            self.automaton.add_word(t.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pre = Tokenizer.from_str(source).pre_tokenizer
        by_id = {i: t for t, i in ids.items()} | {i: s.encode() for s, i in self.specials.items()}
        size = max(by_id) + 1
        self.offsets = np.fromiter(accumulate((len(by_id.get(i, b"")) for i in range(size)), initial=0), np.int64, size + 1)
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)
        self.words: dict[str, bytes] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` can follow token ``a`` within a pre-token.

        The border between them survives if no merge across it would have come before the merges that
        made the two tokens: undo the later of the two merges, look at the pair that then meets at the
        border, and go on until only bytes are left.
        """
        key = (a, b)
        known = self.compatible.get(key)
        if known is not None:
            return known
        limit, pairs, split, ok = 1 << 60, self.pairs, self.split, True
        x, y = a, b
        while True:
            made = pairs.get((x, y))
            if made is not None and made < limit:
                ok = False
                break
            if x < 256 and y < 256:
                break
            # The later merge is undone first; on the right side a merge of the same rank comes after the left one.
            if x > y:
                limit, x = x, split[x][1]
            else:
                limit, y = y + 1, split[y][0]
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def ranks(self, word: bytes) -> list[int]:
        """Token ranks of one pre-token."""
        lengths, n = self.lengths, len(word)
        longest = [0] * n
        for end, rank in self.automaton.iter(word.decode("latin-1")):
            longest[end + 1 - lengths[rank]] = rank  # ends come in order, so the last is the longest
        if lengths[longest[0]] == n:
            return [longest[0]]
        shorter, fits = self.shorter, self.fits
        dead, out, at = bytearray(n + 1), [], 0
        token = longest[0]
        while True:
            end = at + lengths[token]
            if not dead[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                last = out.pop()
                at -= lengths[last]
                token = shorter[last]

    def prefix_counts(self, word: bytes) -> list[int]:
        """Tokens of each prefix of one pre-token (0 to all bytes), by dynamic programming over last tokens."""
        lengths, fits, n = self.lengths, self.fits, len(word)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for end, rank in self.automaton.iter(word.decode("latin-1")):
            ending[end + 1].append(rank)
        for i in range(1, n + 1):
            for rank in ending[i]:
                start = i - lengths[rank]
                if start == 0 or fits(last[start], rank):
                    last[i], count[i] = rank, count[start] + 1
                    break
        return count

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if PLAIN_CHARS.issuperset(text):
            return self.PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)] if text else []

    def _ids(self, word: str) -> bytes:
        if len(self.words) >= CACHE_ENTRIES:
            self.words.clear()
        found = np.array([self.id_of[r] for r in self.ranks(word.encode())], "<u4").tobytes()
        if len(word) <= 64:
            self.words[word] = found
        return found

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        out, known = [], self.words
        for part, special in split_special(text, self.specials):
            if special is not None:
                out.append(special.to_bytes(4, "little"))
            else:
                out.extend([known.get(w) or self._ids(w) for w in self.pieces(part)])
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: a gather from one buffer by the offset table. Unknown ids give nothing."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)]
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
        return self.blob[place].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def _loaded(digest: str, source: str) -> ByteBPE:
    return ByteBPE(source)


def load(source: str) -> ByteBPE:
    """One vocabulary per worker process and file."""
    return _loaded(hashlib.sha256(source.encode()).hexdigest(), source)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    A row for each row of ``docs``: the id column, ``n_tokens`` long, ``ids_sha256`` (ids as little-endian unsigned
    32-bit integers), ``decoded_sha256`` (decoded text in UTF-8), and, if asked for, ``ids`` array<int> and
    ``decoded`` string. A null text counts as empty: no tokens. Repeated rows stay repeated, a null id stays null, an empty table gives no rows, and texts of any length, also without a
    break, are encoded whole. Only the two columns named are read, so others can't clash.
    The vocabulary file is read on the driver and broadcast (a fixed size of one or two MB).
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(read_vocabulary(tokenizer_path))
    sha = hashlib.sha256

    def run(batches):
        enter("bpe")
        bpe = load(held.value)
        keeps("bpe", _loaded.cache_clear)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                raw = bpe.encode_bytes(text or "")
                ids = np.frombuffer(raw, "<u4")
                back = bpe.decode(ids)
                rows.append((len(ids), sha(raw).hexdigest(), sha(back.encode()).hexdigest(), ids.astype(np.int32) if keep_ids else None, back if keep_text else None))
            n, a, b, ids, texts = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            if keep_text:
                cols, names = [*cols, pa.array(texts, pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    source = docs.select(id_col, docs[text_col].cast("string").alias("text"))
    kind = source.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return source.mapInArrow(run, schema)
