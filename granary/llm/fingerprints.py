"""Document fingerprints by a randomised edit embedding.

A walk goes over a text's characters and writes one of them at each step; a random bit, which depends on the step and the character and is the same for all
texts, decides whether it then moves on. Where two texts differ by an edit, their walks part and, as both read the same random bits, soon meet
again: texts at a small edit distance become strings at a small Hamming distance. The bits of a fingerprint sample that string: at each of a set of
steps, shared by all texts, one random bit of the character written there. Steps are drawn per octave, so texts of any length are sampled evenly enough
along the whole of it, and any two fingerprints can be compared.

Bands of those bits are keys under which like fingerprints meet; whole fingerprints verify (:func:`near_documents`).
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, scratch
from .deal import join_dealt
from .worker import enter, tidy

#: Sampled steps in an octave, at most; octaves with no more steps are taken whole.
SAMPLES, OCTAVES = 96, 40
#: The random bits of a class of characters repeat after so many steps; characters are dealt over so many classes.
PERIOD, CLASSES = 4096, 64


def _tables() -> tuple[list, np.ndarray, np.ndarray]:
    """The walk's states, the sampled steps in order and how many steps each stands for.

    A state is a list with the state that follows for each class of characters, and its number (the step modulo the period) at the end.
    """
    rng = np.random.default_rng(12)
    moves = rng.integers(0, 2, (PERIOD, CLASSES), np.int8)
    moves[-1] = 1  # no walk waits for more than a period
    following = np.zeros((PERIOD, CLASSES), np.int64)
    after = np.zeros(CLASSES, np.int64)
    for step in range(PERIOD - 1, -1, -1):
        after = np.where(moves[step] == 1, (step + 1) % PERIOD, after)
        following[step] = after
    states: list[list] = [[] for _ in range(PERIOD)]
    for number, row in enumerate(following.tolist()):
        states[number].extend([states[n] for n in row])
        states[number].append(number)
    steps, worth = [], []
    for octave in range(OCTAVES):
        low, width = (1 << octave) - 1, 1 << octave
        some = np.arange(width) if width <= SAMPLES else np.unique(np.concatenate([rng.integers(0, width, SAMPLES - 1), [0]]))
        steps.append(low + some)
        worth.append(np.full(len(some), width / len(some)))
    return states, np.concatenate(steps).astype(np.int64), np.concatenate(worth)


_STATES, _STEPS, _WORTH = _tables()
_LAST = operator.itemgetter(CLASSES)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x >> np.uint64(63)


class Walk:
    """The walk over a text: its characters, and the step at which each is first written, one more than characters."""

    def __init__(self, text: str):
        self.chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
        self.classes = ((self.chars * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(math.log2(CLASSES)))).astype(np.uint8)
        self.steps = self._walked(self.classes, 0)

    @staticmethod
    def _walked(classes: np.ndarray, at: int) -> np.ndarray:
        """Steps before and after each character, for a walk that stands at step ``at``."""
        numbers = np.fromiter(map(_LAST, itertools.accumulate(classes.tobytes(), operator.getitem, initial=_STATES[at % PERIOD])), np.int16, len(classes) + 1)
        moved = np.diff(numbers).astype(np.int64)
        moved[moved <= 0] += PERIOD
        return at + np.concatenate([[0], np.cumsum(moved)])

    def edited(self, keep: int, other: Walk, count: int) -> Walk:
        """The walk over this text's first ``keep`` characters and then the first ``count`` of another."""
        out = object.__new__(Walk)
        out.chars = np.concatenate([self.chars[:keep], other.chars[:count]])
        out.steps = np.concatenate([self.steps[:keep], self._walked(other.classes[:count], int(self.steps[keep]))])
        return out

    def bits(self) -> tuple[int, np.ndarray]:
        """Steps in all, and a bit for each sampled step before that."""
        total = int(self.steps[-1])
        at = _STEPS[: np.searchsorted(_STEPS, total)]
        char = self.chars[np.searchsorted(self.steps, at, side="right") - 1].astype(np.uint64)
        return total, _mixed(char * np.uint64(0x100000001B3) ^ _mixed_steps[: len(at)]).astype(np.uint8)


_mixed_steps = _STEPS.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)


def written(print_: tuple[int, np.ndarray]) -> str:
    """A fingerprint as text: its steps, a point, its bits in base 64."""
    return f"{print_[0]}.{base64.b64encode(np.packbits(print_[1]).tobytes()).decode()}"


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    steps, _, bits = fingerprint.partition(".")
    total = int(steps)
    return total, np.unpackbits(np.frombuffer(base64.b64decode(bits), np.uint8), count=int(np.searchsorted(_STEPS, total)))


def fingerprint(text: str) -> str:
    return written(Walk(text).bits())


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Share of the longer walk on which two fingerprints agree, from 0 to 1; agreement by chance counts nothing. Equal ones have 1."""
    both, most = min(len(a[1]), len(b[1])), max(len(a[1]), len(b[1]))
    if a[0] == b[0] and np.array_equal(a[1], b[1]):
        return 1.0
    if not both:
        return 0.0
    agreed = 1.0 - 2.0 * (a[1][:both] ^ b[1][:both])
    return float(min(1.0, max(0.0, (agreed * _WORTH[:both]).sum() / _WORTH[:most].sum())))


_ROWS = "kind int, part int, place long, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


class _Seen:
    """A text with its walk and fingerprint."""

    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.walk = Walk(self.text)
        self.bits = self.walk.bits()

    def paired(self, other: _Seen) -> tuple:
        """The result of this document, ``other`` being the next."""
        n = len(self.text)
        taken = min(n // 3, len(other.text))
        keep = n - n // 3
        edited = self.text[:keep] + other.text[:taken]
        after = self.walk.edited(keep, other.walk, taken).bits() if n // 3 else self.bits
        return (self.doc_id, None, n, hashlib.sha256(edited.encode()).hexdigest(), written(self.bits), written(after), likeness(self.bits, after), likeness(self.bits, other.bits))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text of ``docs(doc_id, text)``, of its edited text, and how alike they are.

    The edited text has the last third of the characters (rounded down) replaced by as many of the next document's first ones, or all it has. Next is the
    document with the next smaller ``doc_id``; after the last comes the first; a table of one row is its own next. A null ``doc_id`` counts as the largest; rows that share one are in
    order of a hash of their text, repeated rows in any order. Returns a row for each row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. A null text counts as empty; an empty text is like an empty one only. Texts of any length are walked whole; an empty table gives no rows; other columns are
    not read.

    Rows are dealt out by ranges of that order, whatever the number of rows that share an id; what a range can't know, the document after its last, is
    looked up in a second, small step.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_first(), F.col("h").asc()]
    dealt = rows.withColumn("h", F.xxhash64("text"))
    # The last column parts repeated rows, so that they can go to several ranges.
    dealt = dealt.withColumn("u", F.monotonically_increasing_id()).repartitionByRange(scratch.partitions(spark), *order, "u").sortWithinPartitions(*order, "u").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        enter("fingerprints")
        part, last, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen = _Seen(doc_id, text.as_py())
                if last is None:
                    out.append((1, part, 0, doc_id, seen.text, *[None] * 6))  # the range's first document
                else:
                    out.append((0, part, place, *last.paired(seen)))
                last, place = seen, place + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(_KINDS), _KINDS, strict=True)], _NAMES)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((2, part, place, last.doc_id, last.text, *[None] * 6), _KINDS, strict=True)], _NAMES)
        tidy()

    made = scratch.materialize(dealt.mapInArrow(run, _ROWS), "fingerprints")
    parts = sorted(r[0] for r in made.where("kind = 1").select("part").collect())  # one number for each range
    final = made.where("kind = 0").select("doc_id", *_NAMES[5:])
    if not parts:
        return final
    following = F.broadcast(spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, following int"))
    firsts = made.where("kind = 1").select(F.col("part").alias("following"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    open_ = made.where("kind = 2").select("part", "doc_id", "text").join(following, "part").join(firsts.hint("shuffle_hash"), "following")

    def finish(batches):
        for batch in batches:
            out = []
            for doc_id, text, next_id, next_text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_id", "next_text")), strict=True):
                found = _Seen(doc_id, text).paired(_Seen(next_id, next_text))
                out.append((found[0], *found[2:]))
            kinds = [_KINDS[3], *_KINDS[5:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], ["doc_id", *_NAMES[5:]])

    return final.unionByName(open_.mapInArrow(finish, final.schema))


def bands_for(rows: int, least: float, recall: float) -> tuple[int, int]:
    """Bits of a band and number of bands, so that of fingerprints as like as ``least`` the share ``recall`` meets, and few unlike ones do."""
    agree = (1 + least) / 2
    bits = max(12, math.ceil(math.log2(max(rows, 2))))
    bits = min(bits, SAMPLES)
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))


def band_keys(print_: tuple[int, np.ndarray], bits: int, bands: int) -> np.ndarray:
    """Keys of a fingerprint: bits drawn from its last two whole octaves, the second of which a somewhat shorter text has too; a short text is its own key."""
    total, found = print_
    octave = (total + 1).bit_length() - 2  # the last one that the walk has gone through
    keys = []
    for k in (octave, octave - 1):
        low = int(np.searchsorted(_STEPS, (1 << k) - 1)) if k >= 0 else 0
        high = int(np.searchsorted(_STEPS, (1 << (k + 1)) - 1)) if k >= 0 else 0
        if high - low < 32:
            continue
        mine = found[low:high]
        chosen = np.random.default_rng(7 + k).integers(0, high - low, (bands, bits))
        packed = np.packbits(mine[chosen], axis=1)
        keys += [int.from_bytes(hashlib.blake2b(bytes([k]) + i.to_bytes(2, "little") + row.tobytes(), digest_size=8).digest(), "little", signed=True) for i, row in enumerate(packed)]
    return np.array(keys or [int.from_bytes(hashlib.blake2b(written(print_).encode(), digest_size=8).digest(), "little", signed=True)], np.int64)


def near_documents(prints: DataFrame, least: float = 0.8, recall: float = 0.98, together: int = 512) -> DataFrame:
    """Groups of documents whose fingerprints are at least ``least`` alike.

    ``prints(doc_id, fingerprint)`` is a table as :func:`fingerprint_documents` makes it. Equal fingerprints are one class. Classes meet under bands of their bits, and
    every two that meet are verified by the whole of their fingerprints; a key that more than ``together`` classes share is dealt over parts, of which every two
    meet in a task of their own. Returns a row for each row: ``doc_id, component_id`` (least ``doc_id`` of its group). A pair as like as ``least`` meets with the probability ``recall`` at
    least; no pair below it is linked. A null fingerprint is a group of its own.
    """
    spark = prints.sparkSession
    named = prints.select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint", F.xxhash64("fingerprint", F.lit(1)).alias("node"))
    classes = scratch.materialize(named.where("fingerprint is not null").groupBy("node", "fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    bits, bands = bands_for(classes.count(), least, recall)

    def sign(batches):
        enter("fingerprints")
        for batch in batches:
            keys = [band_keys(read(x), bits, bands) for x in batch.column(1).to_pylist()]
            owners = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(owners)], ["key", "node"])

    signs = scratch.materialize(classes.select("node", "fingerprint").mapInArrow(sign, "key long, node long"), "bands")
    shared = scratch.materialize(signs.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    placed = join_dealt(signs, shared.withColumn("parts", F.ceil(F.col("m") / together).cast("int")), ["key"], "m", F.col("node"))
    placed = placed.withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "node", "p", F.least("p", "o").alias("x"), F.greatest("p", "o").alias("y"))

    def verify(key, table):
        prints_ = [read(x) for x in table.column("fingerprint").to_pylist()]
        nodes, side = table.column("node").to_numpy(), table.column("p").to_numpy()
        apart = key[1].as_py() != key[2].as_py()
        root = list(range(len(nodes)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(nodes)):
            for j in range(i):
                if (not apart or side[i] != side[j]) and find(i) != find(j) and likeness(prints_[i], prints_[j]) >= least:
                    root[find(i)] = find(j)
        at = [find(i) for i in range(len(nodes))]
        return pa.table({"a": pa.array(nodes), "b": pa.array(nodes[at])})

    links = met.join(classes.select("node", "fingerprint"), "node").groupBy("key", "x", "y").applyInArrow(verify, "a long, b long").where("a <> b")
    joined = graph.components(links)
    tops = classes.select("node", "least", "copies").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = tops.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    tops = scratch.materialize(join_dealt(tops, heads, ["root"], "m", F.col("node")).select("node", "component_id", "copies"), "tops")
    out = join_dealt(named.where("fingerprint is not null"), tops, ["node"], "copies", F.col("doc_id"))
    return out.select("doc_id", "component_id").unionByName(named.where("fingerprint is null").select("doc_id", F.col("doc_id").alias("component_id")))
