"""Ranked lexical search over a bit-sliced impact index.

A block of the index holds some thousand documents in order of ``doc_id``. A document has one bit in it, and a term's impacts are kept as bitmaps,
one for each bit of the impact. A query never looks at a document alone: the bitmaps of its terms are multiplied by the terms'
weights and added up by bitwise carry arithmetic, for all documents of the block at once. The best are found by going down the slices of
the sum from the most significant one, keeping the documents that are surely in and those that are still tied.

The impact of a term in a document depends on the corpus through two numbers only, how many documents and how many terms it has. The weight of a
term, which needs its document frequency, is multiplied in at the search. So blocks are built where their texts are, and no posting is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .worker import enter, tidy

#: Text and documents of a block, at most; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 1 << 16
#: Items searched together, and their bytes; more go in several rounds over the index.
ITEMS, ITEM_BYTES = 2048, 8 << 20
#: The impact is less than 10 ** 6 for a document's measure of at least 25.
IMPACT_BITS = 20
#: Bytes of terms: digits, letters and all of characters beyond ASCII; A-Z become a-z, any other byte a space.
_SOLID = np.array([chr(b).isalnum() or b > 127 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if _SOLID[b] else 32 for b in range(256)], np.uint8)
_INDEX = "block_id long, doc_ids array<long>, terms binary, term_ends binary, ends binary, places binary, slices array<binary>"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, A-Z as a-z."""
    return (text or "").encode().translate(_LOWER.tobytes()).split()


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each row begins (one more than rows); a null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)), offsets - offsets[0]


def _beginnings(solid: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks at the first byte of each term; terms end with their text."""
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begin[heads] = solid[heads]
    return begin


def _as_bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all their terms."""

    def run(batches):
        enter("ranked")
        for batch in batches:
            data, offsets = _buffers(batch.column(0))
            counts = np.diff(np.concatenate([[0], np.cumsum(_beginnings(_SOLID[data], offsets))])[offsets])
            yield pa.RecordBatch.from_arrays([pa.array([int((counts > 0).sum())], pa.int64()), pa.array([int(counts.sum())], pa.int64())], ["n", "l"])

    found = _as_bytes(docs).select("text").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return found[0] or 0, found[1] or 0


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, int, int]:
    """The index of ``docs(doc_id, text)`` as a written table, a block a row, with :func:`corpus_size`.

    A block has its documents' ids, its terms (joined, with their ends), where each term's postings end, the documents' places in order of term and
    place, and of the impacts one bitmap for each bit over those postings. A null text has no terms; a document without terms isn't kept.
    """
    documents, length = corpus_size(docs)

    def run(batches):
        from pyspark import TaskContext

        enter("ranked")
        pid, made = TaskContext.get().partitionId(), 0
        ids, sizes, values, lengths, held = [], [], [], [], 0

        def flush():
            nonlocal held, made
            # Documents in order of id, null ones last, equal ones as they came.
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, i))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            measure = np.array([25 + 75 * sizes[i] * documents // length for i in order], np.int64)
            ends_of = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(ends_of) - 1, [None, pa.py_buffer(ends_of), pa.py_buffer(np.concatenate(values))]).dictionary_encode()
            key = words.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(place, sizes)
            key, tf = np.unique(key, return_counts=True)  # in order of term and place
            term, places = key // len(ids), key % len(ids)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * measure[places])
            names, name_offsets = _buffers(words.dictionary)
            ends = np.cumsum(np.bincount(term, minlength=len(words.dictionary)))
            row = [
                pa.array([(pid << 32) | made], pa.int64()), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())),
                pa.array([names.tobytes()], pa.binary()), pa.array([name_offsets[1:].astype("<u4").tobytes()], pa.binary()), pa.array([ends.astype("<u4").tobytes()], pa.binary()), pa.array([places.astype("<u4").tobytes()], pa.binary()),
                pa.array([[np.packbits((impact >> b) & 1 > 0, bitorder="little").tobytes() for b in range(IMPACT_BITS)]], pa.list_(pa.binary())),
            ]
            made, held = made + 1, 0
            for x in (ids, sizes, values, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays(row, ["block_id", "doc_ids", "terms", "term_ends", "ends", "places", "slices"])

        for batch in batches:
            data, offsets = _buffers(batch.column(1))
            docs_, at = batch.column(0).to_pylist(), 0
            while at < len(docs_):
                # As many documents as the block has room for, one at least.
                to = max(at + (not ids), min(int(np.searchsorted(offsets, offsets[at] + block_bytes - held, side="right")) - 1, at + block_docs - len(ids)))
                if to > at:
                    part, borders = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
                    solid = _SOLID[part]
                    begin = _beginnings(solid, borders)
                    counts = np.diff(np.concatenate([[0], np.cumsum(begin)])[borders])
                    first = np.concatenate([[0], np.cumsum(solid)])[np.flatnonzero(begin)]
                    values.append(_LOWER[part[solid]])
                    lengths.append(np.diff(np.append(first, len(values[-1]))))
                    some = np.flatnonzero(counts).tolist()
                    ids.extend([docs_[at + i] for i in some])
                    sizes.extend(counts[some].tolist())
                    held += int(borders[-1])
                    at = to
                if ids and (at < len(docs_) or held >= block_bytes or len(ids) >= block_docs):
                    yield flush()
        if ids:
            yield flush()
        tidy()

    return scratch.materialize(_as_bytes(docs).mapInArrow(run, _INDEX), "impacts"), documents, length


def add(total: np.ndarray, other: np.ndarray, shift: int = 0) -> None:
    """Add bit-sliced numbers to others in place, a slice a row, least significant first; ``other`` counts ``2 ** shift`` times. ``total`` must have rows enough for the sum."""
    carry = None
    for i in range(shift, len(total)):
        a = total[i]
        b = other[i - shift] if i - shift < len(other) else None
        if b is None and carry is None:
            return
        if b is None or carry is None:
            c = carry if b is None else b
            carry, total[i] = a & c, a ^ c
            if b is None and not carry.any():
                return
        else:
            both = a ^ b
            following = (a & b) | (carry & both)
            total[i] = both ^ carry
            carry = following


def times(slices: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Bit-sliced numbers of several terms, each term's multiplied by its factor: shifted additions. Rows are slices, then come terms, then documents."""
    most = int(factors.max()).bit_length()
    out = np.zeros((len(slices) + most, *slices.shape[1:]), np.uint64)
    for bit in range(most):
        on = -((factors >> bit) & 1).astype(np.int64)
        if on.any():
            add(out, slices & on.view(np.uint64)[None, :, None], bit)
    return out


def top(slices: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest numbers above 0, the smaller place first among equal ones; as many as there are, in order of place."""
    tied = np.bitwise_or.reduce(slices, axis=0)
    sure = np.zeros_like(tied)
    room = k
    if int(np.bitwise_count(tied).sum()) > k:
        for row in slices[::-1]:
            ones = tied & row
            n = int(np.bitwise_count(ones).sum())
            if n > room:
                tied = ones
            else:
                sure |= ones
                tied = tied & ~row
                room -= n
                if not room:
                    break
    places = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    return np.sort(np.concatenate([places(sure), places(tied)[:room]]))


def numbers_at(slices: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The numbers at some places."""
    bits = (slices[:, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
    return (bits.astype(np.int64) << np.arange(len(slices))[:, None]).sum(axis=0)


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def _words_of(row: dict) -> list[bytes]:
    raw, at, out = row["terms"], 0, []
    for end in np.frombuffer(row["term_ends"], "<u4").tolist():
        out.append(raw[at:end])
        at = end
    return out


def _frequencies(index: DataFrame, wanted: dict[bytes, int]) -> dict[int, int]:
    """Document frequencies of some terms by their number."""
    held = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        found = np.zeros(len(held.value), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.diff(np.frombuffer(row["ends"], "<u4").astype(np.int64), prepend=0)
                for i, word in enumerate(_words_of(row)):
                    number = held.value.get(word)
                    if number is not None:
                        found[number] += counts[i]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some], pa.int64())], ["term", "n"])

    rows = index.select("terms", "term_ends", "ends").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # as many as the block of items has terms
    return {r["term"]: r["n"] for r in rows}


#: Bytes of weighted slices held at a time, terms multiplied together, and items added up together.
HELD_BYTES, TERMS_AT_ONCE, ITEMS_AT_ONCE = 32 << 20, 32, 32


class _Scorer:
    """One block of the index and what a set of items asks of it."""

    def __init__(self, row: dict, wanted: dict[bytes, int], weights: dict[int, int]):
        self.width = -(-len(row["doc_ids"]) // 64) * 64
        self.places = np.frombuffer(row["places"], "<u4")
        self.slices = np.stack([np.frombuffer(s, np.uint8) for s in row["slices"]])
        ends = np.frombuffer(row["ends"], "<u4").tolist()
        self.range = {}
        for i, word in enumerate(_words_of(row)):
            number = wanted.get(word)
            if number is not None and weights.get(number):
                self.range[number] = (ends[i - 1] if i else 0, ends[i])
        self.weights = weights
        self.rows = IMPACT_BITS + max([w.bit_length() for w in weights.values()], default=0)

    def weighted(self, numbers: list[int]) -> dict[int, np.ndarray]:
        """The weighted impacts of some terms that the block holds, as slices."""
        out = {}
        for at in range(0, len(numbers), TERMS_AT_ONCE):
            some = numbers[at : at + TERMS_AT_ONCE]
            wide = np.zeros((IMPACT_BITS, len(some), self.width), np.uint8)
            for j, number in enumerate(some):
                a, b = self.range[number]
                wide[:, j, self.places[a:b]] = np.unpackbits(self.slices[:, a >> 3 : (b + 7) >> 3], axis=1, bitorder="little")[:, a & 7 : (a & 7) + b - a]
            product = times(np.packbits(wide, axis=2, bitorder="little").view(np.uint64), np.array([self.weights[n] for n in some], np.int64))
            out |= {n: product[:, j] for j, n in enumerate(some)}
        return out

    def groups(self, items: list[list[tuple[int, int]]]) -> Iterator[list[tuple[int, list[tuple[int, int]]]]]:
        """Items with terms in the block, in groups whose weighted slices fit in memory together."""
        room = max(1, HELD_BYTES // (self.rows * self.width // 8))
        group, seen = [], set()
        for i, item in enumerate(items):
            mine = [x for x in item if x[0] in self.range]
            if not mine:
                continue
            if group and (len(group) == ITEMS_AT_ONCE or len(seen | {n for n, _ in mine}) > room):
                yield group
                group, seen = [], set()
            group.append((i, mine))
            seen |= {n for n, _ in mine}
        if group:
            yield group

    def best(self, items: list[list[tuple[int, int]]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each item's place in the list, with the places and scores of its best documents; an item is a list of ``(term, repeats)``."""
        room = max(1, HELD_BYTES // (self.rows * self.width // 8))
        for group in self.groups(items):
            extra = max(sum(r for _, r in mine) for _, mine in group).bit_length()
            total = np.zeros((self.rows + extra, len(group), self.width // 64), np.uint64)
            most = max(len(mine) for _, mine in group)
            step = most if len(group) > 1 else room  # an item of very many terms is a group of its own and is added up in pieces
            for at in range(0, most, step):
                pieces = [mine[at : at + step] for _, mine in group]
                product = self.weighted(sorted({n for piece in pieces for n, _ in piece}))
                for j in range(max(map(len, pieces))):
                    some = [(g, *piece[j]) for g, piece in enumerate(pieces) if j < len(piece)]
                    repeats = max(r for _, _, r in some)
                    for bit in range(repeats.bit_length()):
                        other = np.zeros((max(len(product[n]) for _, n, _ in some), *total.shape[1:]), np.uint64)
                        for g, n, r in some:
                            if r >> bit & 1:
                                other[: len(product[n]), g] = product[n]
                        add(total, other, bit)
            for g, (i, _) in enumerate(group):
                places = top(total[:, g], k)
                yield i, places, numbers_at(total[:, g], places)


def _search_block(index: DataFrame, documents: int, rows: list, k: int) -> DataFrame:
    """The best documents for one block of items."""
    spark = index.sparkSession
    wanted, items = {}, []
    for r in rows:
        items.append([(wanted.setdefault(t, len(wanted)), n) for t, n in sorted(Counter(terms(r["text"])).items())])
    weights = {t: weight(documents, n) for t, n in _frequencies(index, wanted).items()}
    held = spark.sparkContext.broadcast((wanted, weights, items))

    def run(batches):
        enter("ranked")
        wanted, weights, items = held.value
        kept: list[list[tuple]] = [[] for _ in items]
        rank = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2], x[3])
        for batch in batches:
            for row in batch.to_pylist():
                scorer = _Scorer(row, wanted, weights)
                ids = row["doc_ids"]
                for i, places, scores in scorer.best(items, k):
                    if len(places):
                        kept[i] = sorted([*kept[i], *((s, ids[p], row["block_id"], p) for p, s in zip(places.tolist(), scores.tolist(), strict=True))], key=rank)[:k]
        flat = [(i, *x) for i, best in enumerate(kept) for x in best]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["item", "score", "doc_id", "block_id", "place"])
        tidy()

    found = index.mapInArrow(run, "item int, score long, doc_id long, block_id long, place long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block_id", "place")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block of items at most


def search(index: DataFrame, documents: int, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of an index for each of ``items(item_id, text)``: ``item_id, rank, doc_id, score``, scores above 0 only.

    Items are taken in blocks of at most :data:`ITEMS` rows or :data:`ITEM_BYTES` on average, each in a round of its own over the index. Rows that repeat an item's id and text are
    searched once; items with the same id and different texts are items of their own; a null text asks for nothing.
    """
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if not size[0] or not documents:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks = max(1, -(-size[0] // ITEMS), -(-(size[1] or 0) // ITEM_BYTES))
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # a block: about ITEMS rows
        if rows:
            rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
            found = _search_block(index, documents, rows, k)
            out = found if out is None else out.unionByName(found)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index ``docs(doc_id, text)`` and search it for ``items(item_id, text)``.

    Terms are runs of digits, letters and characters beyond ASCII in the whole text, A-Z as a-z. Returns ``item_id, rank, doc_id, score``; of equal scores
    the smaller ``doc_id`` comes first, a null one last. Rows of ``docs`` that repeat are ranked one after the other; a null or empty text has no terms
    and is never found; texts of any length are taken whole. Empty tables give no rows. Other columns are not read, so their names can't clash.
    """
    index, documents, _ = build_index(docs)
    return search(index, documents, items, k)
