"""Removal of repeated substrings by a distributed merge sort of suffixes.

A string of ``length`` bytes that occurs twice holds, in both places, the same *anchor*: the place of the least hash of its k-byte
grams. So suffixes are sorted at anchors, about one place in 35. An anchor stands for a short range of window starts, and its context is all
bytes of those windows.

1. What can't be repeated is found out before anything is sorted, from packed hashes (the distinguishing-prefix step of a
   communication-efficient string sort): a unique gram costs a few bytes and drops out. If all contexts of a gram are alike, whole contexts are
   sorted. If they differ, as at the edges of a repeated passage, the first of each kind of context is looked at window by window;
   windows that hang together in all places that hold them form one piece, and unique ones drop out.
2. Every task sorts what is left of its own suffixes, each cut to its context or piece, into a run, and keeps the earliest of equal ones.
3. Runs are cut at splitters and exchanged front-coded: a suffix carries the length of the prefix it shares with the one before, and the rest.
4. Each range is merged with a loser tree that holds for every run the length of the prefix it shares with the last suffix put out. A
   comparison starts there and known prefixes are never compared again; equal suffixes show by their shared length alone.
5. All but the earliest of equal suffixes mark their bytes; a last pass over the blocks takes them out.

Hashes (polynomials in two random bases modulo a prime, some 62 bits) decide what is sorted; whether two sorted strings are equal is decided by their bytes.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import scratch
from .worker import enter, tidy

GRAM = 32
#: Short strings that splitters are taken from, at most.
SPLITTER_SAMPLE = 500_000
_CHUNK = 1 << 16
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


#: A string's hash is, for each of two bases, the polynomial of its bytes' values modulo this prime. Prefix sums of values times powers, each below the prime, stay
#: exact in 64 bits for 2 ** 32 bytes.
_PRIME = np.uint64((1 << 31) - 1)
_RANDOM = np.random.default_rng(41)
_BASES = _RANDOM.integers(1 << 20, (1 << 31) - 2, 2).tolist()
_BYTES = _RANDOM.integers(1, (1 << 31) - 1, (2, 256)).astype(np.uint64)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2 ** 62 modulo the prime, which may stand for 0."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    return (x & _PRIME) + (x >> np.uint64(31))


def _power_table(base: int, step: int, count: int) -> np.ndarray:
    """Powers ``base ** (step * i)``."""
    prime, out, factor = int(_PRIME), [1], pow(base, step, int(_PRIME))
    for _ in range(count - 1):
        out.append(out[-1] * factor % prime)
    return np.array(out, np.uint64)


#: Powers of the bases for a chunk's places, and of their inverses for any place, by its low, middle and high bits.
_UP = [_power_table(b, 1, _CHUNK) for b in _BASES]
_DOWN = [[_power_table(pow(b, -1, int(_PRIME)), 1 << shift, 1 << 12) for shift in (0, 12, 24)] for b in _BASES]


def _inverse(which: int, places: np.ndarray) -> np.ndarray:
    """A base to the power of minus each place, modulo the prime."""
    low, middle, high = _DOWN[which]
    return _reduced(_reduced(low[places & 4095] * middle[(places >> 12) & 4095]) * high[places >> 24])


class Anchors:
    """Anchors of a block's documents, with hashes of any of its strings.

    ``place`` of each anchor, and the ``first`` and ``last`` start of the windows of ``length`` bytes whose least gram it is. Windows lie within
    documents; anchors come in order.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int, gram: int = GRAM):
        gram, n = min(gram, length), len(data)
        self.length, self.gram_bytes = length, gram
        width = length - gram + 1
        raw = data.tobytes() + bytes(8)
        self.sums = np.zeros((2, n + 1), np.uint64)
        edge = np.zeros(n + 1, np.int8)  # no document is entered twice, so sums stay 0 or 1
        long_ = np.diff(starts) >= length
        np.add.at(edge, starts[:-1][long_], 1)
        np.add.at(edge, (starts[1:] - length + 1)[long_], -1)
        valid = np.cumsum(edge[:n], dtype=np.int8) > 0
        entry = np.zeros(n + 1, bool)
        entry[starts[:-1]] = True
        total = np.zeros(2, np.uint64)
        shifts = sorted({*range(0, gram - 7, 8), gram - 8}) if gram >= 8 else [0]
        place, first, last = [], [], []
        for offset in range(0, n, _CHUNK):
            count = min(_CHUNK, n - offset)
            reach = min(n, offset + count + length) - offset
            word = np.ndarray((reach,), "<u8", raw, offset, strides=(1,)).astype(np.uint64)
            value = B.mix(word + _K[0])
            for which, base in enumerate(_BASES):
                shifted = np.uint64(pow(base, offset, int(_PRIME)))
                terms = _reduced(_reduced(_BYTES[which][data[offset : offset + count]] * _UP[which][:count]) * shifted)
                np.cumsum(terms, out=self.sums[which, offset + 1 : offset + count + 1])
                self.sums[which, offset + 1 : offset + count + 1] += total[which]
                total[which] = self.sums[which, offset + count]
            windows = min(count, n - length + 1 - offset)
            if windows <= 0:
                continue
            ok = valid[offset : offset + windows]
            if not ok.any():
                continue
            m = windows + width - 1
            key = value[shifts[0] : shifts[0] + m] * _K[1]
            for i, s in enumerate(shifts[1:]):
                key += value[s : s + m] * _K[(i + 2) % 5]
            key ^= key >> np.uint64(29)
            key *= _K[3]
            key &= np.uint64(0xFFFFFFFF00000000)
            key |= np.arange(m, dtype=np.uint64)
            step = 1
            while 2 * step <= width:
                key = np.minimum(key[:-step], key[step:])
                step *= 2
            if step < width:
                key = np.minimum(key[: len(key) - (width - step)], key[width - step :])
            at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            fresh = np.empty(windows, bool)
            fresh[0] = True
            np.not_equal(at[1:], at[:-1], out=fresh[1:])
            fresh[1:] |= ok[1:] != ok[:-1]
            fresh |= entry[offset : offset + windows]
            begins = np.flatnonzero(fresh)
            finish = np.append(begins[1:], windows) - 1
            kept = ok[begins]
            place.append(at[begins[kept]] + offset)
            first.append(begins[kept] + offset)
            last.append(finish[kept] + offset)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        place, first, last = join(place), join(first), join(last)
        # A range that a chunk border cuts is one again.
        new = np.ones(len(place), bool)
        if len(place):
            new[1:] = (place[1:] != place[:-1]) | (first[1:] != last[:-1] + 1) | entry[first[1:]]
        self.place, self.first = place[new], first[new]
        self.last = last[np.append(np.flatnonzero(new)[1:], len(new)) - 1] if len(new) else last

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the strings from start to end: the same for equal strings wherever they stand."""
        found = []
        for which, sums in enumerate(self.sums):
            found.append(_reduced(_reduced(sums[end] - sums[start]) * _inverse(which, start)) % _PRIME)
        return B.mix(found[0] << np.uint64(31) ^ found[1] ^ B.mix((end - start).astype(np.uint64)))


class Prepared:
    """A block's anchors grouped by gram and by context."""

    def __init__(self, block: dict, length: int):
        enter("suffix")
        self.block, self.length = block, length
        self.anchors = a = Anchors(block["data"], block["starts"], length)
        self.first, self.last = a.first, a.last
        gram = a.hashes(a.place, a.place + a.gram_bytes)
        self.context = a.hashes(a.first, a.last + length)
        self.kinds, self.inverse, self.times = np.unique(gram, return_inverse=True, return_counts=True)

    def notes(self) -> np.ndarray:
        """For each gram its context's hash, or 0 if its contexts differ in this block."""
        low = np.maximum(self.context, np.uint64(1))
        order = np.argsort(self.inverse, kind="stable")
        at = np.concatenate([[0], np.cumsum(self.times)[:-1]]) if len(self.times) else np.zeros(0, np.int64)
        if not len(at):
            return np.zeros(0, np.uint64)
        least, most = np.minimum.reduceat(low[order], at), np.maximum.reduceat(low[order], at)
        return np.where(least == most, least, np.uint64(0))

    def distinct(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Contexts whose gram other places have: their bytes, the anchor that holds each first in this block and the gram's code; and the anchors that repeat one."""
        data = self.block["data"].tobytes()
        code = B.codes_of(self.block, len(self.kinds), "grams")[self.inverse]
        seen: dict[bytes, int] = {}
        repeats = []
        for i in np.flatnonzero((code > 0) | (self.times[self.inverse] > 1)).tolist():
            if seen.setdefault(data[self.first[i] : self.last[i] + self.length], i) != i:
                repeats.append(i)
        who = np.fromiter(seen.values(), np.int64, len(seen))
        return list(seen), who, code[who], np.array(repeats, np.int64)

    def elected(self, who: np.ndarray, code: np.ndarray) -> np.ndarray:
        """For contexts of grams with differing contexts what all blocks together know (see :func:`_judge_contexts`), 0 for others."""
        mixed = np.flatnonzero(code == 2)
        values = np.unique(self.context[who[mixed]])
        out = np.zeros(len(who), np.uint8)
        out[mixed] = B.codes_of(self.block, len(values), "contexts")[np.searchsorted(values, self.context[who[mixed]])]
        return out

    def expand(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All windows of some anchors: their starts, and the anchor of each."""
        count = self.last[who] - self.first[who] + 1
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return np.arange(total) + np.repeat(self.first[who] - (ends - count), count), np.repeat(who, count)

    def document(self, places: np.ndarray) -> np.ndarray:
        return self.block["ids"][np.searchsorted(self.block["starts"], places, side="right") - 1]


def _judge_grams(notes, owners, starts, ends):
    """0: one block has the gram, with one context; 1: several have it, all with the same context; 2: contexts differ."""
    least, most = np.minimum.reduceat(notes, starts), np.maximum.reduceat(notes, starts)
    return np.where((least != most) | (least == 0), 2, np.where(ends - starts > 1, 1, 0))


def _judge_contexts(notes, owners, starts, ends):
    """1: no other block has the context; 2: others have it and this one is the first, by document and then by block; 3: it isn't."""
    group = np.repeat(np.arange(len(starts)), ends - starts)
    order = np.lexsort((owners, notes, group))  # groups stay in place
    out = np.full(len(notes), 3)
    out[order[starts]] = 2
    out[starts[ends - starts == 1]] = 1
    return out


def _judge_windows(notes, owners, starts, ends):
    """0 for a window that stands alone, else a sum over all anchors that hold it: equal for windows that the same anchors hold."""
    total = np.add.reduceat(notes & ~np.uint64(1), starts)
    return np.where((ends - starts > 1) | (np.bitwise_or.reduceat(notes, starts) & np.uint64(1) > 0), total | np.uint64(1), np.uint64(0))


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[known:m], "big") ^ int.from_bytes(b[known:m], "big")
    return m - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared lengths, lengths and rests of sorted strings."""
    lcp = [0, *(shared(a, b, 0) for a, b in zip(strings, strings[1:], strict=False))]
    return np.array(lcp[: len(strings)], "<u4"), np.array([len(s) for s in strings], "<u4"), b"".join([s[h:] for s, h in zip(strings, lcp, strict=False)])


def decode_run(lcp: np.ndarray, sizes: np.ndarray, rest: bytes):
    """Strings of a front-coded run with their shared lengths, one at a time."""
    at, last = 0, b""
    for h, n in zip(lcp.tolist(), sizes.tolist(), strict=True):
        last = last[:h] + rest[at : at + n - h]
        at += n - h
        yield last, h


def merge(runs: list):
    """Merge sorted runs of ``(string, length shared with the string before)`` by a loser tree.

    Yields ``(string, run, length shared with the string put out before)``. Every run's head knows how much it shares with the last string put
    out. Of two heads the one that shares more is less; only if both share the same are bytes compared, from there on.
    """
    count = len(runs)
    if not count:
        return
    size = 1
    while size < count:
        size *= 2
    text: list[bytes | None] = [None] * size
    known = [-1] * size  # -1: the run is at its end, which counts as greater than anything
    for i, run in enumerate(runs):
        head = next(run, None)
        if head is not None:
            text[i], known[i] = head[0], 0
    loser = [0] * size
    # First round: play all matches from the leaves up.
    winners = list(range(size))
    level = size
    while level > 1:
        following = []
        for j in range(0, level, 2):
            a, b = winners[j], winners[j + 1]
            if known[a] < 0 or known[b] < 0:
                low, high = (b, a) if known[a] < 0 else (a, b)
            else:
                h = shared(text[a], text[b], 0)
                low, high = (a, b) if text[a] <= text[b] else (b, a)
                known[high] = h
            loser[(level + j) // 2] = high
            following.append(low)
        winners, level = following, level // 2
    top = winners[0]
    while known[top] >= 0:
        yield text[top], top, known[top]
        head = next(runs[top], None)
        if head is None:
            text[top], known[top] = None, -1
        else:
            text[top], known[top] = head
        node = (top + size) // 2
        while node:
            other = loser[node]
            h, k = known[top], known[other]
            if k > h:
                loser[node], top = top, other
            elif k == h and h >= 0:
                a, b = text[top], text[other]
                both = shared(a, b, h)
                if b[both:] < a[both:] or (both == len(a) == len(b) and other < top):
                    known[top] = both
                    loser[node], top = top, other
                else:
                    known[other] = both
            node //= 2


_RUN = "part int, kind int, block_id long, lcp binary, sizes binary, rest binary, docs binary, places binary, origins binary, origin_ids array<long>"


def _run_rows(strings, docs, places, origins, origin_ids, splitters) -> list[tuple]:
    edges = [0, *(bisect.bisect_left(strings, s) for s in splitters), len(strings)]
    out = []
    for part in range(len(edges) - 1):
        a, b = edges[part], edges[part + 1]
        if b > a:
            lcp, sizes, rest = front_code(strings[a:b])
            out.append((part, 0, -1, lcp.tobytes(), sizes.tobytes(), rest, docs[a:b].tobytes(), places[a:b].tobytes(), origins[a:b].tobytes(), origin_ids))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("part", pa.int32()), ("kind", pa.int32()), ("block_id", pa.int64()), *((c, pa.binary()) for c in ("lcp", "sizes", "rest", "docs", "places", "origins")), ("origin_ids", pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def _spans(start: np.ndarray, size: np.ndarray) -> bytes:
    return np.stack([start, start + size], axis=1).astype("<i8").tobytes()


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = False, carry: list[str] | None = None, run_items: int = 200_000) -> DataFrame:
    """Remove every byte of ``docs(doc_id, text)`` that is covered by a string of ``length`` bytes (at least 8) which also starts earlier.

    Texts are taken as UTF-8 bytes; matches never cross documents; earlier means a smaller ``doc_id``, or the same document and an earlier
    start; strings are judged on the input. Rows that repeat a ``doc_id`` come one after the other in some fixed order, and rows with a null ``doc_id`` after
    all others; a null text is empty, a text of any length is taken whole, an empty table gives no rows, columns that aren't named are not read. Returns a row for each document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if
    ``keep_text``, ``kept`` (the text left, without characters that a cut went through) and ``spans`` (start and end of each removed run);
    the columns in ``carry`` come last.
    """
    if length < 8:
        raise ValueError("length must be at least 8")
    spark = docs.sparkSession
    table = B.build(docs, carry=carry)
    parts = B.parts_for(spark, table.bytes())

    def send_grams(block):
        ready = Prepared(block, length)
        return ready.kinds, ready.notes()

    def send_contexts(block):
        ready = Prepared(block, length)
        _, who, code, _ = ready.distinct()
        who = who[code == 2]
        values, at = np.unique(ready.context[who], return_index=True)
        return values, ready.document(ready.first[who[at]]).view(np.uint64) ^ np.uint64(1 << 63)  # in order of signed ids

    def own_windows(ready: Prepared, who: np.ndarray, state: np.ndarray):
        """Windows to look at: of contexts that come first. With their anchors, distinct hashes and places among those."""
        starts, owner = ready.expand(who[(state == 1) | (state == 2)])
        hashes = ready.anchors.hashes(starts, starts + length)
        return starts, owner, *np.unique(hashes, return_inverse=True)

    def send_windows(block):
        ready = Prepared(block, length)
        _, who, code, _ = ready.distinct()
        starts, owner, values, inverse = own_windows(ready, who, ready.elected(who, code))
        own = B.mix(np.array([block["block_id"]], np.uint64) + _K[3])  # never a name of 0, which would not show in a sum
        names = B.mix(own + owner.astype(np.uint64) * _K[2] + _K[4]) & ~np.uint64(1)
        sums, times = np.zeros(len(values), np.uint64), np.bincount(inverse, minlength=len(values))
        np.add.at(sums, inverse, names)
        return values, sums | (times > 1).astype(np.uint64)

    gram_codes = scratch.materialize(B.exchange(table.table, send_grams, parts, _judge_grams, "u8"), "grams")
    grams = B.gathered(gram_codes, "grams")
    context_codes = scratch.materialize(B.exchange(table.joined(grams), send_contexts, parts, _judge_contexts, "u8", "u8"), "contexts")
    contexts = B.gathered(context_codes, "contexts")
    window_codes = scratch.materialize(B.exchange(table.joined(grams, contexts), send_windows, parts, _judge_windows, "u8", "u4", "u8"), "windows")
    windows = B.gathered(window_codes, "windows")
    # Splitters: short strings from all over the corpus, about four times as many as are used, by a hash that no two rows share.
    count, wanted = table.table.select(F.sum(F.size("doc_ids"))).first()[0] or 0, min(32 * parts, SPLITTER_SAMPLE)
    share = max(1, min(1 << 30, (4 * wanted << 30) // max(count, 1)))
    piece = F.expr("substring(text, cast(pmod(h, length(text)) as int) + 1, 24)")
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("h")).where("length(text) > 0")
    probes = rows.where(F.shiftrightunsigned("h", 34) < share).select("h", piece.alias("s")).orderBy("h", "s").limit(wanted).collect()
    some = sorted(r["s"].encode() for r in probes)
    splitters = sorted({some[i * len(some) // parts] for i in range(1, parts)}) if some else []

    def sort_runs(batches):
        strings: list[bytes] = []
        order_docs, order_places, order_origins, origin_ids = [], [], [], []

        def flush():
            docs_, places, origins = (np.concatenate(c) for c in (order_docs, order_places, order_origins))
            ids = np.array(origin_ids, np.int64)
            by_place = np.lexsort((places, ids[origins], docs_))
            ranked = np.array(sorted(by_place.tolist(), key=strings.__getitem__), np.int64)
            texts = [strings[i] for i in ranked.tolist()]
            fresh = np.array([True, *(a != b for a, b in zip(texts, texts[1:], strict=False))], bool)[: len(texts)]
            twice = np.zeros(len(ranked), bool)  # a context and a piece of the same place
            twice[1:] = ~fresh[1:] & (places[ranked[1:]] == places[ranked[:-1]]) & (origins[ranked[1:]] == origins[ranked[:-1]])
            again = ranked[~fresh & ~twice]  # the earliest of equal strings stands first
            sizes = np.array([len(s) for s in strings], np.int64)
            rows = []
            for o in np.unique(origins[again]).tolist():
                mine = again[origins[again] == o]
                rows.append((int(ids[o] % parts), 1, int(ids[o]), None, None, _spans(places[mine], sizes[mine]), None, None, None, None))
            kept = ranked[fresh]
            rows += _run_rows([strings[i] for i in kept.tolist()], docs_[kept], places[kept].astype("<i8"), origins[kept].astype("<u4"), origin_ids[:], splitters)
            for held in (strings, order_docs, order_places, order_origins, origin_ids):
                held.clear()
            return _batch(rows)

        for block in B.rows(batches):
            ready = Prepared(block, length)
            if not len(ready.kinds):
                continue
            data = block["data"].tobytes()
            texts, who, code, repeats = ready.distinct()
            if len(repeats):
                yield _batch([(int(block["block_id"] % parts), 1, block["block_id"], None, None, _spans(ready.first[repeats], ready.last[repeats] - ready.first[repeats] + length), None, None, None, None)])
            state = ready.elected(who, code)
            whole = np.flatnonzero((code == 1) | (state > 1))
            starts, owner, values, inverse = own_windows(ready, who, state)
            sums = B.codes_of(block, len(values), "windows", "u8")[inverse]
            # Pieces: consecutive windows of an anchor that the same anchors hold.
            cut = np.ones(len(starts), bool)
            cut[1:] = (owner[1:] != owner[:-1]) | (sums[1:] != sums[:-1])
            begins = np.flatnonzero(cut)
            ends = np.append(begins[1:], len(starts)) - 1
            some = sums[begins] > 0 if len(begins) else np.zeros(0, bool)
            low, high = starts[begins[some]], starts[ends[some]] + length
            places = np.concatenate([ready.first[who[whole]], low]).astype(np.int64)
            if len(places):
                strings.extend([texts[i] for i in whole.tolist()])
                strings.extend([data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])
                order_docs.append(ready.document(places))
                order_places.append(places)
                order_origins.append(np.full(len(places), len(origin_ids)))
                origin_ids.append(block["block_id"])
            if len(strings) >= run_items:
                yield flush()
        if strings:
            yield flush()

    runs = table.joined(grams, contexts, windows).mapInArrow(sort_runs, _RUN)

    def merge_runs(key, table):
        sources, orders = [], []
        out: dict[int, list] = {}
        part = key[0].as_py()
        told_ids, told = [], []
        for row in table.to_pylist():
            if row["kind"] == 1:
                told_ids.append(row["block_id"])
                told.append(row["rest"])
                continue
            ids = row["origin_ids"]
            origin = [ids[o] for o in np.frombuffer(row["origins"], "<u4").tolist()]
            orders.append(list(zip(np.frombuffer(row["docs"], np.int64).tolist(), origin, np.frombuffer(row["places"], "<i8").tolist(), strict=True)))
            sources.append(decode_run(np.frombuffer(row["lcp"], "<u4"), np.frombuffer(row["sizes"], "<u4"), row["rest"]))
        at = [0] * len(sources)
        best, size = None, 0
        for text, run, h in merge(sources):
            mine = orders[run][at[run]]
            at[run] += 1
            if best is not None and h == size == len(text):
                if mine < best:
                    mine, best = best, mine
                out.setdefault(mine[1], []).append((mine[2], mine[2] + size))
            else:
                best, size = mine, len(text)
        del sources, orders
        for block, spans in out.items():
            told_ids.append(block)
            told.append(np.array(spans, "<i8").tobytes())
        out.clear()
        tidy()
        return pa.table({"block_id": pa.array(told_ids, pa.int64()), "part": pa.array([part] * len(told), pa.int32()), "blob": pa.array(told, pa.binary())})

    marked = scratch.materialize(runs.groupBy("part").applyInArrow(merge_runs, B.SIDE), "marks")
    scratch.discard(gram_codes, context_codes, window_codes)
    marks = B.gathered(marked, "marks")

    def cut(batches):
        enter("suffix")
        for block in B.rows(batches):
            data, starts = block["data"], block["starts"]
            spans = np.frombuffer(b"".join(m["blob"] for m in block["marks"] or []), "<i8").reshape(-1, 2)
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, spans[:, 0], 1)
            np.add.at(edge, spans[:, 1], -1)
            gone = np.cumsum(edge[:-1]) > 0
            begins = gone & ~np.concatenate([[False], gone[:-1]])
            begins[starts[:-1][starts[:-1] < len(data)]] = gone[starts[:-1][starts[:-1] < len(data)]]
            total, runs_ = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
            sha, kept, lists = [], [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                left = data[a:b] if total[b] == total[a] else data[a:b][~gone[a:b]]
                raw = left.tobytes()
                sha.append(hashlib.sha256(raw).hexdigest())
                if keep_text:
                    kept.append(raw.decode("utf-8", "ignore"))
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))).reshape(-1, 2)
                    lists.append(turn.tolist())
            cols = [B.ids_of(block), pa.array(np.diff(starts), pa.int64()), pa.array(np.diff(total[starts]), pa.int64()), pa.array(np.diff(runs_[starts]), pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols += [pa.array(kept, pa.string()), pa.array(lists, pa.list_(pa.list_(pa.int64())))]
                names += ["kept", "spans"]
            if carry:
                cols, names = [*cols, pa.array(block["extra"], pa.string())], [*names, "extra"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string, spans array<array<long>>" * keep_text + ", extra string" * bool(carry)
    out = table.joined(marks, extra=bool(carry)).mapInArrow(cut, schema)
    return table.restored(out, [c for c in out.columns if c != "extra"] + carry) if carry else out
