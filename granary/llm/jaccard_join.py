"""Jaccard join of word n-gram sets by token-combination prefixes.

All sets are ordered alike: by document frequency, then by hash. Two sets that are similar enough can differ in few tokens, so they
meet in a prefix. Rare tokens of the prefix are indexed one by one. Where a set has too few rare tokens, its prefix is
extended into the frequent ones: tokens of the middle class are indexed in combinations of two neighbours, those of the most frequent class in
combinations of three, which far fewer sets share than a single token. The extension is just long enough that what two similar sets may differ in
cannot break all that they share (see :func:`signatures`). Tokens of one document alone are never indexed. Every key is also split
by the sets' sizes, so only sets of similar sizes meet.

Sets that meet form candidate clusters; each cluster is joined exactly, every set being sent once. A cluster that is too large for a
task is cut, its parts are joined, and what then still falls apart is joined key by key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import graph, scratch
from .deal import join_dealt
from .worker import enter

#: Tokens of at most so many documents are rare; above the second number (the census ends at 255) they are of the most frequent class.
RARE, MIDDLE = 32, 254
#: Sets joined in one task, and their bytes; larger clusters are cut.
CLUSTER, CLUSTER_BYTES = 1024, 32 << 20
#: Bytes of words that are digested together.
LONG = 256
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_SOLID = np.ones(256, bool)
_SOLID[[32, *range(9, 14)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents in a row, A-Z as a-z, and where each document's begin (one more than documents).

    Words are told apart by their bytes: a 64-bit digest of their length and of eight bytes at a time, of all words at once. Words of more than
    :data:`LONG` bytes are digested one by one.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    solid = _SOLID[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    heads = starts[:-1][np.diff(starts) > 0]
    begin[heads] = solid[heads]
    first = np.flatnonzero(begin)
    solid[:-1] &= begin[1:] | ~solid[1:]
    size = np.flatnonzero(solid) + 1 - first
    lower = np.zeros(len(data) + 8, np.uint8)
    lower[: len(data)] = _LOWER[data]
    eight = np.ndarray((len(data) + 1,), "<u8", lower, strides=(1,))

    def chunk(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))

    digests = B.mix(size.astype(np.uint64) * _K[3] ^ chunk(first, size))
    open_, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(open_):
        digests[open_] = B.mix(digests[open_] * _K[0] ^ chunk(first[open_] + done, size[open_] - done))
        done += 8
        open_ = open_[size[open_] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        digests[i] = xxhash.xxh3_64_intdigest(lower[first[i] : first[i] + size[i]].tobytes(), 0x5851F42D4C957F2D)
    return digests, np.searchsorted(first, starts)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    count = len(words) - width + 1
    total = np.full(max(count, 0), width, np.uint64)
    for i in range(width if count > 0 else 0):
        total = (total ^ (words[i : count + i] * _K[i % 5] + np.uint64(i))) * _K[(i + 1) % 5]
        total ^= total >> np.uint64(29)
    return B.mix(total)


def block_sets(block: dict, n: int, only: list[int] | None = None) -> dict[int, np.ndarray]:
    """Sorted hashes of the distinct n-word shingles of a block's documents, by their place in the block; fewer than n words count as one shingle."""
    enter("jaccard")
    data, starts = block["data"], block["starts"]
    places = list(range(len(block["ids"]))) if only is None else only
    if len(places) < len(starts) - 1:
        sizes = np.diff(starts)[places] if places else np.zeros(0, np.int64)
        data = np.concatenate([np.zeros(0, np.uint8), *[data[starts[i] : starts[i + 1]] for i in places]])
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words, edges = word_hashes(data, starts)
    every, out = _shingles(words, n), {}
    for i, a, b in zip(places, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        out[i] = np.unique(every[a : b - n + 1] if b - a >= n else _shingles(words[a:b], b - a) if b > a else words[a:b])
    return out


def widths(percent: int) -> list[tuple[int, float]]:
    """For each class of tokens how many neighbours a combination has, and how many combinations a token's worth of difference can break at most.

    Let a similar set lack x of a set's n tokens and hold y others: (n - x) / (n + y) >= p, so x + p * y <= n * (1 - p). Of combinations of k
    neighbours a lacking token breaks k and another token between them k - 1; so a unit of that budget breaks r = max(k, (k - 1) / p) at most. A class whose k could not
    outlast the budget takes a smaller one.
    """
    p, found = percent / 100, []
    for most in (1, 2, 3):
        k = max(k for k in range(1, most + 1) if k == 1 or max(k, (k - 1) / p) * (1 - p) < 0.9)
        found.append((k, max(float(k), (k - 1) / p)))
    return found


def size_edges(percent: int) -> np.ndarray:
    """Sizes that part bands: two sets of similar enough sizes are in the same band or in neighbouring ones."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(100 * edges[-1] // percent + 1)
    return np.array(edges)


def signatures(tokens: np.ndarray, frequency: np.ndarray, percent: int, rare: int = RARE, middle: int = MIDDLE) -> np.ndarray:
    """Index keys of a set, given its tokens' document frequencies (the same for all sets, at most 255).

    The prefix ends as soon as its singles and combinations are worth more than the budget of differences n * (1 - p): each is worth the
    share of the budget that it takes to break it (see :func:`widths`). So one of them is left in any similar set. Of two similar sets, the one whose prefix ends
    first gives the guarantee, as the other's prefix covers it. A set that ends before its prefix does (a handful of
    tokens, none of them rare) is covered whole by it and has its tokens as keys besides, for others of that kind.
    """
    n = len(tokens)
    order = np.lexsort((tokens, frequency))
    tokens, frequency = tokens[order], frequency[order]
    left = n * (100 - percent) / 100 + 1e-9
    ends = [0, *np.searchsorted(frequency, [rare, middle], side="right").tolist(), n]
    keys = []
    for kind, (k, worth) in enumerate(widths(percent)):
        mine = tokens[ends[kind] : ends[kind + 1]]
        need = int(left * worth) + 1
        some = mine[: need + k - 1]
        count = max(0, len(some) - k + 1)
        if k == 1:
            keys.append(B.mix(some[frequency[ends[kind] : ends[kind] + len(some)] > 1] ^ (np.uint64(0x51ED270B) + np.uint64(kind))))
        elif count:
            total = np.full(count, k, np.uint64)
            for i in range(k):
                total = B.mix(total * _K[0] + some[i : i + count])
            keys.append(total)
        if count >= need:
            break
        left -= count / worth
    else:
        keys.append(B.mix(tokens[frequency > 1] ^ np.uint64(0x2545F491)))
    return np.concatenate(keys)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets of shingles' digests."""
    small, large = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
    if 100 * small < percent * large:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def join_sets(sets: list[np.ndarray], percent: int, root: list[int] | None = None, across: np.ndarray | None = None) -> list[int]:
    """Components of sets under the exact test: for each set the least place it reaches.

    Sets are met in order of size through an inverted index over local prefixes; a set is not tested against one that it
    already hangs together with. ``root`` gives components known before: sets of the largest of them are met by others only. ``across`` is a side for
    each set, to test sets of different sides only.
    """
    count = len(sets)
    label = np.arange(count) if root is None else np.array(root, np.int64)
    if not count:
        return []
    sizes = np.array([len(s) for s in sets])
    _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    order = [i for i in np.lexsort((np.arange(count), sizes)).tolist() if sizes[i]]
    prefixes = {}
    for i in order:
        mine = inverse[ends[i] - sizes[i] : ends[i]]
        mine = mine[np.lexsort((mine, times[mine]))][: sizes[i] - -(-percent * sizes[i] // 100) + 1]
        prefixes[i] = mine[times[mine] > 1].tolist()
    main = np.zeros(count, bool) if root is None else label == np.bincount(label).argmax()
    every = _Postings(prefixes, order)
    others = every if root is None else _Postings(prefixes, [i for i in order if not main[i]])
    whole: list[np.ndarray] = []
    side = None if across is None else np.asarray(across)
    for i in order:
        near = (others if main[i] else every).of(prefixes[i])
        near = near[label[near] != label[i]]
        if side is not None:
            near = near[side[near] != side[i]]
        every.add(i)
        if others is not every and not main[i]:
            others.add(i)
        if not len(near):
            continue
        hits = np.bincount(near, minlength=count)
        near = np.flatnonzero(hits)
        near = near[np.argsort(-hits[near], kind="stable")]
        for _ in range(4):
            if not len(near):
                break
            j, near = near[0], near[1:]
            if linked(sets[i], sets[j], percent):
                label[label == max(label[i], label[j])] = min(label[i], label[j])
                near = near[label[near] != label[i]]
        if not len(near):
            continue
        # Many are left: what they share with the set is counted through the sets of all tokens at once.
        if not whole:
            whole = [np.repeat(np.arange(count), sizes)[np.argsort(inverse, kind="stable")], np.concatenate([[0], np.cumsum(times)])]
        mine = inverse[ends[i] - sizes[i] : ends[i]]
        common = np.bincount(np.concatenate([whole[0][whole[1][t] : whole[1][t + 1]] for t in mine.tolist()]), minlength=count)[near]
        for found in np.unique(label[near[100 * common >= percent * (sizes[i] + sizes[near] - common)]]).tolist():
            if found != label[i]:
                label[label == max(label[i], found)] = min(label[i], found)
    return label.tolist()


class _Postings:
    """For each token the sets added so far that have it in their prefix, room being made for all that will be."""

    def __init__(self, prefixes: dict[int, list[int]], sets: list[int]):
        self.prefixes = prefixes
        tokens, room = np.unique(np.array([t for i in sets for t in prefixes[i]], np.int64), return_counts=True)
        self.rows = np.empty(room.sum(), np.int64)
        self.begin = dict(zip(tokens.tolist(), (np.cumsum(room) - room).tolist(), strict=True))
        self.end = dict(self.begin)

    def add(self, i: int) -> None:
        for t in self.prefixes[i]:
            self.rows[self.end[t]] = i
            self.end[t] += 1

    def of(self, tokens: list[int]) -> np.ndarray:
        """The sets of all these tokens, once for each."""
        return np.concatenate([np.zeros(0, np.int64), *[self.rows[self.begin[t] : self.end[t]] for t in tokens if t in self.begin]])


def _classified(docs: DataFrame, percent: int, n: int, cluster: int, rare: int, middle: int, carry: list[str] | None = None) -> tuple[B.Blocks, DataFrame]:
    """The blocks of the documents, and ``uid, doc_id, n_shingles, comp`` of each; ``uid`` is a document's place, ``comp`` the same for all of a component."""
    spark = docs.sparkSession
    table = B.build(docs, carry=carry)

    def measure(batches):
        for block in B.rows(batches):
            sets = block_sets(block, n)
            sizes = [len(sets[i]) for i in range(len(sets))]
            digests = [xxhash.xxh3_128_digest(sets[i].tobytes()) if len(sets[i]) else None for i in range(len(sets))]
            places = block["block_id"] * (1 << 20) + np.arange(len(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), B.ids_of(block), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], ["uid", "doc_id", "n", "digest"])

    every = scratch.materialize(table.table.mapInArrow(measure, "uid long, doc_id long, n long, digest binary"), "sets")
    classes = scratch.materialize(every.where("digest is not null").groupBy("digest").agg(F.min("uid").alias("class"), F.count("*").alias("copies")), "digests")
    block_of = F.floor(F.col("class") / (1 << 20)).alias("block_id")
    place_of = F.pmod("class", F.lit(1 << 20)).cast("int").alias("at")
    # Places of the representatives of a block: at most its documents.
    chosen = scratch.materialize(classes.select(block_of, place_of).groupBy("block_id").agg(F.sort_array(F.collect_list("at")).alias("only")), "classes")

    def held(block: dict) -> tuple[dict[int, np.ndarray], np.ndarray]:
        sets = block_sets(block, n, block["only"] or [])
        return sets, np.concatenate([*sets.values(), np.zeros(0, np.uint64)])

    def hashes(block):
        values, times = np.unique(held(block)[1], return_counts=True)
        return values, np.minimum(times, 255).astype(np.uint8)

    codes = B.gathered(B.census(table.joined(chosen), hashes, B.parts_for(spark, table.bytes())))
    bands = size_edges(percent)

    def sign(batches):
        for block in B.rows(batches):
            sets, flat = held(block)
            if not sets:
                continue
            values, place = np.unique(flat, return_inverse=True)
            code = B.codes_of(block, len(values))[place]
            keys, owners, end = [], [], 0
            for i, tokens in sets.items():
                if len(tokens):
                    end += len(tokens)
                    found = signatures(tokens, code[end - len(tokens) : end], percent, rare, middle)
                    band = np.searchsorted(bands, len(tokens), side="right") + np.array([[0], [1]])
                    keys.append(B.mix(found + band.astype(np.uint64) * _K[1]).reshape(-1))
                    owners.append(np.full(2 * len(found), block["block_id"] * (1 << 20) + i))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners), pa.int64())], ["key", "uid"])

    signs = scratch.materialize(table.joined(chosen, codes).mapInArrow(sign, "key long, uid long"), "signatures")
    heads = scratch.materialize(signs.groupBy("key").agg(F.min("uid").alias("head"), F.count("*").alias("m")).where("m > 1"), "heads")
    edges = join_dealt(signs, heads, ["key"], "m", F.col("uid")).where("uid <> head").select(F.col("uid").alias("a"), F.col("head").alias("b")).distinct()
    clusters = scratch.materialize(graph.components(edges).join(every.select(F.col("uid").alias("node"), "n"), "node"), "clusters")

    sizes = clusters.groupBy("root").agg(F.count("*").alias("m"), F.sum(8 * F.col("n")).alias("bytes"), F.min("node").alias("first"))
    sizes = scratch.materialize(sizes.withColumn("cuts", F.ceil(F.greatest(F.col("m") / cluster, F.col("bytes") / CLUSTER_BYTES)).cast("int")).drop("bytes"), "sizes")
    wide = join_dealt(clusters, sizes, ["root"], "m", F.col("node")).withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    block_id, at = F.floor(F.col("node") / (1 << 20)).alias("block_id"), F.pmod("node", F.lit(1 << 20)).cast("int").alias("at")
    members = wide.select(block_id, F.struct(at, F.col("root"), F.col("cut"), F.col("cuts"), (F.col("node") == F.col("first")).alias("pivot")).alias("m"))
    members = members.groupBy("block_id").agg(F.sort_array(F.collect_list("m")).alias("members"))

    def send(batches):
        for block in B.rows(batches):
            if not block["members"]:
                continue
            sets = block_sets(block, n, [m["at"] for m in block["members"]])
            m = block["members"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["root"] for x in m], pa.int64()), pa.array([x["cut"] for x in m], pa.int32()), pa.array([x["cuts"] for x in m], pa.int32()), pa.array([x["pivot"] for x in m], pa.bool_()), pa.array([block["block_id"] * (1 << 20) + x["at"] for x in m], pa.int64()), pa.array([sets[x["at"]].tobytes() for x in m], pa.binary())],
                ["root", "cut", "cuts", "pivot", "uid", "tokens"],
            )

    sent = scratch.materialize(table.joined(members).mapInArrow(send, "root long, cut int, cuts int, pivot boolean, uid long, tokens binary"), "candidates")

    def read(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], pa.Table]:
        table = table.take(pa.array(np.argsort(table.column("uid").to_numpy(), kind="stable")))
        return table.column("uid").to_numpy(), [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()], table

    def links(ids: np.ndarray, roots: list[int]) -> pa.Table:
        roots_ = np.array(roots, np.int64)
        told = np.flatnonzero(roots_ != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[told], pa.int64()), "b": pa.array(ids[roots_[told]], pa.int64())})

    def within(key, table):
        ids, sets, _ = read(table)
        return links(ids, join_sets(sets, percent))

    spread = sent.where("pivot and cuts > 1").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    first = sent.where("not (pivot and cuts > 1)").unionByName(spread)
    found = scratch.materialize(first.groupBy("root", "cut").applyInArrow(within, "a long, b long"), "links")
    joined = scratch.materialize(graph.components(found), "joined")
    # Clusters that were cut and still fall into several components.
    split = sent.where("cuts > 1").select("root", "uid").join(joined.select(F.col("node").alias("uid"), F.col("root").alias("comp")), "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
    loose = split.groupBy("root").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    open_ = scratch.materialize(join_dealt(split, loose.select("root", "m"), ["root"], "m", F.col("uid")).select("uid", "comp"), "open")
    final = joined
    if open_.head(1):
        final = graph.components(found.unionByName(_by_key(signs, open_, sent, percent, cluster, read, links)))

    rows = join_dealt(every.where("digest is not null"), classes, ["digest"], "copies", F.col("uid"))
    rows = rows.join(final.select(F.col("node").alias("class"), F.col("root").alias("comp")), "class", "left").select("uid", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "class").alias("comp"), "digest")
    rows = rows.unionByName(every.where("digest is null").select("uid", "doc_id", F.col("n").alias("n_shingles"), F.col("uid").alias("comp"), "digest"))
    return table, scratch.materialize(rows, "rows")


def _by_key(signs: DataFrame, open_: DataFrame, sent: DataFrame, percent: int, cluster: int, read, links) -> DataFrame:
    """Links between sets of ``open_(uid, comp)`` that share a key but not their component.

    A key whose sets hang together already needs nothing more. The sets of any other meet; where they are too many for a task, they are cut
    into parts, and every two parts meet.
    """
    mine = scratch.materialize(signs.join(open_, "uid"), "open-keys")
    keys = mine.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", "m", F.ceil(F.col("m") / cluster).cast("int").alias("parts"))
    placed = join_dealt(mine, scratch.materialize(keys, "open-heads"), ["key"], "m", F.col("uid")).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = placed.select("key", "uid", "comp", "part", other).select("key", "uid", "comp", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))

    def meet(key, table):
        ids, sets, table = read(table)
        least: dict[int, int] = {}
        root = [least.setdefault(c, i) for i, c in enumerate(table.column("comp").to_pylist())]
        return links(ids, join_sets(sets, percent, root, table.column("part").to_numpy() if key[1].as_py() != key[2].as_py() else None))

    return scratch.materialize(met.join(sent.where("cuts > 1").select("uid", "tokens").dropDuplicates(["uid"]), "uid").groupBy("key", "x", "y").applyInArrow(meet, "a long, b long"), "links")


def similar_documents(docs: DataFrame, percent: int = 90, n: int = 3, cluster: int = CLUSTER, rare: int = RARE, middle: int = MIDDLE) -> DataFrame:
    """Components of documents whose sets of n-word shingles have a Jaccard similarity of at least ``percent`` / 100.

    Reads ``doc_id`` and ``text``, so other columns can't clash. Words are maximal runs without white space (space, 0x09-0x0D) after lower-casing
    A-Z; texts and words may be of any length. Fewer than n words are one shingle; a text without words, or null, has an empty set and links with
    nothing. Shingles are told apart by 64-bit digests of their words' digests. Returns a row for each row, repeated ones too: ``doc_id, n_shingles, component_id`` (least doc_id reachable, itself included; null
    only where all of a component's are). An empty table gives no rows. Equal sets are compared once. A cluster of more than ``cluster`` sets, or
    of more bytes than a task should hold, is cut into parts that share a pivot; only where they don't hang together after that are its
    sets joined key by key.
    """
    _, rows = _classified(docs, percent, n, cluster, rare, middle)
    least = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m"))
    return join_dealt(rows, least, ["comp"], "m", F.col("uid")).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, percent: int = 80, n: int = 5, cluster: int = CLUSTER, rare: int = RARE, middle: int = MIDDLE) -> DataFrame:
    """``docs`` with one document of each component of :func:`similar_documents`: the one with the least ``doc_id``, and one row of it if rows repeat.

    Rows that share a ``doc_id`` but not their set of shingles are different documents: one of each component stays. A null ``doc_id`` counts as the largest, and
    such rows without words all stay.
    All columns come back (those besides ``doc_id`` and ``text`` must be of types that JSON can hold). Texts are not shuffled.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    table, rows = _classified(docs, percent, n, cluster, rare, middle, carry)
    kept = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "uid", "digest")).alias("k")).select("k.uid", "k.doc_id", "k.digest")
    # A repeated row without words is a component of its own.
    kept = kept.groupBy("doc_id", "digest", F.when(F.col("doc_id").isNull(), F.col("uid")).alias("own")).agg(F.min("uid").alias("uid"))
    places = kept.select(F.floor(F.col("uid") / (1 << 20)).alias("block_id"), F.pmod("uid", F.lit(1 << 20)).cast("int").alias("at"))
    places = places.groupBy("block_id").agg(F.sort_array(F.collect_list("at")).alias("at"))

    def take(batches):
        for block in B.rows(batches):
            at, starts, data = block["at"] or [], block["starts"], block["data"].tobytes()
            extra = block["extra"] or [None] * len(block["ids"])
            yield pa.RecordBatch.from_arrays(
                [B.ids_of(block).take(pa.array(at, pa.int64())), pa.array([data[starts[i] : starts[i + 1]].decode("utf-8", "replace") for i in at], pa.string()), pa.array([extra[i] for i in at], pa.string())], ["doc_id", "text", "extra"]
            )

    out = table.joined(places, extra=True).mapInArrow(take, "doc_id long, text string, extra string")
    return table.restored(out, docs.columns)
