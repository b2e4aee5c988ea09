"""Near-duplicate vectors by a forest of random projection trees.

A tree splits the space by recursive random hyperplanes at the median; a vector close to a border goes down
both sides (spill). Vectors of the same label that share a leaf in any of the trees are compared exactly. A pair
is counted in the first tree, and there in the first leaf, that its vectors share, so no list of pairs is
ever needed: a leaf returns sums per vector and a spanning star of its links.

The upper levels of the trees are fitted on a bounded sample, a label going down as many of them as its size asks for; a label that fits a leaf
is one, in one tree. Leaves that are still too large for a task are split level by level at their own medians, which Spark counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, scratch, vectors
from .deal import join_dealt


class Tree:
    """A random projection tree over unit vectors: at each inner node a direction and a threshold."""

    def __init__(self, sample: np.ndarray, depth: int, spill: float, rng: np.random.Generator):
        self.depth, dim = depth, sample.shape[1]
        inner = (1 << depth) - 1
        self.axes, self.cuts, self.margins = np.zeros((inner, dim)), np.zeros(inner), np.zeros(inner)
        rows = {0: np.arange(len(sample))}
        for node in range(inner):
            mine = rows.pop(node, np.zeros(0, int))
            axis = rng.standard_normal(dim)
            axis /= np.linalg.norm(axis)
            places = sample[mine] @ axis if len(mine) else np.zeros(1)
            self.axes[node], self.cuts[node], self.margins[node] = axis, np.median(places), spill / np.sqrt(dim)
            if 2 * node + 1 < inner:
                left = places <= self.cuts[node]
                rows[2 * node + 1], rows[2 * node + 2] = (mine[left], mine[~left]) if len(mine) else (mine, mine)

    def leaves(self, x: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the nodes in which they end, each row after as many levels as ``depths`` says; a row may have several nodes."""
        rows, nodes, done = np.arange(len(x)), np.zeros(len(x), np.int64), []
        for level in range(self.depth + 1):
            ends = depths[rows] <= level
            done.append((rows[ends], nodes[ends]))
            rows, nodes = rows[~ends], nodes[~ends]
            if level == self.depth or not len(rows):
                break
            away = np.einsum("ij,ij->i", x[rows], self.axes[nodes]) - self.cuts[nodes]
            left, right = away <= self.margins[nodes], away >= -self.margins[nodes]
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
        return np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done])


def _axis(seed: int, tree: int, label: int, node: int, dim: int) -> np.ndarray:
    """The direction of a node below the fitted levels."""
    axis = np.random.default_rng([seed, tree, label & ((1 << 63) - 1), node]).standard_normal(dim)
    return axis / np.linalg.norm(axis)


_NONE = (1 << 63) - 1


def _share_leaf(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of leaf lists padded with -1: whether they share a leaf, and the least leaf shared (else a large number)."""
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)
    least = np.where(same, a[:, :, None], _NONE).min(axis=(1, 2))
    return least < _NONE, least


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of ``n`` by the links."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        open_ = root[a] != root[b]
        if not open_.any():
            break
    return root


def _unit(column, dim: int) -> np.ndarray:
    x = vectors.matrix(column, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_LEAF = ["tree", "c", "node"]


def _deepened(spots: DataFrame, classes: DataFrame, dim: int, spill: float, block_rows: int, seed: int) -> DataFrame:
    """``spots(tree, c, node, class)`` with leaves of more than ``block_rows`` split, level by level, until a split no longer parts them."""
    margin = spill / np.sqrt(dim)
    stuck = None
    while True:
        big = spots.groupBy(*_LEAF).agg(F.count("*").alias("m")).where((F.col("m") > block_rows) & (F.col("node") < 1 << 60))
        big = scratch.materialize(big if stuck is None else big.join(stuck, _LEAF, "left_anti"), "big-leaves")
        if not big.head(1):
            return spots

        def project(batches):
            for batch in batches:
                unit = _unit(batch.column(4), dim)
                tree, label, node = (batch.column(i).to_numpy() for i in range(3))
                kinds, which = np.unique(np.stack([tree, label, node]), axis=1, return_inverse=True)
                axes = np.array([_axis(seed, *kind, dim) for kind in kinds.T.tolist()]).reshape(-1, dim)
                away = np.einsum("ij,ij->i", unit, axes[which.reshape(-1)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(away)], [*_LEAF, "class", "away"])

        mine = join_dealt(spots, big, _LEAF, "m", F.col("class")).drop("m").join(classes.select("class", "x"), "class").select(*_LEAF, "class", "x")
        placed = scratch.materialize(mine.mapInArrow(project, "tree int, c long, node long, class long, away double"), "projected")
        cuts = scratch.materialize(placed.groupBy(*_LEAF).agg(F.percentile_approx("away", 0.5, 1000).alias("cut"), F.count("*").alias("m")), "cuts")
        sides = join_dealt(placed, cuts, _LEAF, "m", F.col("class"))
        child = F.explode(F.array_compact(F.array(F.when(F.col("away") <= F.col("cut") + margin, 2 * F.col("node") + 1), F.when(F.col("away") >= F.col("cut") - margin, 2 * F.col("node") + 2)))).alias("child")
        halves = scratch.materialize(sides.select(*_LEAF, "class", "m", child), "halves")
        held = halves.groupBy(*_LEAF, "child").agg(F.count("*").alias("n"), F.first("m").alias("m")).groupBy(*_LEAF).agg((F.max("n") > 0.9 * F.first("m")).alias("stays"), F.first("m").alias("m"))
        held = scratch.materialize(held, "splits")
        again = held.where("stays").select(*_LEAF)
        stuck = again if stuck is None else scratch.materialize(stuck.unionByName(again), "stuck")
        parted = held.where("not stays").select(*_LEAF, "m")
        rest = join_dealt(spots, parted.withColumn("split", F.lit(True)), _LEAF, "m", F.col("class"), "left").where("split is null").select(*_LEAF, "class")
        come = join_dealt(halves.drop("m"), parted, _LEAF, "m", F.col("class")).select("tree", "c", F.col("child").alias("node"), "class")
        following = scratch.materialize(rest.unionByName(come), "leaves")
        scratch.discard(spots, placed, cuts, halves, big)
        spots = following


def near_duplicates(
    table: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", trees: int = 4, leaf_rows: int = 32, spill: float = 0.2, sample_rows: int = 20_000, block_rows: int = 4096, seed: int = 11
) -> DataFrame:
    """Links between vectors of equal label with a cosine of at least ``threshold``, and their components.

    Returns a row for each row of ``table``, repeated ones too: the id, ``n_links`` (other vectors linked directly), ``component_id`` (least id
    reachable, itself included) and ``kept`` (the id is the component's). Rows with a null label or a vector that is null, zero, of another
    length than most, or has null or non-finite components link with nothing, whatever other rows hold their id. A null id gives null columns. Equal
    vectors of a label are compared once and counted by their number. An empty table gives no rows. Only the three columns named are read, so others can't clash. The
    upper levels of the trees are fitted on about ``sample_rows`` vectors, taken by hash; every row is indexed.
    """
    spark = table.sparkSession
    dim = vectors.dimension(table, vector_col)
    out = [F.col("id").alias(id_col), "n_links", F.col("component_id"), (F.col("id") == F.col("component_id")).alias("kept")]
    alone = [F.col("id"), F.when(F.col("id").isNotNull(), F.lit(0)).cast("long").alias("n_links"), F.col("id").alias("component_id")]
    if not dim:
        return table.select(F.col(id_col).cast("long").alias("id")).select(*alone).select(*out)
    every = scratch.materialize(vectors.marked(table, id_col, vector_col, dim, F.col(label_col)).withColumn("h", F.xxhash64("x")), "vectors")
    rows, lone = every.where("x is not null"), every.where("x is null").select(*alone)
    classes = rows.groupBy("h", "c", "x").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = scratch.materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    labels = scratch.materialize(classes.groupBy("c").agg(F.count("*").alias("m")), "labels")
    count, widest = labels.agg(F.sum("m"), F.max("m")).first()
    if not count:
        return lone.select(*out)
    depth = 0
    if widest > leaf_rows:
        share = max(1, min(1 << 20, (1 << 20) * sample_rows // count))
        taken = classes.where(F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 20)) < share).select("x").collect()
        sample = np.array(sorted([np.frombuffer(r[0], np.float64).tolist() for r in taken])).reshape(-1, dim)
        if not len(sample):
            sample = np.eye(1, dim)
        sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        depth = int(np.clip(np.ceil(np.log2(widest / leaf_rows)), 0, max(0, int(np.log2(len(sample) / 4 + 1)))))
    forest = [Tree(sample, depth, spill, np.random.default_rng([seed, t])) for t in range(trees)] if depth else []
    held = spark.sparkContext.broadcast(forest)  # trees * 2 ** depth directions; depth is bounded by the sample

    def planted(batches):
        for batch in batches:
            number, label, depths = (batch.column(i).to_numpy() for i in range(3))
            shallow = np.flatnonzero(depths == 0)  # all of the label: one leaf
            spots = [(0, shallow, np.zeros(len(shallow), np.int64))]
            deep = np.flatnonzero(depths > 0)
            if len(deep):
                unit = _unit(batch.column(3).take(pa.array(deep)), dim)
                for t, tree in enumerate(held.value):
                    r, node = tree.leaves(unit, depths[deep])
                    spots.append((t, deep[r], node))
            for t, r, node in spots:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), t), pa.int32()), pa.array(label[r]), pa.array(node, pa.int64()), pa.array(number[r])], [*_LEAF, "class"])

    levels = F.least(F.lit(depth), F.greatest(F.lit(0), F.ceil(F.log2(F.col("m") / leaf_rows)).cast("int"))).cast("int").alias("depth")
    sized = join_dealt(classes.select("class", "c", "x"), labels, ["c"], "m", F.col("class")).select("class", "c", levels, "x")
    spots = scratch.materialize(sized.mapInArrow(planted, "tree int, c long, node long, class long"), "leaves")
    spots = _deepened(spots, classes, dim, spill, block_rows, seed)
    # The leaves of a vector: a few in each tree.
    lists = spots.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("tree", "node"))).alias("spots"))
    members = classes.select("class", "n", "x").join(lists, "class")
    # A leaf beyond block_rows, whose vectors no split parts, is cut into blocks, and every two of its blocks meet in a task of their own.
    sizes = scratch.materialize(spots.groupBy(*_LEAF).agg(F.count("*").alias("m")).where(F.col("m") > block_rows), "sizes")
    blocks = F.coalesce(F.ceil(F.col("m") / block_rows).cast("int"), F.lit(1))
    cut = join_dealt(spots, sizes, _LEAF, "m", F.col("class"), "left").withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    tasks = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*_LEAF, "class", "b", F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi")).join(members, "class")

    def compare(key, table):
        tree, leaf, lo, hi = key[0].as_py(), key[2].as_py(), key[3].as_py(), key[4].as_py()
        table = table.take(pa.array(np.argsort(table.column("class").to_numpy(), kind="stable"))).combine_chunks()
        ids, n, b = table.column("class").to_numpy(), table.column("n").to_numpy(), table.column("b").to_numpy()
        unit = _unit(table.column("x"), dim)
        spots = _spots(table.column("spots").chunk(0), tree) if len(ids) else np.zeros((0, 1, 1), np.int64)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        left = np.flatnonzero(b == lo)
        right = np.flatnonzero(b == hi)
        for at in range(0, len(left), 512):
            mine = left[at : at + 512]
            i, j = np.nonzero(unit[mine] @ unit[right].T >= threshold)
            i, j = mine[i], right[j]
            pairs = i < j if lo == hi else i != j
            i, j = i[pairs], j[pairs]
            for s in range(0, len(i), 50_000):
                p, q = i[s : s + 50_000], j[s : s + 50_000]
                first = np.ones(len(p), bool)
                if spots.shape[1:] != (1, 1):
                    for t in range(tree):
                        first &= ~_share_leaf(spots[p, t], spots[q, t])[0]
                    first &= _share_leaf(spots[p, tree], spots[q, tree])[1] == leaf
                np.add.at(links, p[first], n[q[first]])
                np.add.at(links, q[first], n[p[first]])
                root = _roots(len(ids), np.concatenate([p, np.arange(len(ids))]), np.concatenate([q, root]))
        told = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.table({"class": pa.array(ids[told], pa.int64()), "links": pa.array(links[told], pa.int64()), "root": pa.array(ids[root[told]], pa.int64())})

    found = scratch.materialize(tasks.groupBy(*_LEAF, "lo", "hi").applyInArrow(compare, "class long, links long, root long"), "links")
    scratch.discard(spots, sizes)
    joined = graph.components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    per_class = classes.join(links, "class", "left").join(joined, "class", "left").select("h", "c", "x", "least", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root"))
    per_class = scratch.materialize(per_class, "classes")
    least = per_class.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    known = join_dealt(per_class, least, ["root"], "m", F.col("h")).select("h", "c", "x", "n", "n_links", "component_id")
    valid = join_dealt(rows.select("id", "h", "c", "x"), known, ["h", "c", "x"], "n", F.col("id"), counts=per_class).select("id", "n_links", "component_id")
    return valid.unionByName(lone).select(*out)


def _spots(lists: pa.ListArray, tree: int) -> np.ndarray:
    """Leaves of every row by tree, up to ``tree``, padded with -1."""
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    kinds, nodes = flat.field("tree").to_numpy(), flat.field("node").to_numpy()
    owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
    keep = kinds <= tree
    kinds, nodes, owner = kinds[keep], nodes[keep], owner[keep]
    group = owner * (tree + 1) + kinds  # lists are sorted by tree and node
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    nth = np.arange(len(group)) - np.repeat(begins, np.diff([*begins.tolist(), len(group)]))
    out = np.full((len(lists), tree + 1, int(nth.max(initial=0)) + 1), -1, np.int64)
    out[owner, kinds, nth] = nodes
    return out
