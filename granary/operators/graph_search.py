"""Graph search: a proximity graph built by neighbour-of-neighbour joins, and beam search over it for many queries at once.

The graph is a table, ``doc_id, neighbours``. It starts from the nearest within the leaves of a few trees of random cuts; in every round each node introduces the nodes that it links
with, in either direction, to one another, and all keep their nearest. Then links are thinned: one that leads to a node closer to an
earlier kept neighbour than to the node itself is left out, as the way over that neighbour gets there. A few random links per node keep far parts together.

A search walks the graph in rounds of joins. Each query keeps a beam, the best nodes so far; those it hasn't looked behind yet meet their links, the new
nodes meet their vectors and enter the beam if they are good enough. It ends when a round leaves nothing to look behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import text as T
from granary.operators.curate import _ensure_checkpoint
from granary.operators.retrieval import top

#: Vectors in a leaf of the start (on average), and in the list that a node introduces to one another.
BLOCK, INTRODUCED = 512, 48
#: Trees of the start, vectors that their cuts are fitted on, and nodes whose lists are handled in one call.
TREES, SAMPLE, TOGETHER = 4, 8192, 64
#: Nodes that a search may begin at: a sample of fixed size, the only thing that tasks get whole.
ENTRIES = 64


def _unit(table: pa.Table, column: str) -> np.ndarray:
    lists = table.column(column).combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


_LINKS = "doc_id long, other long, score double"


def _all_near(ids: np.ndarray, x: np.ndarray, keep: int) -> pa.Table:
    """For each of some vectors the nearest of the others."""
    scores = np.round(x @ x.T, 9)
    scores[ids[:, None] == ids[None, :]] = -np.inf
    k = min(keep, max(len(ids) - 1, 0))
    near = np.argpartition(-scores, k, axis=1)[:, :k] if k < len(ids) else np.argsort(-scores, axis=1)
    found = np.take_along_axis(scores, near, 1).ravel()
    rows = np.repeat(np.arange(len(ids)), k)[np.isfinite(found)]
    return pa.table({"doc_id": pa.array(ids[rows], pa.int64()), "other": pa.array(ids[near.ravel()[np.isfinite(found)]], pa.int64()), "score": pa.array(found[np.isfinite(found)])})


def _nearest_of(links: DataFrame, keep: int) -> DataFrame:
    # Dealt once by node, which serves the repeats and the ranks.
    ranked = links.repartition("doc_id").dropDuplicates(["doc_id", "other"]).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "other")))
    return ranked.where(F.col("r") <= keep).drop("r")


def _together(frame: DataFrame, by: str, count: int, run) -> DataFrame:
    """``run`` for the rows of each ``by``, many in one call."""

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by(by)
        keys = table.column(by).to_numpy()
        edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return pa.concat_tables([run(table.slice(a, e - a)) for a, e in zip(edges, [*edges[1:], len(keys)], strict=True)])

    return frame.groupBy(F.pmod(F.xxhash64(by), F.lit(max(1, -(-count // TOGETHER)))).alias("bucket")).applyInArrow(each, _LINKS)


def _cuts(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A tree of random cuts: for each inner node, the root at 1, a direction between two of its vectors and the middle of its vectors there."""
    lines, middles = np.zeros((1 << depth, x.shape[1])), np.zeros(1 << depth)
    held = {1: np.arange(len(x))}
    for node in range(1, 1 << depth):
        mine = held.pop(node)
        some = mine if len(mine) else np.arange(len(x))
        lines[node] = x[rng.choice(some)] - x[rng.choice(some)]
        places = x[mine] @ lines[node]
        middles[node] = np.median(places) if len(mine) else 0.0
        held[2 * node], held[2 * node + 1] = mine[places <= middles[node]], mine[places > middles[node]]
    return lines, middles


def _leaves(vectors: DataFrame, count: int, seed: int) -> DataFrame:
    """``vectors`` once for each of the :data:`TREES`, with ``tree, leaf, part``. Cuts are fitted on about :data:`SAMPLE` of them; a leaf of many vectors (copies, say) is dealt over parts."""
    depth = min(max(0, int(np.ceil(np.log2(max(1, count / BLOCK))))), 12)
    share = max(1, min(1 << 20, (1 << 20) * SAMPLE // max(1, count)))
    some = vectors.where(F.pmod(F.xxhash64("doc_id", F.lit(seed + 7)), F.lit(1 << 20)) < share).orderBy("doc_id").limit(2 * SAMPLE).collect()
    x = np.array([r["v"] for r in some], float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(x) else x
    trees = [_cuts(x, depth, np.random.default_rng(seed + t)) for t in range(TREES)] if len(x) and depth else []

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(pa.table({"v": batch.column(1)}), "v")
            for t, (lines, middles) in enumerate(trees):
                at = np.ones(len(x), np.int64)
                for _ in range(depth):
                    at = 2 * at + ((x * lines[at]).sum(1) > middles[at])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(x), t), pa.int32()), pa.array(at, pa.int32())], ["doc_id", "v", "tree", "leaf"])

    if not trees:
        blocks = max(1, -(-count // BLOCK))
        return vectors.select("*", F.lit(0).alias("tree"), F.lit(0).alias("leaf"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)).alias("part"))
    leaves = vectors.mapInArrow(place, "doc_id long, v array<double>, tree int, leaf int").checkpoint()
    sizes = leaves.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (4 * BLOCK)).alias("parts"))
    # A row for each leaf, of which there are at most TREES * 4,096.
    return leaves.join(F.broadcast(sizes), ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("parts")))


def neighbour_links(vectors: DataFrame, keep: int = 16, rounds: int = 12, settled: float = 0.002, seed: int = 1) -> DataFrame:
    """``doc_id, other, score``: for each of ``vectors(doc_id, v)`` about its ``keep`` nearest by cosine, found by rounds of introductions.

    A node introduces at most :data:`INTRODUCED` nodes, the nearest of those that link with it in either direction, so a node that a large share of all links lead to
    costs no more than others. An introduction is passed on only if it is nearer than the last of the links that a node has. Rounds end when fewer than ``settled`` of the links are new.
    """
    _ensure_checkpoint(vectors.sparkSession)
    vectors = vectors.where("doc_id is not null and v is not null").select("doc_id", "v").dropDuplicates(["doc_id"]).checkpoint()
    count = vectors.count()
    first = _leaves(vectors, count, seed).groupBy("tree", "leaf", "part").applyInArrow(lambda t: _all_near(t.column("doc_id").to_numpy(), _unit(t, "v"), keep), _LINKS)
    found = _nearest_of(first, keep).checkpoint()

    def introduce(table: pa.Table) -> pa.Table:
        links = _all_near(table.column("other").to_numpy(), _unit(table, "v"), keep)
        last = dict(zip(table.column("other").to_pylist(), table.column("last").to_pylist(), strict=True))
        return links.filter(pa.array(links.column("score").to_numpy() >= np.array([last[i] for i in links.column("doc_id").to_pylist()], float)))

    for _ in range(rounds):
        both = found.unionByName(found.select(F.col("other").alias("doc_id"), F.col("doc_id").alias("other"), "score"))
        known = _nearest_of(both, INTRODUCED).select(F.col("doc_id").alias("middle"), "other")
        last = found.groupBy("doc_id").agg(F.when(F.count("*") >= keep, F.min("score")).otherwise(-2.0).alias("last"))
        told = vectors.join(last, "doc_id", "left").select(F.col("doc_id").alias("other"), "v", F.coalesce("last", F.lit(-2.0)).alias("last"))
        new = _together(known.join(told, "other"), "middle", count, introduce)
        following = _nearest_of(found.unionByName(new), keep).checkpoint()
        changed = following.join(found.select("doc_id", "other"), ["doc_id", "other"], "left_anti").count()
        total = following.count()
        found = following
        if changed <= settled * total:
            break
    return found


def build_graph(vectors: DataFrame, degree: int = 16, keep: int = 32, random_links: int = 2, rounds: int = 12, seed: int = 1) -> DataFrame:
    """The graph of ``vectors(doc_id, v)``: ``doc_id, neighbours``, at most ``2 * degree + random_links`` each."""
    links = neighbour_links(vectors, keep, rounds, seed=seed)
    clean = vectors.where("doc_id is not null and v is not null").select("doc_id", "v").dropDuplicates(["doc_id"]).checkpoint()
    met = links.join(clean.withColumnRenamed("doc_id", "other"), "other")

    def thin(table: pa.Table) -> pa.Table:
        table = table.sort_by([("score", "descending"), ("other", "ascending")])
        x, score, ids = _unit(table, "v"), table.column("score").to_numpy(), table.column("other").to_numpy()
        near, kept = x @ x.T, []
        for i in range(len(ids)):
            if len(kept) < degree and all(near[i, j] <= score[i] for j in kept):
                kept.append(i)
        doc = table.column("doc_id")[0].as_py()
        return pa.table({"doc_id": pa.array([doc] * len(kept), pa.int64()), "other": pa.array(ids[kept], pa.int64()), "score": pa.array(score[kept])})

    thinned = _together(met, "doc_id", clean.count(), thin).checkpoint()
    # Ways back, so that every node can be reached: of a node that many lead to, those to its nearest.
    back = _nearest_of(thinned.select(F.col("other").alias("doc_id"), F.col("doc_id").alias("other"), "score"), degree)
    # Random links: the nodes of a random order lead to the next ones within blocks.
    far = clean.select("doc_id")
    size = max(1, -(-far.count() // BLOCK))
    for i in range(random_links):
        w = Window.partitionBy("b").orderBy(T.draw(seed + i, F.col("doc_id")), "doc_id")
        dealt = far.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1000 + seed + i)), F.lit(size)).alias("b"))
        more = dealt.select("doc_id", F.lead("doc_id").over(w).alias("other"), F.lit(-2.0).alias("score")).where("other is not null")
        back = back.unionByName(more)
    both = thinned.unionByName(back).dropDuplicates(["doc_id", "other"])
    return clean.select("doc_id").join(both.groupBy("doc_id").agg(F.collect_set("other").alias("neighbours")), "doc_id", "left").checkpoint()


def _scored(batches):
    """Rows of ``qid, doc_id, v, q`` and others with their cosine in place of the vectors."""
    for batch in batches:
        if batch.num_rows:
            v, q = (_unit(pa.table({"x": batch.column(i)}), "x") for i in (2, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.round((v * q).sum(1), 9)), *batch.columns[4:]], ["qid", "doc_id", "score", *batch.schema.names[4:]])


def beam_search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, widths: list[int], rounds: int = 200, seed: int = 1) -> DataFrame:
    """``width, qid, doc_id, score, rank, scored``: the ``k`` nearest found for ``queries(qid, q)`` with beams of each width, and how many vectors a query looked at.

    A query never finds its own id. Searches begin at the nearest of :data:`ENTRIES` sampled nodes.
    """
    spark = vectors.sparkSession
    _ensure_checkpoint(spark)
    vectors = vectors.where("doc_id is not null and v is not null").select("doc_id", "v").dropDuplicates(["doc_id"]).checkpoint()
    queries = queries.where("qid is not null and q is not null").select("qid", "q").dropDuplicates(["qid"]).checkpoint()
    # The sample: the first ids by a hash; tasks keep the first ENTRIES of theirs.
    entries = vectors.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(ENTRIES)
    widths_ = spark.createDataFrame([(w,) for w in widths], "width int")

    # A search is a row: the ids it has seen, and its beam in order, nodes with the negative score first.
    node = lambda done: F.struct((-F.col("score")).alias("far"), "doc_id", F.lit(done).alias("done"))
    # Fixed sizes on one side: the sampled nodes and the widths.
    start = queries.crossJoin(F.broadcast(entries.select("doc_id", "v"))).where("doc_id <> qid").select("qid", "doc_id", "v", "q")
    start = top(start.mapInArrow(_scored, "qid long, doc_id long, score double"), max(1, ENTRIES // 8))
    start = start.groupBy("qid").agg(F.sort_array(F.collect_list(node(False))).alias("beam")).crossJoin(F.broadcast(widths_))
    state = start.select("width", "qid", F.transform("beam", lambda x: x["doc_id"]).alias("seen"), F.slice("beam", 1, F.col("width")).alias("beam")).withColumn("looked", F.lit(ENTRIES).cast("long")).checkpoint()
    for _ in range(rounds):
        ahead = state.select("width", "qid", F.explode(F.filter("beam", lambda x: ~x["done"])["doc_id"]).alias("doc_id"))
        if not ahead.head(1):
            break
        met = ahead.join(graph, "doc_id").select("width", "qid", F.explode("neighbours").alias("other")).groupBy("width", "qid").agg(F.collect_set("other").alias("met"))
        new = met.join(state.select("width", "qid", "seen"), ["width", "qid"]).select("width", "qid", F.explode(F.array_except("met", "seen")).alias("doc_id")).where("doc_id <> qid")
        # A pair is scored once for all widths that meet it in a round.
        pairs = new.groupBy("qid", "doc_id").agg(F.collect_list("width").alias("widths")).join(vectors, "doc_id").join(queries, "qid")
        scored = pairs.select("qid", "doc_id", "v", "q", "widths").mapInArrow(_scored, "qid long, doc_id long, score double, widths array<int>")
        found = scored.select("qid", "doc_id", "score", F.explode("widths").alias("width")).groupBy("width", "qid").agg(F.collect_list(node(False)).alias("new"))
        known = F.transform("beam", lambda x: F.struct(x["far"].alias("far"), x["doc_id"].alias("doc_id"), F.lit(True).alias("done")))
        fresh = F.coalesce("new", F.slice("beam", 1, 0))
        state = state.join(found, ["width", "qid"], "left").select(
            "width", "qid", F.concat("seen", fresh["doc_id"]).alias("seen"), F.slice(F.sort_array(F.concat(known, fresh)), 1, F.col("width")).alias("beam"), (F.col("looked") + F.size(fresh)).alias("looked")
        ).checkpoint()
    else:
        raise RuntimeError("the search did not end")
    ranked = state.select("width", "qid", F.posexplode(F.slice("beam", 1, k)).alias("at", "n"), F.col("looked").alias("scored"))
    return ranked.select("width", "qid", "n.doc_id", (-F.col("n.far")).alias("score"), (F.col("at") + 1).alias("rank"), "scored")


def recall_curve(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``width, recall, scored``: mean share of the true neighbours found, and vectors looked at per query, for each beam width."""
    hits = found.join(truth.select("qid", "doc_id", F.lit(1).alias("hit")), ["qid", "doc_id"], "left")
    size = truth.groupBy("qid").agg(F.count("*").alias("m"))
    per = hits.groupBy("width", "qid").agg(F.count("hit").alias("h"), F.first("scored").alias("scored")).join(size, "qid")
    return per.groupBy("width").agg(F.round(F.avg(F.col("h") / F.col("m")), 6).alias("recall"), F.round(F.avg("scored"), 3).alias("scored"))
