"""Nearest neighbours by shifted space-filling curves.

Vectors are projected on a few random directions, several times with other directions and offsets; each time their place
on a Hilbert curve orders them. Spark range-partitions every ordering; a query looks at the rows within a window around its own
place. The candidates of all curves are merged and reranked on the original vectors.

How wide the window must be depends on the data, so it is measured: for some queries, taken by hash, the true neighbours are found by one pass over all
rows, and the distances between their places and the query's say which number of curves and which window reach the recall asked for
at the least cost. Clustered data needs narrow windows however many rows there are; vectors without structure need
windows that hold a share of all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch, vectors
from .deal import join_dealt

BITS = 10


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below ``2 ** bits`` (one row each)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest level
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve(number: int, dim: int, projected: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (as columns) and offset, in cells of the coarsest half, of one curve."""
    rng = np.random.default_rng([seed, number])
    axes, _ = np.linalg.qr(rng.standard_normal((dim, min(projected, dim))))
    return axes, rng.random(axes.shape[1])


def curve_keys(x: np.ndarray, spread: float, number: int, projected: int, seed: int) -> np.ndarray:
    axes, offset = curve(number, x.shape[1], projected, seed)
    scaled = 0.5 + (x @ axes) / (12 * spread) + (offset - 0.5) / 4
    return hilbert_keys(np.clip(scaled * (1 << BITS), 0, (1 << BITS) - 1))


def _best(ties: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, best first, ties to the smaller of ``ties``."""
    if len(ties) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= cut)
    else:
        rows = np.arange(len(ties))
    return rows[np.lexsort((ties[rows], -scores[rows]))[:k]]


_PART = "query long, ids array<long>, ties array<long>, scores array<double>"


def _parts(found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    return pa.table({n: pa.array([f[i] for f in found], t) for i, (n, t) in enumerate(zip(("query", "ids", "ties", "scores"), kinds, strict=True))})


def _score(query_ids, queries, ids, ties, x, k) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The k best rows of every query, with their inner products in double precision."""
    out = []
    for a in range(0, len(query_ids), 256):
        scores = queries[a : a + 256] @ x.T
        for j, row in enumerate(scores):
            top = _best(ties, row, k)
            exact = np.array([float(np.dot(queries[a + j], v)) for v in x[top]])
            out.append((int(query_ids[a + j]), ids[top], ties[top], exact))
    return out


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The k best of all parts of a query (a row each): its parts are a few short lists per curve and block."""
    flat = parts.select("query", F.explode(F.arrays_zip("ids", "ties", "scores")).alias("z")).groupBy("query", F.col("z.ids").alias("id"), F.col("z.ties").alias("tie")).agg(F.max("z.scores").alias("score"))
    ranked = flat.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "tie", "id")))
    return ranked.where(F.col("r") <= k).drop("r")


def _truth(classes: DataFrame, probes: list, dim: int, k: int) -> DataFrame:
    """The k best classes for each of a few probes, by one pass over all: a task keeps one short list per probe."""
    numbers = np.array([r["class"] for r in probes], np.int64)
    held = classes.sparkSession.sparkContext.broadcast(np.array([np.frombuffer(r["x"], np.float64) for r in probes]).reshape(-1, dim))

    def run(batches):
        best: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(numbers)
        for batch in batches:
            for i, (_, ids, ties, scores) in enumerate(_score(numbers, held.value, batch.column(0).to_numpy(), batch.column(1).to_numpy(), vectors.matrix(batch.column(2), dim), k)):
                a, b, c = (np.concatenate(p) for p in zip(best[i], (ids, ties, scores), strict=True))
                top = _best(b, c, k)
                best[i] = a[top], b[top], c[top]
        yield from _parts([(int(n), *b) for n, b in zip(numbers.tolist(), best, strict=True)]).to_batches()

    return _merged(classes.select("class", "least", "x").mapInArrow(run, _PART), k)


def choose_windows(distances: np.ndarray, recall: float, total: int, least: int = 2) -> tuple[int, int]:
    """Number of curves (``least`` or more) and half-window that reach a recall at the least cost; ``distances`` has a row for each pair of a query and its neighbour, a column for each curve."""
    ways = []
    for curves in range(min(least, distances.shape[1]), distances.shape[1] + 1):
        near = np.sort(distances[:, :curves].min(axis=1))
        half = int(near[max(0, int(np.ceil(recall * len(near))) - 1)]) if len(near) else 0
        ways.append((curves * min(2 * half + 1, total), curves, half))
    _, curves, half = min(ways)
    return curves, half


_RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(
    table: DataFrame, queries: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = 4, projected: int = 6, recall: float = 0.97, probes: int = 128, window: int | None = None, block: tuple[int, int] = (256, 8192), query_rows: int = 8192, seed: int = 7
) -> DataFrame:
    """The ``k`` nearest rows found, by inner product in double precision, for each row for which the SQL condition ``queries`` holds.

    Returns ``query_id, rank, vec_id, score``; nearest first, ties to the smaller id, never the query's own row; fewer than k if there
    are fewer candidates. Rows with null ids, and vectors that are null, zero, of another length than most, or with null or
    non-finite components take no part. Rows that repeat an id and its vector count once; rows with the same id and different vectors
    are rows of their own, as queries with a list each. Equal vectors are searched as one, with the k + 1 smallest of their ids (no more can
    be among k), so a vector that a third of the rows hold costs one row. An empty table gives no rows. Columns that neither the condition nor the two names
    mention are not read.

    ``recall``: the share of true neighbours that windows must have held for ``probes`` queries; at most ``curves`` curves are used. ``window`` states
    the number of places to either side instead; one as large as the table makes the search exact. ``block``: least and most rows scored in a task at once;
    ``query_rows``: queries in a task, about.
    """
    dim = vectors.dimension(table, vector_col)
    spark = table.sparkSession
    if not dim:
        return spark.createDataFrame([], _RESULT)
    wanted = F.coalesce(F.expr(queries).cast("int"), F.lit(0))
    rows = vectors.marked(table, id_col, vector_col, dim, wanted).where("x is not null").groupBy("id", "x").agg(F.max("c").alias("q"))
    rows = scratch.materialize(rows.withColumn("h", F.xxhash64("x")), "vectors")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("h", "x").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = first.groupBy("h", "x").agg(F.min("id").alias("least"), F.sort_array(F.collect_list("id")).alias("members"))
    asked = rows.where("q = 1").select("id", "h", "x")
    asking = asked.groupBy("h", "x").agg(F.count("*").alias("asks"))
    classes = classes.join(asking, ["h", "x"], "left").select(F.monotonically_increasing_id().alias("class"), "least", "members", "x", F.coalesce("asks", F.lit(0)).alias("asks"), "h")
    classes = scratch.materialize(classes, "classes")

    def moments(batches):
        for batch in batches:
            x = vectors.matrix(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array([float(len(x))]), pa.array([float((x * x).sum())]), pa.array([float((batch.column(1).to_numpy() > 0).sum())])], ["n", "s", "a"])

    n, squares, n_asked = classes.select("x", "asks").mapInArrow(moments, "n double, s double, a double").agg(F.sum("n"), F.sum("s"), F.sum("a")).first()
    if not n_asked:
        return spark.createDataFrame([], _RESULT)
    spread = float(np.sqrt(squares / n / dim)) or 1.0

    def keyed(batches):
        for batch in batches:
            x = vectors.matrix(batch.column(2), dim)
            for c in range(curves):
                keys = curve_keys(x, spread, c, projected, seed) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c), pa.int32()), pa.array(keys, pa.int64()), *batch.columns], ["curve", "key", *batch.schema.names])

    ordered = classes.select("class", "least", "x", (F.col("asks") > 0).alias("q")).mapInArrow(keyed, "curve int, key long, class long, least long, x binary, q boolean")
    parts = scratch.partitions(spark)
    ordered = ordered.repartitionByRange(parts, "curve", "key", "class").sortWithinPartitions("curve", "key", "class")

    def numbered(batches):
        from pyspark import TaskContext

        at, pid = 0, TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), pid), pa.int32()), pa.array(np.arange(at, at + len(batch)), pa.int64()), *batch.columns], ["pid", "at", *batch.schema.names])
            at += len(batch)

    ordered = scratch.materialize(ordered.mapInArrow(numbered, "pid int, at long, curve int, key long, class long, least long, x binary, q boolean"), "curves")
    # Rows before each range partition: as many rows as there are partitions.
    sizes = ordered.groupBy("pid").agg(F.count("*").alias("n")).orderBy("pid").collect()
    starts, before_all = [], 0
    for r in sizes:
        starts.append((r["pid"], before_all))
        before_all += r["n"]
    total = before_all // curves
    before = spark.createDataFrame(starts, "pid int, before long")
    ranked = ordered.join(F.broadcast(before), "pid").select("curve", (F.col("before") + F.col("at")).alias("place"), "class", "least", "x", "q")

    used, half = curves, window
    if window is None:
        some = classes.where("asks > 0").orderBy(F.xxhash64("h", F.lit(seed)), "h", "least").limit(probes).select("class", "x").collect()
        pairs = [(r["query"], r["id"]) for r in _truth(classes, some, dim, k + 1).select("query", "id").collect()]
        named = spark.createDataFrame([(c,) for c in sorted({c for p in pairs for c in p})], "class long")  # at most probes * (k + 2) rows
        places: dict[int, list[int]] = {}
        for r in ranked.select("curve", "place", "class").join(F.broadcast(named), "class").collect():
            places.setdefault(r["class"], [0] * curves)[r["curve"]] = r["place"]
        apart = np.array([[abs(a - b) for a, b in zip(places[q], places[i], strict=True)] for q, i in pairs if q != i]).reshape(-1, curves)
        used, half = choose_windows(apart, recall, total)
    rows_at_once = int(np.clip(half // 8, *block))
    reach = min(-(-half // rows_at_once), -(-total // rows_at_once))
    met = n_asked / max(total, 1) * rows_at_once * (2 * reach + 1)  # queries that meet a block
    groups = max(1, int(-(-met // query_rows)))
    ranked = ranked.where(F.col("curve") < used).withColumn("block", F.floor(F.col("place") / rows_at_once))
    near_blocks = F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)).alias("block")
    around = ranked.where("q").select("curve", near_blocks, F.pmod(F.xxhash64("class"), F.lit(groups)).cast("int").alias("g"), "class", "least", "x", F.lit(True).alias("q"))
    both = ranked.select("curve", "block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "class", "least", "x", F.lit(False).alias("q")).unionByName(around)

    def windows(key, table):
        q = table.column("q").to_numpy()
        if not q.any() or q.all():
            return _parts([])
        x, ids, ties = vectors.matrix(table.column("x"), dim), table.column("class").to_numpy(), table.column("least").to_numpy()
        return _parts(_score(ids[q], x[q], ids[~q], ties[~q], x[~q], k + 1))

    near = _merged(both.groupBy("curve", "block", "g").applyInArrow(windows, _PART), k + 1)
    # Back to rows: each query row gets the members of the classes nearest to its class.
    members = classes.select(F.col("class").alias("id"), "members")
    lists = near.join(members, "id").groupBy("query").agg(F.collect_list(F.struct("score", F.col("id").alias("class"), "members")).alias("near"))
    lists = scratch.materialize(lists.join(classes.where("asks > 0").select(F.col("class").alias("query"), "asks", "h", "x"), "query"), "windows")
    wide = join_dealt(asked, lists, ["h", "x"], "asks", F.col("id")).select(F.col("id").alias("query_id"), "query", F.explode("near").alias("n"))
    wide = wide.select("query_id", "query", F.col("n.class").alias("class"), F.col("n.score").alias("score"), F.explode("n.members").alias("vec_id")).where("vec_id <> query_id or class <> query")
    final = wide.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
