"""Corpus curation: filters, mixtures, decontamination, near-duplicate removal and their statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import text as T


#: Hashes of n-grams, 8 bytes each, are broadcast up to this number.
BROADCAST_HASHES = 2_000_000
#: Hashes of n-grams that are counted in one call, about.
COUNTED = 2_000_000


def filter_license(docs: DataFrame, allowed: list[str], column: str = "license") -> DataFrame:
    return docs.where(F.col(column).isin(allowed))


def filter_language(docs: DataFrame, allowed: tuple[str, ...] = ("en",)) -> DataFrame:
    return docs.where(T.language(F.col("text")).isin(*allowed))


def filter_quality(docs: DataFrame) -> DataFrame:
    return docs.where(T.quality_ok(F.col("text")))


def scrub_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", T.scrub(F.col("text")))


def with_license(docs: DataFrame, source: str = "source") -> DataFrame:
    """A license per document, derived from the number at the end of its source."""
    n = F.regexp_extract(F.col(source), r"(\d+)$", 1).try_cast("int")
    return docs.withColumn("license", F.when(n % 4 == 0, "cc-by-4.0").when(n % 4 == 1, "mit").when(n % 4 == 2, "proprietary").otherwise("apache-2.0"))


def mixture(sources: dict[str, tuple[DataFrame, float]], n_docs: int, seed: int) -> DataFrame:
    """``n_docs`` weighted draws with replacement over sources; each draw takes the next document of its source, beginning anew at its end.

    Deterministic for a seed. ``sources``: name to (documents with ``doc_id``, weight). An empty source is an error if it is drawn.
    """
    spark = next(iter(sources.values()))[0].sparkSession
    total = sum(w for _, w in sources.values())
    u = (T.draw(F.col("draw"), seed) % 1_000_000_007) / 1_000_000_007.0
    pick: Column | None = None
    acc = 0.0
    for name, (_, weight) in sources.items():
        acc += weight / total
        pick = F.when(u < acc, name) if pick is None else pick.when(u < acc, name)
    draws = spark.range(n_docs).withColumnRenamed("id", "draw").withColumn("source_name", pick.otherwise(name))
    from granary.operators.packing import prefix_sums

    # A source's draws and documents are numbered by prefix sums, so a source of any size is no task of its own.
    numbered = lambda rows, order, name: prefix_sums(rows.withColumn("one", F.lit(1)), order=order, value="one").withColumnRenamed("start", name).drop("one")
    out = None
    for name, (docs, _) in sources.items():
        mine = numbered(draws.where(F.col("source_name") == name), "draw", "k")
        pool = numbered(docs.select("doc_id", "text"), "doc_id", "pos")
        size = F.broadcast(docs.agg(F.count("*").alias("cnt")))
        placed = mine.crossJoin(size).withColumn("pos", F.when(F.col("cnt") == 0, F.raise_error(F.lit("empty source"))).otherwise(F.pmod("k", "cnt")))
        part = placed.join(pool, "pos").select("draw", "source_name", "doc_id", "text")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, evals: DataFrame, n: int = 13) -> DataFrame:
    """Documents that share no word n-gram with the evaluation texts.

    Only a hash of each distinct n-gram of the evaluation set travels; Spark broadcasts it if it is small. A hash that
    meets is confirmed on the n-gram itself.
    """
    return docs.join(contaminated_ids(docs, evals, n), "doc_id", "left_anti")


def _holding(words: DataFrame, evals: DataFrame, n: int) -> DataFrame:
    """The rows of ``words(.., w)`` that may share an n-gram with the texts of ``evals``: a superset, told by hashes of n words in a row.

    Words are numbered by the vocabulary of the evaluation texts, if those have no more than ``BROADCAST_HASHES`` words; else every row is returned.
    """
    wanted = evals.select(T.words(F.col("text")).alias("w")).where(F.size("w") >= n)
    if (wanted.agg(F.sum(F.size("w")).alias("n")).first()["n"] or 0) > BROADCAST_HASHES:
        return words
    texts = [r["w"] for r in wanted.collect()]
    vocabulary = sorted({w for t in texts for w in t})
    factors = [pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(n)]
    place = {w: i for i, w in enumerate(vocabulary)}

    def hashes(ids: np.ndarray) -> np.ndarray:
        ids = (ids + 1).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        ids ^= ids >> np.uint64(29)
        out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for i, f in enumerate(factors):
            out += ids[i : i + len(out)] * np.uint64(f)
        return out

    sought = np.unique(np.concatenate([np.zeros(0, np.uint64), *[hashes(np.array([place[w] for w in t])) for t in texts]]))
    at = words.columns.index("w")

    def run(batches):
        values = pa.array(vocabulary, pa.string())
        for batch in batches:
            w = batch.column(at)
            sizes = pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(w)), sizes)
            ids = pc.fill_null(pc.index_in(w.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            mask = np.zeros(len(w), bool)
            if len(ids) >= n:
                met = np.flatnonzero(np.isin(hashes(ids), sought))
                mask[row[met[row[met] == row[met + n - 1]]]] = True
            if mask.any():
                yield batch.filter(pa.array(mask))

    return words.mapInArrow(run, words.schema)


def word_ngrams(docs: DataFrame, keys: list[str], n: int, evals: DataFrame | None = None) -> DataFrame:
    """Distinct word n-grams of each text as ``g``; with ``evals`` only of texts that may share one with those, so that few are written out.

    Words are a column of their own, or every n-gram would split the text again; and the outer form of explode keeps Spark from
    inferring a filter on the array's size, which it would push below that column.
    """
    words = docs.select(*keys, T.words(F.col("text")).alias("w"))
    if evals is not None:
        words = _holding(words, evals, n)
    return words.select(*keys, F.explode_outer(F.array_distinct(T.ngrams(F.col("w"), n))).alias("g")).where("g is not null")


def contaminated_ids(docs: DataFrame, evals: DataFrame, n: int = 13) -> DataFrame:
    grams = word_ngrams(evals, [], n).distinct().withColumn("h", F.xxhash64("g"))
    mine = word_ngrams(docs, ["doc_id"], n, evals).withColumn("h", F.xxhash64("g"))
    hashes = grams.select("h").distinct()
    if hashes.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
        mine = mine.join(F.broadcast(hashes), "h", "left_semi")  # so the n-grams that travel are those that meet
    return mine.join(grams, ["h", "g"], "left_semi").select("doc_id").distinct()


def removal_stats(total: DataFrame, kept: DataFrame) -> DataFrame:
    """``total, kept, removed, ratio``."""
    both = total.agg(F.count("*").alias("total")).crossJoin(kept.agg(F.count("*").alias("kept")))
    return both.select("total", "kept", (F.col("total") - F.col("kept")).alias("removed"), F.coalesce(F.try_divide(F.col("total") - F.col("kept"), F.col("total")), F.lit(0.0)).alias("ratio"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """First document of each text: ``doc_id, copies``."""
    return docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def _gram_sets(words: DataFrame, n: int) -> DataFrame:
    """``doc_id, s``: the sorted hashes of the distinct word n-grams of ``words(doc_id, w)``. A hash is made of 64-bit digests of the n words, so no n-gram is written out as a text."""
    mix = lambda h: (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(at, 2_048) for at in range(0, whole.num_rows, 2_048)):
                w = batch.column(1)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False))
                coded = w.flatten().dictionary_encode()
                digests = np.array([xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)[coded.indices.to_numpy()]
                grams = np.zeros(max(0, len(digests) - n + 1), np.uint64)
                for i in range(n):
                    grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + digests[i : i + len(grams)])
                grams = mix(grams ^ (grams >> np.uint64(29))).view(np.int64)
                sets = [np.unique(grams[a : max(a, b - n + 1)]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                edges = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(sets)))], ["doc_id", "s"])

    return words.mapInArrow(run, f"doc_id {words.schema['doc_id'].dataType.simpleString()}, s array<long>")


def _shared(sets: DataFrame) -> DataFrame:
    """``doc_id, t, df``: the hashes of ``sets(doc_id, s)`` that more than one set holds. They travel in lists, by ranges of their values, and are sorted in arrays."""
    parts = max(1, -(-(sets.agg(F.sum(F.size("s")).alias("n")).first()["n"] or 0) // COUNTED))
    kind = sets.schema["doc_id"].dataType.simpleString()

    def deal(batches):
        for whole in batches:
            for batch in (whole.slice(at, 2_048) for at in range(0, whole.num_rows, 2_048)):
                tokens = batch.column(1).flatten().to_numpy()
                part = (tokens.view(np.uint64) >> np.uint64(32)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy())[order]
                begin = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)) if len(order) else np.zeros(0, np.int64)
                edges = pa.array([*begin.tolist(), len(order)], pa.int32())
                lists = [pa.ListArray.from_arrays(edges, x) for x in (batch.column(0).take(pa.array(rows)), pa.array(tokens[order]))]
                yield pa.RecordBatch.from_arrays([pa.array(part[order][begin].astype(np.int64)), *lists], ["part", "ids", "tokens"])

    def count(table: pa.Table) -> pa.Table:
        ids, tokens = (pa.chunked_array([x.flatten() for x in table.column(c).chunks]) for c in ("ids", "tokens"))
        tokens = tokens.to_numpy()
        order = np.argsort(tokens)
        times = np.diff(np.append(np.flatnonzero(np.append(True, np.diff(tokens[order]) != 0)), len(order)))
        df = np.repeat(times, times)
        order, df = order[df > 1], df[df > 1]
        return pa.table({"doc_id": ids.take(pa.array(order)), "t": tokens[order], "df": df})

    return sets.mapInArrow(deal, f"part long, ids array<{kind}>, tokens array<long>").groupBy("part").applyInArrow(count, f"doc_id {kind}, t long, df long")


def near_duplicate_pairs(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """Pairs of documents whose sets of word n-grams have a Jaccard similarity of at least ``threshold``: ``a, b, similarity`` with ``a < b``.

    Of documents with equal sets the one with the least ``doc_id`` stands for all: it is paired with each of them, and with the representatives of
    similar sets, so that m copies give m - 1 pairs. What is kept of near duplicates doesn't follow from these pairs alone, see :func:`first_of_near_duplicates`.
    """
    links, copies = _near_duplicates(docs, threshold, n)
    return links.unionByName(copies)


def first_of_near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """Documents kept in order of ``doc_id``: one is kept unless an earlier *kept* one has a similarity of at least ``threshold``, over all pairs, those of copies included.

    Documents with equal sets are similar to the same others and to each other. So the first of them is judged by the first ones of other sets, and
    every later one goes: after the first if that is kept, or else after the kept document that the first went for. No copy is ever kept, so none takes another away.
    """
    links, copies = _near_duplicates(docs, threshold, n)
    return keep_first(docs, links).join(copies.select(F.col("b").alias("doc_id")), "doc_id", "left_anti")


def _near_duplicates(docs: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """The similar pairs among the first documents of each set, and the pairs of each first document with its copies: ``a, b, similarity``.

    Prefix filter: of a set of m n-grams, ordered by frequency, the first m - ceil(threshold * m) + 1 must
    meet those of a partner. Those that no other set holds come first and meet none, so only their number counts: all n-grams travel once, to be counted, and then the others. Candidates are verified
    on whole sets, of which only theirs travel. Sets are written once, to the session's
    checkpoint folder; n-grams are told by 64 bits, equal sets by 128.
    """
    _ensure_checkpoint(docs.sparkSession)
    every = _gram_sets(docs.select("doc_id", T.words(F.col("text")).alias("w")), n).where("size(s) > 0")
    every = every.select("doc_id", "s", F.xxhash64("s").alias("h"), F.xxhash64(F.lit(1), "s").alias("i")).checkpoint()
    first = every.groupBy("h", "i").agg(F.min("doc_id").alias("a"))
    copies = every.select("doc_id", "h", "i").join(first, ["h", "i"]).where("doc_id > a").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity")).checkpoint()
    few = lambda ids: F.broadcast(ids) if ids.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES else ids
    sets = every.where("doc_id is not null").join(few(copies.select(F.col("b").alias("doc_id"))), "doc_id", "left_anti").select("doc_id", "s")
    shared = _shared(sets)
    sizes = sets.select("doc_id", F.size("s").alias("m"))
    own = Window.partitionBy("doc_id")
    ranked = shared.withColumn("r", F.row_number().over(own.orderBy("df", "t"))).withColumn("held", F.count("*").over(own)).join(sizes, "doc_id")
    prefix = ranked.where(F.col("r") + F.col("m") - F.col("held") <= F.col("m") - F.ceil(F.col("m") * threshold) + 1).select("doc_id", "m", "t").checkpoint()
    other = prefix.select(F.col("doc_id").alias("b"), F.col("m").alias("mb"), "t")
    pairs = prefix.withColumnRenamed("doc_id", "a").join(other, "t").where("a < b").where((F.col("m") >= threshold * F.col("mb")) & (F.col("mb") >= threshold * F.col("m"))).select("a", "b").distinct().checkpoint()
    met = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = sets.join(few(met), "doc_id", "left_semi")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", T.jaccard(F.col("sa"), F.col("sb")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold), copies


def keep_first(docs: DataFrame, pairs: DataFrame, small: int = 200_000) -> DataFrame:
    """Documents kept in order of ``doc_id``: one is kept unless an earlier *kept* one is its near duplicate.

    Rounds of a lexicographically first independent set: keep what has no undecided earlier neighbour, drop its later neighbours. A chain
    a ~ b ~ c keeps a and c. Each round is cut by a checkpoint in the session's shared folder. Rounds go on until no pair is undecided, or
    at most ``small`` are, which one pass in order decides: a long chain takes a round for every two documents.
    """
    spark = docs.sparkSession
    _ensure_checkpoint(spark)
    edges = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    dropped = spark.createDataFrame([], "doc_id long")
    rounds = 0
    while left := edges.limit(small + 1).count():
        if left <= small:
            gone: set[int] = set()
            for a, b in sorted(edges.select("a", "b").collect()):
                if a not in gone:
                    gone.add(b)
            dropped = dropped.unionByName(spark.createDataFrame([(b,) for b in sorted(gone)], "doc_id long"))
            break
        later = edges.select(F.col("b").alias("doc_id")).distinct()
        heads = edges.select(F.col("a").alias("doc_id")).join(later, "doc_id", "left_anti").distinct()
        out = edges.join(heads.withColumnRenamed("doc_id", "a"), "a", "left_semi").select(F.col("b").alias("doc_id")).distinct().checkpoint()
        dropped = dropped.unionByName(out)
        edges = edges.join(out.withColumnRenamed("doc_id", "a"), "a", "left_anti").join(out.withColumnRenamed("doc_id", "b"), "b", "left_anti").join(heads.withColumnRenamed("doc_id", "a"), "a", "left_anti").checkpoint()
        rounds += 1
        if rounds % 20 == 0:
            dropped = dropped.checkpoint()
    return docs.join(dropped, "doc_id", "left_anti")


def _ensure_checkpoint(spark) -> None:
    """The context's checkpoint folder is the session's ``spark.checkpoint.dir``; a temporary one is made only on a local master that has none."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not found and master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or "file://" + tempfile.mkdtemp())


def word_frequencies(docs: DataFrame) -> DataFrame:
    """Pre-token counts over the corpus, the input of tokenizer training."""
    return docs.select(F.explode(T.pretokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def curate(docs: DataFrame, evals: DataFrame, licenses: list[str]) -> DataFrame:
    """License, language and quality filters, near-duplicate removal, scrubbing, decontamination.

    What the filters leave and what is scrubbed are read more than once, so each is written out, to the session's checkpoint folder.
    """
    _ensure_checkpoint(docs.sparkSession)
    kept = filter_quality(filter_language(filter_license(with_license(docs), licenses))).checkpoint()
    unique = first_of_near_duplicates(kept)
    return decontaminated(scrub_documents(unique).checkpoint(), evals)
