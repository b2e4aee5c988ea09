"""Packing of token streams into fixed rows, masks and labels, and the order in which rows are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import text as T


def prefix_sums(lengths: DataFrame, order: str = "doc_id", value: str = "n", buckets: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``start``: the sum of all earlier values, over a global order of a numeric column, or over one within each group of ``by``.

    Two levels instead of one unpartitioned window: quantiles of the order, found first, cut it into ranges; sums of whole ranges (one row
    each) become their offsets, and a window adds up within each, so a group of any size is no task of its own. A row's range depends on its
    value alone, so both levels agree even where a plan is computed twice. There are as many ranges as the session has shuffle partitions, 64
    at least, unless stated. Nulls come first, in the order as in ``by``.
    """
    buckets = buckets or max(64, int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / buckets for i in range(1, buckets)]
    found = lengths.agg(F.percentile_approx(order, shares, 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(found))]) if found else F.array().cast("array<long>")
    # The order goes through an array of one, or Spark would compute what it is made of anew for each of the cuts.
    ranged = lengths.withColumn("part", F.get(F.transform(F.array(order), lambda x: F.size(F.filter(cuts, lambda c: c < x))), F.lit(0)))
    sums = ranged.groupBy(*by, "part").agg(F.sum(value).alias("s"))
    offsets = sums.select(*by, "part", (F.sum("s").over(Window.partitionBy(*by).orderBy("part")) - F.col("s")).alias("before"))
    w = Window.partitionBy(*by, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if by:
        names = {c: f"_{c}" for c in (*by, "part")}
        placed = ranged.join(offsets.withColumnsRenamed(names), [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]).drop(*names.values())
    else:
        placed = ranged.join(F.broadcast(offsets), "part")
    return placed.withColumn("start", F.col("before") + F.sum(value).over(w) - F.col(value)).drop("part", "before")


def pack_rows(lengths: DataFrame, seq_len: int) -> DataFrame:
    """Fragments of documents in rows of ``seq_len + 1`` tokens, streams put end to end in order of ``doc_id``; empty ones are skipped.

    ``row, doc_id, doc_start, row_start, len``: where the fragment begins in its document and in its row.
    """
    width = seq_len + 1
    placed = prefix_sums(lengths.where("n > 0"))
    rows = placed.select("doc_id", "n", "start", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n") - 1) / width))).alias("row"))
    first = F.greatest("start", F.col("row") * width)
    last = F.least(F.col("start") + F.col("n"), (F.col("row") + 1) * width)
    return rows.select("row", "doc_id", (first - F.col("start")).alias("doc_start"), (first - F.col("row") * width).alias("row_start"), (last - first).alias("len"))


def row_boundaries(fragments: DataFrame) -> DataFrame:
    """Where documents begin in a row, 0 included, and the row's tokens."""
    return fragments.groupBy("row").agg(F.sort_array(F.collect_set("row_start")).alias("boundaries"), F.sum("len").alias("used"), F.count("*").alias("fragments"))


def segment_ids(boundaries: Column, length: int) -> Column:
    """For each place of a row the number of its segment."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda p: F.size(F.filter(boundaries, lambda b: b <= p)) - 1)


def document_mask(boundaries: Column, length: int) -> Column:
    """Causal mask within segments, as an array of rows."""
    seg = segment_ids(boundaries, length)
    places = F.sequence(F.lit(0), F.lit(length - 1))
    return F.transform(places, lambda i: F.transform(places, lambda j: (j <= i) & (F.element_at(seg, i + 1) == F.element_at(seg, j + 1))))


def training_batch(tokens: Column, length: int) -> tuple[Column, Column]:
    """Inputs and targets of a packed row: all but the last token, all but the first."""
    return F.slice(tokens, 1, length), F.slice(tokens, 2, length)


def supervised_labels(tokens: Column, completion_start: Column, ignore: int = -100) -> Column:
    """Labels with the prompt masked."""
    return F.transform(tokens, lambda t, i: F.when(i < completion_start, F.lit(ignore)).otherwise(t))


def rows_per_shard(seq_len: int, target_bytes: int = 256 << 20, token_bytes: int = 2) -> int:
    return max(1, target_bytes // ((seq_len + 1) * token_bytes))


def epoch_order(rows: DataFrame, seed: int, epoch: int, batch: int, key: str = "row") -> DataFrame:
    """A permutation that depends on seed and epoch alone, with the batch of every row."""
    h = T.draw(seed, epoch, F.col(key))
    ranged = prefix_sums(rows.withColumn("h", h).withColumn("one", F.lit(1)), order="h", value="one")
    return ranged.select(*rows.columns, F.col("start").alias("place"), F.floor(F.col("start") / batch).alias("batch"))


def trim_memory(turns: DataFrame, last: int = 20, chars: int = 6000, per_turn: int = 2000) -> DataFrame:
    """The newest turns of each conversation: at most ``last``, at most ``chars`` characters in all, the newest always; a turn is cut at ``per_turn``."""
    cut = turns.withColumn("text", F.substring("text", 1, per_turn))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = cut.withColumn("back", F.row_number().over(w)).withColumn("held", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return kept.where((F.col("back") == 1) | ((F.col("back") <= last) & (F.col("held") <= chars))).drop("back", "held")


def user_history(turns: DataFrame, limit: int = 5) -> DataFrame:
    """The last user turns, oldest first, as one text."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    some = turns.where("role = 'user'").withColumn("back", F.row_number().over(w)).where(F.col("back") <= limit)
    return some.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("history"), F.count("*").alias("turns"))


def render_history(turns: DataFrame, limit: int = 6) -> DataFrame:
    """The last turns as ``role: text`` lines."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    some = turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= limit)
    return some.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))), lambda t: t["line"]), "\n").alias("rendered"))


def chat_template(turns: DataFrame) -> DataFrame:
    """Conversations as tagged text, in order of turns; marks inside a text are broken by a zero-width space."""
    safe = F.regexp_replace("text", r"<\|", "<​|")
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), safe, F.lit("<|eos|>\n"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda t: t["line"]), "").alias("chat"), F.count("*").alias("turns"))


def recent_sessions(turns: DataFrame, keep: int = 128) -> DataFrame:
    """The sessions used last: ``conv_id, last_turn``."""
    return turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id").limit(keep)
