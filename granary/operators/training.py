"""Supervised examples, preference pairs, rewards and the arithmetic of cache blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IGNORE = -100


def encode_example(prompt: Column, completion: Column, begin: int, end: int, max_len: int | None = None) -> Column:
    """Ids of ``begin + prompt + completion + end`` with where the completion begins; a prompt that is too long loses its head, never ``begin``."""
    room = F.greatest(F.lit(0), F.lit(max_len) - 2 - F.size(completion)) if max_len else F.size(prompt)
    kept = F.slice(prompt, F.greatest(F.lit(1), F.size(prompt) - room + 1), F.greatest(room, F.lit(1)))
    kept = F.when(room > 0, kept).otherwise(F.array().cast("array<int>"))
    ids = F.concat(F.array(F.lit(begin)), kept, completion, F.array(F.lit(end)))
    return F.struct(ids.alias("ids"), (F.size(kept) + 1).alias("completion_start"))


def pack_examples(examples: DataFrame, seq_len: int, pad_id: int, mask_boundaries: bool = True, drop_last: bool = False) -> DataFrame:
    """Examples ``(doc_id, ids, completion_start)`` put end to end in rows of ``seq_len + 1`` ids with labels; rows without a label are dropped.

    ``row, ids, labels``: prompt ids, padding and (if asked for) the first id of each example carry no label.
    """
    from granary.operators.packing import prefix_sums

    width = seq_len + 1
    placed = prefix_sums(examples.withColumn("n", F.size("ids").cast("long")).where("n > 0"))
    cells = placed.select(
        F.explode(
            F.transform("ids", lambda t, i: F.struct((F.col("start") + i).alias("at"), t.alias("id"), F.when((i < F.col("completion_start")) | (F.lit(mask_boundaries) & (i == 0)), F.lit(IGNORE)).otherwise(t).alias("label")))
        ).alias("c")
    ).select((F.col("c.at") / width).cast("long").alias("row"), F.struct(F.pmod("c.at", F.lit(width)).alias("p"), "c.id", "c.label").alias("c"))
    rows = cells.groupBy("row").agg(F.sort_array(F.collect_list("c")).alias("c"))
    short = F.lit(width) - F.size("c")
    rows = rows.select("row", F.concat("c.id", F.array_repeat(F.lit(pad_id), short)).alias("ids"), F.concat("c.label", F.array_repeat(F.lit(IGNORE), short)).alias("labels"), short.alias("short"))
    return rows.where(F.exists("labels", lambda x: x != IGNORE) & (F.lit(not drop_last) | (F.col("short") == 0))).select("row", "ids", "labels")


def preference_pairs(rows: DataFrame, order: str = "doc_id") -> DataFrame:
    """Chosen and rejected answers over four ways to fail, in turn: empty, cut, repeated, off the subject."""
    mode = F.pmod(F.col(order), F.lit(4))
    bad = F.when(mode == 0, F.lit("")).when(mode == 1, F.substring("answer", 1, 10)).when(mode == 2, F.concat_ws(" ", "answer", "answer")).otherwise(F.lit("I would rather talk about something else."))
    return rows.select(order, "prompt", F.col("answer").alias("chosen"), bad.alias("rejected"), F.element_at(F.array(*[F.lit(x) for x in ("empty", "cut", "repeated", "off_topic")]), (mode + 1).cast("int")).alias("mode"))


def reward(completion: Column, gold: Column) -> Column:
    """Half for valid JSON with a label, half for the right label."""
    label = F.get_json_object(completion, "$.label")
    return F.when(label.isNotNull(), 0.5).otherwise(0.0) + F.when(label == gold, 0.5).otherwise(0.0)


def first_crossing(history: DataFrame, target: float) -> DataFrame:
    """Where a run's ``(run, step, value)`` first reaches a target, linear between steps."""
    w = Window.partitionBy("run").orderBy("step")
    steps = history.withColumn("pv", F.lag("value").over(w)).withColumn("ps", F.lag("step").over(w))
    cross = steps.where((F.col("value") >= target) & (F.col("pv").isNull() | (F.col("pv") < target)))
    at = F.when(F.col("pv").isNull(), F.col("step").cast("double")).otherwise(F.col("ps") + (F.col("step") - F.col("ps")) * (target - F.col("pv")) / (F.col("value") - F.col("pv")))
    return cross.groupBy("run").agg(F.min(at).alias("crossing"))


def block_report(lengths: DataFrame, block: int = 16, longest: int = 2048) -> DataFrame:
    """Blocks that sequences take, tokens lost inside them, and how much a reservation of the longest would take."""
    blocks = F.ceil(F.col("n") / block)
    return lengths.agg(F.sum(blocks).alias("blocks"), (F.sum(blocks * block) - F.sum("n")).alias("wasted"), (F.count("*") * longest / F.sum(blocks * block)).alias("amplification"))
