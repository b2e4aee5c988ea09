"""Writers: shards with a manifest, JSON lines, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("overwrite").text(path)


def write_shards(rows: DataFrame, path: str, rows_per_file: int, vocabulary: int) -> DataFrame:
    """Packed rows ``(row, tokens)`` as Parquet with a manifest: a digest of every shard's rows in order. Returns the manifest."""
    if vocabulary > 65_536:
        raise ValueError("ids must fit 16 bits")
    spark = rows.sparkSession
    rows.orderBy("row").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/shards")
    found = manifest(spark, path)
    found.write.mode("overwrite").json(f"{path}/manifest")
    return found


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``shard, n_rows, first_row, content_hash`` of written shards; row hashes are combined in order, so no shard is gathered as text."""
    written = spark.read.parquet(f"{path}/shards").withColumn("shard", F.col("_metadata.file_name"))
    digests = written.select("shard", "row", F.sha2(F.array_join("tokens", ","), 256).alias("h"))
    return digests.groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("row").alias("first_row"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "h"))), lambda r: r["h"]), ""), 256).alias("content_hash"))


def locate(manifest_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shard and place of global rows ``wanted(row)``."""
    m = manifest_rows.select("shard", "first_row", "n_rows")
    return wanted.join(m, (F.col("row") >= F.col("first_row")) & (F.col("row") < F.col("first_row") + F.col("n_rows"))).select("row", "shard", (F.col("row") - F.col("first_row")).alias("place"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those that new ones replace, and the new ones (the last of each key by ``order``, where there is one)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def write_partitioned(rows: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> None:
    rows.write.mode("overwrite").partitionBy(*by).format(fmt).save(path)
