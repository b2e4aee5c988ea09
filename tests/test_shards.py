"""The order of rows, shards that appear whole or not at all, and readers that go on where others stopped."""

import json

import pytest
from pyspark.sql import functions as F

from granary.functions.permute import Permutation
from granary.sources import shard_source, shards, writers


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101, 4096, 5000])
def test_permutation(spark, n):
    p = Permutation(n, "s", 1)
    places = [p.place_of(i) for i in range(n)]
    assert sorted(places) == list(range(n)) and [p.row_of(x) for x in places] == list(range(n))
    got = spark.range(-1, n + 1).select("id", p.place(F.col("id")).alias("place")).withColumn("back", p.row(F.col("place"))).collect()
    assert {r.id: (r.place, r.back) for r in got} == {-1: (None, None), n: (None, None)} | {i: (x, i) for i, x in enumerate(places)}
    if n > 50:
        assert places != list(range(n)) and places != [Permutation(n, "s", 2).place_of(i) for i in range(n)]


def rows_of(spark, n):
    return spark.range(n).select(F.col("id").alias("row"), F.array(F.col("id").cast("int"), F.lit(7)).alias("tokens"))


def test_reader_opens_only_the_shards_of_its_batch(spark, tmp_path):
    writers.write_shards(rows_of(spark, 200).coalesce(1), str(tmp_path), rows_per_file=10, vocabulary=1000)
    reader = shards.ShardReader(spark, str(tmp_path), seed=5, batch=3)
    found = reader.at(0)
    assert len(found.inputFiles()) <= 3 and found.count() == 3
    order = Permutation(200, 5, 0)
    assert {(r.place, r.row, r.tokens[0]) for r in found.collect()} == {(p, order.row_of(p), order.row_of(p)) for p in range(3)}


def test_resume_across_the_end_of_an_epoch(spark, tmp_path):
    writers.write_shards(rows_of(spark, 10).coalesce(1), str(tmp_path), rows_per_file=4, vocabulary=1000)
    make = lambda: shards.ShardReader(spark, str(tmp_path), seed=1, batch=4)
    take = lambda r: sorted(x.row for x in r.next().collect())
    one = make()
    run = [take(one) for _ in range(7)]  # three steps an epoch
    for stop in (2, 3, 4):
        first, other = make(), make()
        for _ in range(stop):
            first.next()
        other.resume(json.loads(json.dumps(first.state())))
        assert [take(other) for _ in range(7 - stop)] == run[stop:]
    assert sorted(sum(run[:3], [])) == sorted(sum(run[3:6], [])) == list(range(10)) and run[:3] != run[3:6]


def test_writes_are_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="told to fail|aborted|WRITER"):
        shard_source.write(rows_of(spark, 50), path, rows_per_shard=5, fail_after="1")
    assert shard_source.read_manifest(path) == [] and not list(tmp_path.glob("out/_staged*")) and shard_source.read(spark, path).count() == 0
    shard_source.write(rows_of(spark, 50), path, rows_per_shard=8)
    ids = lambda **k: sorted(r.row for r in shard_source.read(spark, path, **k).collect())
    assert ids() == list(range(50)) and ids(first=11, last=13) == [11, 12]
    before = shard_source.read_manifest(path)
    with pytest.raises(Exception, match="told to fail|aborted|WRITER"):
        shard_source.write(rows_of(spark, 20), path, rows_per_shard=2, fail_after="1")
    assert shard_source.read_manifest(path) == before and ids() == list(range(50))
    # What a killed attempt has left in the folder is not read.
    (tmp_path / "out" / "shards" / "left-behind.parquet").write_bytes(b"not even a table")
    shard_source.write(spark.range(50, 60).select(F.col("id").alias("row"), F.array(F.lit(1)).alias("tokens")), path, overwrite=False)
    assert ids() == list(range(60))
    shard_source.write(rows_of(spark, 5), path)
    assert ids() == list(range(5)) and len(list((tmp_path / "out" / "shards").glob("*.parquet"))) == len(shard_source.read_manifest(path)) + 1


def test_a_task_that_runs_again_leaves_no_duplicates(spark, tmp_path):
    writer = shard_source.ShardSource({"path": str(tmp_path / "again"), "rows_per_shard": "4"}).writer(None, True)
    batches = lambda: iter(rows_of(spark, 10).toArrow().to_batches())
    writer.write(batches())  # the attempt that was lost: its message never arrives
    writer.commit([writer.write(batches()), None])
    found = shard_source.read(spark, str(tmp_path / "again")).collect()
    assert sorted(r.row for r in found) == list(range(10))
