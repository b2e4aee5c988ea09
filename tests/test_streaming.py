import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from granary.streaming import events as S

FOLDER = "/root/testdata/sf0.001"


def batch(spark):
    return spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr("* except (ts)", "cast(ts as timestamp) as ts")


def test_stream_equals_batch(spark, tmp_path):
    stream = S.windowed(S.read_events(spark, FOLDER), "1 day")
    got = S.run_to_end(stream, "win", "complete", str(tmp_path / "c"))
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(got) == key(S.windowed(batch(spark), "1 day"))


def files(folder, *batches):
    """Event files that a stream reads one after the other: rows (event_id, time, user_id)."""
    for i, rows in enumerate(batches):
        frame = pd.DataFrame([(e, pd.Timestamp(t), u, "a", 1.0, "") for e, t, u in rows], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        pq.write_table(pa.Table.from_pandas(frame, preserve_index=False), folder / f"events{i}.parquet", coerce_timestamps="us")


def test_late_rows_and_repeats(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    files(folder, [(1, "2024-01-01 01:00", 1), (2, "2024-01-05 01:00", 1)], [(2, "2024-01-05 01:00", 1), (3, "2024-01-05 02:00", 2)], [(4, "2024-01-01 02:00", 1), (5, "2024-01-05 03:00", 2)])
    counted = S.run_to_end(S.windowed(S.read_events(spark, str(folder)), "1 day", late="1 hour"), "late", "update", str(tmp_path / "w"))
    first = [r.n for r in counted.collect() if r.start.day == 1]
    assert first == [1]  # the fourth event came after its window was closed
    unique = S.run_to_end(S.deduplicated(S.read_events(spark, str(folder)), "30 days"), "unique", "append", str(tmp_path / "u"))
    assert sorted(r.event_id for r in unique.collect()) == [1, 2, 3, 4, 5]


def test_sessions_and_buckets(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    files(folder, [(1, "2024-01-01 01:00:00", 1), (2, "2024-01-01 01:00:00", 1), (3, "2024-01-01 01:00:01", 1)], [(4, "2024-01-01 01:00:05", 1), (5, "2024-01-01 04:00:00", 1)])
    spans = S.run_to_end(S.sessions(S.read_events(spark, str(folder)), "30 minutes"), "spans", "append", str(tmp_path / "s")).collect()
    assert spans == [] or sorted(r.n for r in spans) in ([4], [1, 4])  # what the watermark has passed
    decided = S.run_to_end(S.bucket_decisions(S.read_events(spark, str(folder)), capacity=1.0, rate=0.5), "decided", "append", str(tmp_path / "b"))
    assert {r.event_id: r.allowed for r in decided.collect()} == {1: True, 2: False, 3: False, 4: True, 5: True}
    rows = spark.read.parquet(str(folder)).selectExpr("* except (ts)", "cast(ts as timestamp) as ts")
    assert sorted(r.n for r in S.sessions(rows, "30 minutes").collect()) == [1, 4]
