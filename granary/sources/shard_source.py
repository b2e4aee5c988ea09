"""A data source for packed shards: writes that are seen whole or not at all, reads that open only the shards they need.

Tasks write files under names of their own and tell the driver what is in them. Only when all have ended the commit moves the
files to their place and, as its last act, puts a new manifest there by a rename. Readers go by the manifest alone, so what an aborted write, or an attempt of a task that was killed,
has left is never read.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "row long, tokens array<int>"
MANIFEST = "manifest.json"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def read_manifest(path: str) -> list[dict]:
    """``shard, n_rows, first_row, last_row, content_hash`` of every shard that can be seen, in order of rows; none if nothing was committed."""
    fs, root = _opened(path)
    place = posixpath.join(root, MANIFEST)
    if fs.get_file_info(place).type == pafs.FileType.NotFound:
        return []
    with fs.open_input_stream(place) as f:
        return json.loads(f.read())["shards"]


@dataclass
class Written(WriterCommitMessage):
    """What a task has written."""

    shards: list


@dataclass
class ShardPart(InputPartition):
    """A shard, and the rows of it that are wanted."""

    shard: str
    first: int | None = None
    last: int | None = None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, rows_per_shard: int, overwrite: bool, fail_after: int | None):
        self.path, self.rows, self.overwrite, self.fail_after = path, rows_per_shard, overwrite, fail_after
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _opened(self.path)
        folder = posixpath.join(root, f"_staged-{self.job}")
        fs.create_dir(folder, recursive=True)
        made, held, count = [], [], 0

        def flush(batches: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(batches)
            rows = table.column("row").to_pylist()
            digest = hashlib.sha256()
            for tokens in table.column("tokens").to_pylist():
                digest.update(hashlib.sha256(",".join(map(str, tokens or [])).encode()).digest())
            name = f"{uuid.uuid4().hex}.parquet"
            pq.write_table(table, posixpath.join(folder, name), filesystem=fs)
            made.append({"shard": name, "n_rows": len(rows), "first_row": min(rows), "last_row": max(rows), "content_hash": digest.hexdigest()})

        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, self.rows - count)
                held.append(part)
                count, at = count + part.num_rows, at + part.num_rows
                if count == self.rows:
                    flush(held)
                    held, count = [], 0
            if self.fail_after is not None and len(made) >= self.fail_after:
                raise RuntimeError("told to fail")
        if count:
            flush(held)
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.path)
        folder, before = posixpath.join(root, f"_staged-{self.job}"), read_manifest(self.path)
        shards = [] if self.overwrite else list(before)
        fs.create_dir(posixpath.join(root, "shards"), recursive=True)
        for message in messages:
            for shard in message.shards if message else []:
                fs.move(posixpath.join(folder, shard["shard"]), posixpath.join(root, "shards", shard["shard"]))
                shards.append(shard)
        shards.sort(key=lambda s: s["first_row"])
        fresh = posixpath.join(root, f"_{MANIFEST}-{self.job}")
        with fs.open_output_stream(fresh) as f:
            f.write(json.dumps({"shards": shards}, sort_keys=True).encode())
        fs.move(fresh, posixpath.join(root, MANIFEST))  # from here on it can be seen
        self._drop(fs, folder)
        seen = {s["shard"] for s in shards}
        for shard in before:
            if shard["shard"] not in seen:
                fs.delete_file(posixpath.join(root, "shards", shard["shard"]))

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.path)
        self._drop(fs, posixpath.join(root, f"_staged-{self.job}"))

    @staticmethod
    def _drop(fs: pafs.FileSystem, folder: str) -> None:
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: list[int] | None):
        self.path, self.rows = path, rows

    def partitions(self) -> list[ShardPart]:
        shards = read_manifest(self.path)
        if self.rows is None:
            return [ShardPart(s["shard"]) for s in shards] or [ShardPart("")]
        first, last = self.rows
        return [ShardPart(s["shard"], first, last) for s in shards if s["last_row"] >= first and s["first_row"] < last] or [ShardPart("")]

    def read(self, partition: ShardPart) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        kind = pa.schema([("row", pa.int64()), ("tokens", pa.list_(pa.int32()))])
        if not partition.shard:
            yield pa.RecordBatch.from_arrays([pa.array([], t) for t in kind.types], schema=kind)
            return
        fs, root = _opened(self.path)
        with fs.open_input_file(posixpath.join(root, "shards", partition.shard)) as f:
            for batch in pq.ParquetFile(f).iter_batches():
                if partition.first is not None:
                    row = batch.column(0)
                    batch = batch.filter(pc.and_(pc.greater_equal(row, partition.first), pc.less(row, partition.last)))
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, kind.types, strict=True)], schema=kind)


class ShardSource(DataSource):
    """``format("granary_shards")`` with the options ``path``, ``rows_per_shard`` for writes, and ``first`` and ``last`` for reads of a range of rows."""

    @classmethod
    def name(cls) -> str:
        return "granary_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        first, last = self.options.get("first"), self.options.get("last")
        return _Reader(self.options["path"], None if first is None and last is None else [int(first or 0), int(last if last is not None else 1 << 62)])

    def writer(self, schema, overwrite: bool) -> _Writer:
        fail = self.options.get("fail_after")
        return _Writer(self.options["path"], int(self.options.get("rows_per_shard", 1 << 16)), overwrite, None if fail is None else int(fail))


def write(rows: DataFrame, path: str, rows_per_shard: int = 1 << 16, overwrite: bool = True, **options: str) -> None:
    """Write ``rows(row, tokens)`` as shards in order of ``row``: all of them or, if anything fails, none."""
    spark = rows.sparkSession
    spark.dataSource.register(ShardSource)
    ordered = rows.selectExpr("cast(row as long) row", "cast(tokens as array<int>) tokens").repartitionByRange("row").sortWithinPartitions("row")
    ordered.write.format("granary_shards").mode("overwrite" if overwrite else "append").option("rows_per_shard", rows_per_shard).options(**options).save(path)


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of committed shards, from ``first`` up to but not including ``last``; only shards that hold some of them are opened."""
    spark.dataSource.register(ShardSource)
    reader = spark.read.format("granary_shards")
    for name, value in (("first", first), ("last", last)):
        reader = reader if value is None else reader.option(name, value)
    return reader.load(path)
