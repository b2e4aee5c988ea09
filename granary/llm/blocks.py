"""Texts in blocks, and a census of hashes over all blocks.

A block is a row that holds the texts of some documents in order of ``doc_id``: a few MB of bytes with the documents'
ids and lengths. Blocks are written once, bucketed by ``block_id``; what later passes learn about a block comes back
as a few rows with its id, which join without moving the texts again.

The census counts the hashes that the blocks' documents hold. A block sends each range of hash values as one packed,
sorted array; the counting task answers with a code per hash in the same order. So a block gets to know which of its own hashes
are unique, rare or frequent in the corpus, for some 4 bytes and 2 bits each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .worker import enter, tidy

BLOCK_BYTES = 2 << 20
#: Text whose hashes one task counts, about a tenth of it in bytes.
PART_BYTES = 256 << 20
#: Stands for a null id in the order of documents.
LAST = (1 << 63) - 1
_BLOCK = "block_id long, doc_ids array<long>, sizes array<long>, data binary, extra array<string>"


class Blocks:
    """The table of blocks of one corpus."""

    def __init__(self, every: DataFrame, name: str, carry: str, carried: list[str]):
        self.every, self.table, self.name = every, every.drop("extra"), name
        #: Type of what the documents carry, as DDL, and its columns.
        self.carry, self.carried = carry, carried

    def restored(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """``rows`` with the carried columns in place of ``extra``, in the order given."""
        if self.carry:
            rows = rows.withColumn("extra", F.from_json("extra", self.carry))
        return rows.select(*[F.col(f"extra.`{c}`").alias(c) if c in self.carried else F.col(c) for c in order])

    def joined(self, *sides: DataFrame, extra: bool = False) -> DataFrame:
        """Blocks with the columns of tables that hold at most one row per ``block_id``; only those tables are shuffled. ``extra``: with what the documents carry."""
        out = self.every if extra else self.table
        for side in sides:
            out = out.join(side.hint("shuffle_hash"), "block_id", "left")
        return out

    def bytes(self) -> int:
        """Bytes of all texts."""
        return self.table.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + n).alias("n")).agg(F.sum("n")).first()[0] or 0


def gathered(side: DataFrame, name: str = "side") -> DataFrame:
    """Side rows ``(block_id, part, blob)`` as one row per block, ordered by part. A block has at most as many as there are parts."""
    return side.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("part", "blob"))).alias(name))


def build(docs: DataFrame, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> Blocks:
    """Blocks of the UTF-8 bytes of ``docs(doc_id, text)``; a null text is empty. Every row has its place, repeated ids too; a null id counts as the largest.

    The columns in ``carry`` travel along as JSON, one string per document.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        enter("blocks")
        pid, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        extras: list[str] = []
        held = 0

        def flush():
            nonlocal made, held
            order = np.argsort(np.array([LAST if i is None else i for i in ids], np.int64), kind="stable")
            data = b"".join([texts[i] for i in order])
            row = pa.RecordBatch.from_arrays(
                [pa.array([(pid << 24) | made], pa.int64()), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([[len(texts[i]) for i in order]], pa.list_(pa.int64())), pa.array([data], pa.binary()), pa.array([[extras[i] for i in order] if carry else None], pa.list_(pa.string()))],
                ["block_id", "doc_ids", "sizes", "data", "extra"],
            )
            made, held = made + 1, 0
            ids.clear()
            texts.clear()
            extras.clear()
            return row

        for batch in batches:
            for doc, text, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc)
                texts.append(text or b"")
                extras.append(extra)
                held += len(texts[-1])
                if held >= block_bytes or len(ids) >= 1 << 19:
                    yield flush()
        if ids:
            yield flush()
        tidy()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), (F.to_json(F.struct(*carry)) if carry else F.lit(None).cast("string")).alias("extra"))
    made = source.mapInArrow(run, _BLOCK)
    buckets = scratch.partitions(spark)
    name = f"granary_blocks_{uuid.uuid4().hex}"
    path = scratch.new_path(spark, "blocks", name)
    made.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "block_id").saveAsTable(name)
    return Blocks(spark.table(name), name, docs.select(*carry).schema.toDDL() if carry else "", carry or [])


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks one by one, with ``data`` as a NumPy array of bytes, ``ids`` (a null one as the largest long) and ``null`` of the documents, and
    ``starts``, one more than documents; other columns as Python values."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            raw = row["data"].as_buffer()
            found = row["doc_ids"].values
            starts = np.concatenate([[0], np.cumsum(row["sizes"].values.to_numpy())]).astype(np.int64)
            data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
            yield {k: v.as_py() for k, v in row.items() if k not in ("data", "doc_ids", "sizes")} | {"ids": found.fill_null(LAST).to_numpy(), "null": found.is_null().to_numpy(zero_copy_only=False), "starts": starts, "data": data}
    tidy()


def ids_of(block: dict) -> pa.Array:
    """The documents' ids, nulls included."""
    return pa.array(block["ids"], pa.int64(), mask=block["null"])


SIDE = "block_id long, part int, blob binary"


def parts_for(spark, size: int = 0) -> int:
    """Parts of an exchange over texts of ``size`` bytes: some more than tasks, so that hashing parts to tasks evens out, and so many that each stands for :data:`PART_BYTES` at most."""
    p = scratch.partitions(spark)
    return max(p if p > 64 else 4 * p, -(-size // PART_BYTES))


def exchange(frame: DataFrame, hashes: Callable[[dict], tuple[np.ndarray, np.ndarray]], parts: int, judge: Callable[..., np.ndarray], note: str = "u4", key: str = "u4", code: str = "u1") -> DataFrame:
    """Codes of the blocks' hashes, as ``side`` rows.

    ``hashes(block)`` gives the block's distinct 64-bit hashes, sorted, and an integer of type ``note`` with each. The high bits of a hash
    pick its part. With a 32-bit ``key`` the next 32 bits stand for it, so two hashes of a part pass for one with a probability of rows / 2**32; with a
    64-bit key the hash itself does. ``judge(notes, owners, starts, ends)`` gets all integers in order of hash and sender, the senders,
    and where each group of equal hashes begins and ends; it gives a code per group, or one per hash.
    """
    width, wide = np.dtype(key).itemsize, np.dtype(note).itemsize

    def send(batches):
        for block in rows(batches):
            values, notes = hashes(block)
            if not len(values):
                continue
            part, low = split(values, parts)
            low, notes = (low if width == 4 else values.astype("<u8")), notes.astype("<" + note)
            edges = np.searchsorted(part, np.arange(parts + 1))
            used = np.flatnonzero(np.diff(edges))
            blobs = [low[edges[p] : edges[p + 1]].tobytes() + notes[edges[p] : edges[p + 1]].tobytes() for p in used]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), block["block_id"]), pa.int64()), pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], ["block_id", "part", "blob"])

    def count(_, table):
        table = table.take(pa.array(np.argsort(table.column("block_id").to_numpy(), kind="stable")))
        blobs = table.column("blob").to_pylist()
        sizes = np.array([len(b) // (width + wide) for b in blobs])
        values = np.frombuffer(b"".join([b[: width * n] for b, n in zip(blobs, sizes, strict=True)]), "<" + key)
        notes = np.frombuffer(b"".join([b[width * n :] for b, n in zip(blobs, sizes, strict=True)]), "<" + note)
        count = len(values)
        del blobs
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        del values
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        ends = np.append(starts[1:], count)
        del ranked
        owners = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        found = judge(notes[order], owners, starts, ends)
        del notes, owners
        codes = np.empty(count, "<" + code)
        codes[order] = found if len(found) == count and len(starts) < count else np.repeat(found, ends - starts)
        at = np.cumsum(sizes)
        del order, found, starts, ends
        tidy()
        return pa.table({"block_id": table.column("block_id"), "part": table.column("part"), "blob": pa.array([codes[e - n : e].tobytes() for e, n in zip(at, sizes, strict=True)], pa.binary())})

    return frame.mapInArrow(send, SIDE).groupBy("part").applyInArrow(count, SIDE)


def census(frame: DataFrame, hashes: Callable[[dict], tuple[np.ndarray, np.ndarray]], parts: int) -> DataFrame:
    """How often all blocks hold each hash, at most 255: an :func:`exchange` of hashes with their number in the block. A code may be too large, never too small."""
    return exchange(frame, hashes, parts, lambda notes, owners, starts, ends: np.minimum(np.add.reduceat(notes.astype(np.int64), starts), 255), note="u1")


def split(sorted_hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and 32-bit stand-in of sorted 64-bit hashes; both grow with the hash."""
    high = sorted_hashes >> np.uint64(40)
    part = (high * np.uint64(parts)) >> np.uint64(24)
    return part.astype(np.int64), ((sorted_hashes >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def codes_of(block: dict, count: int, name: str = "side", code: str = "u1") -> np.ndarray:
    """The codes of a block, in the order of its sorted hashes."""
    found = np.frombuffer(b"".join(s["blob"] for s in block[name] or []), "<" + code)
    if len(found) != count:
        raise ValueError(f"block {block['block_id']}: {len(found)} codes for {count} hashes")
    return found


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
