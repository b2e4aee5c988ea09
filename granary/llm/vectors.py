"""Reading vectors from a table: which rows take part, and their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimension(table: DataFrame, vector_col: str) -> int:
    """The most frequent length of a vector (the larger one on a tie); 0 if there is none. Vectors of another length take no part."""
    found = table.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("n")).count().where("n > 0").orderBy(F.desc("count"), F.desc("n")).first()
    return found["n"] if found else 0


def marked(table: DataFrame, id_col: str, vector_col: str, dim: int, carry: Column) -> DataFrame:
    """``id, x, c`` for every row: the vector as 64-bit floats and ``carry`` as a long; ``x`` is null unless the id and ``carry`` are not null and the vector has ``dim`` finite components, not all zero."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
            fit = (sizes == dim) & ~lists.is_null().to_numpy(zero_copy_only=False) & ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            fit &= ~batch.column(2).is_null().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(fit)
            values = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
            good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)  # a null component has become NaN
            values = np.where(values == 0, 0.0, values)  # no negative zeros: equal vectors have equal bytes
            out: list[bytes | None] = [None] * len(batch)
            for i, v in zip(rows[good].tolist(), values[good], strict=True):
                out[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["id", "x", "c"])

    source = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), carry.cast("long").alias("c"))
    return source.mapInArrow(run, "id long, x binary, c long")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A binary column as rows of 64-bit floats."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)
