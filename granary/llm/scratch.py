"""Tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where the session has none and runs on the driver alone (a local test) a
temporary one is made, once per session. A table written here is a barrier: a lost executor costs the
tasks after it, not the plan before it.

What is made is noted per session, so that a caller who has read a result can sweep up what led to it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: By session: paths of what was made, in order, with the name of the catalogue's table if there is one.
_made: dict[str, dict[str, str | None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else the context's checkpoint folder, else, on a local master, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        found = _own.get(key) or _own.setdefault(key, "file://" + tempfile.mkdtemp(prefix="granary-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str, table: str | None = None) -> str:
    """A path in the shared folder for something new; ``table``: its name in the catalogue."""
    path = f"{shared_dir(spark)}/granary-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, {})[path] = table
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage without a second computation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    table = _made.get(spark.sparkContext.applicationId, {}).pop(path, None)
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*frames: DataFrame) -> None:
    """Remove tables that :func:`materialize` wrote and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_granary_path", None)
        if path:
            _remove(df.sparkSession, path)


def mark(spark: SparkSession) -> int:
    """How much has been made so far."""
    return len(_made.get(spark.sparkContext.applicationId, {}))


def sweep(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> int:
    """Remove what was made after a mark, but for the tables in ``keep``; returns how much that was. Frames that still read it fail."""
    kept = {getattr(df, "_granary_path", None) for df in keep}
    gone = [p for p in list(_made.get(spark.sparkContext.applicationId, {}))[since:] if p not in kept]
    for path in gone:
        _remove(spark, path)
    return len(gone)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
