"""Reading packed shards in a stated order, batch by batch, from where another reader stopped.

The order of an epoch is a permutation that is computed, not stored: the rows of a batch follow from its number, the manifest tells their shards, and no
other shard is opened.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.permute import Permutation
from granary.sources import writers


@dataclass
class ShardReader:
    """Batches of written shards whose rows are numbered from 0. The order of an epoch depends on the seed and the epoch alone; ranks take turns, so none reads another's rows."""

    spark: SparkSession
    path: str
    seed: int
    batch: int
    rank: int = 0
    ranks: int = 1
    step: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.rank < self.ranks:
            raise ValueError("rank outside the ranks")
        self.shards = self.spark.read.json(f"{self.path}/manifest")
        self.size = self.shards.agg({"n_rows": "sum"}).first()[0] or 0

    def fingerprint(self) -> str:
        """A digest of all shards' contents."""
        found = writers.manifest(self.spark, self.path).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("content_hash")), ""), 256).alias("h"))
        return found.first()["h"]

    def steps(self) -> int:
        """Batches of an epoch; the last one may be short."""
        return -(-self.size // (self.batch * self.ranks))

    def at(self, step: int) -> DataFrame:
        """``row, tokens, place`` of a batch: of the epoch's order, the rows of this rank. Only the shards that hold them are read."""
        epoch, within = divmod(step, max(1, self.steps()))
        whole = self.batch * self.ranks
        places = [p for p in range(within * whole, min(self.size, (within + 1) * whole)) if p % self.ranks == self.rank]
        order = Permutation(self.size, self.seed, epoch) if self.size else None
        wanted = self.spark.createDataFrame([(p, order.row_of(p)) for p in places], "place long, row long")  # a batch
        found = writers.locate(self.shards, F.broadcast(wanted.select("row"))).select("shard").distinct().collect()
        if not found:
            return wanted.select("row", F.lit(None).cast("array<int>").alias("tokens"), "place").where("false")
        rows = self.spark.read.parquet(*sorted(f"{self.path}/shards/{r['shard']}" for r in found))
        return rows.join(F.broadcast(wanted), "row").select("row", "tokens", "place")

    def next(self) -> DataFrame:
        found = self.at(self.step)
        self.step += 1
        return found

    def state(self) -> dict:
        return {"seed": self.seed, "step": self.step, "fingerprint": self.fingerprint()}

    def resume(self, state: dict) -> None:
        """Go on where another reader stopped; another seed or other shards are an error."""
        if state["seed"] != self.seed:
            raise ValueError("the state is of another seed")
        if state["fingerprint"] != self.fingerprint():
            raise ValueError("the shards have changed")
        self.step = state["step"]
