"""A table that is kept up by merging batches into it: hash buckets by key, of which a batch rewrites only those it touches.

Each bucket is one folder, named by the commit log (``commits``). A merge reads the touched buckets, combines their rows with the batch's, one row per key, writes
new folders and commits their names in one step; all other buckets stay the files they are. Readers hold a snapshot: the folders of the version they began with
stay until ``vacuum``. Of two merges at once the second finds its number taken, does again what the first has touched too, and commits what is left of its work as it is.
A replayed batch is not merged again, so sums are right too.

How rows of a key become one is a parameter (``keep_latest``, ``add_up``, or that of a change feed); it must not matter in which order rows meet. Batches are combined
before anything is shuffled, so a hot key is one row from each task. NULL is a key like any other. Choose the number of buckets so that one holds some 100 MB; it stays
as it was when the table began, and the state of the log has an entry for each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_scope, stage
from .commits import CommitLog, State
from .upserts import writer_of

#: Makes one row of the rows that agree in some columns; ``_new`` is 1 in those of the batch, 0 in stored ones.
Combine = Callable[[DataFrame, Sequence[str]], DataFrame]


def keep_latest(order_by: Sequence[str] = ()) -> Combine:
    """The greatest row by ``order_by``; among equals, the one committed last."""

    def combine(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in by and c != "_new"]
        # Rows of one batch that are equal in the order are told apart by their values.
        chosen = F.max_by(F.struct(*rest), F.struct(*order_by, "_new", *rest))
        return rows.groupBy(*by).agg(chosen.alias("_row")).select(*by, *[F.col(f"_row.`{c}`") for c in rest])

    return combine


def add_up(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sums of all columns but the key's, in their own types; NULL where there is nothing to add."""
    rest = [f for f in rows.schema.fields if f.name not in by and f.name != "_new"]
    return rows.groupBy(*by).agg(*[F.sum(f.name).cast(f.dataType).alias(f.name) for f in rest])


class MergedTable:
    """The table in the folder ``target``; every batch has the columns of ``schema``."""

    def __init__(
        self, spark: SparkSession, target: str, schema: T.StructType, key: str | Sequence[str], combine: Combine, buckets: int = 16
    ):
        self.spark, self.target, self.schema, self.combine = spark, target.rstrip("/"), schema, combine
        self.key = [key] if isinstance(key, str) else list(key)
        self.log = CommitLog(spark, self.target)
        self.buckets = buckets

    def _rows(self, state: State, buckets: Sequence[str] | None = None) -> DataFrame:
        names = [value for bucket, (_, value) in state.live.items() if buckets is None or bucket in buckets]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.target}/{name}" for name in names])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is now, or was at an older version, whatever is merged from here on."""
        return self._rows(self.log.state(version))

    def version(self) -> int:
        return self.log.state().version

    def _rewrite(self, batch: DataFrame, state: State, buckets: Sequence[str]) -> dict[str, str]:
        """New folders for some buckets, with the rows they have at ``state`` and those of the batch."""
        stored = self._rows(state, set(buckets)).withColumn("_new", F.lit(0)).withColumn("_bucket", self._bucket(int(state.meta["buckets"])))
        rows = batch.where(F.col("_bucket").isin([int(b) for b in buckets])).withColumn("_new", F.lit(1)).unionByName(stored)
        # All rows of a bucket are in one task, which so writes one file.
        merged = self.combine(rows.repartition(len(buckets), "_bucket"), ["_bucket", *self.key])
        folder = f"data/{uuid.uuid4().hex}"
        merged.select("_bucket", *self.schema.names).sortWithinPartitions("_bucket").write.partitionBy("_bucket").parquet(f"{self.target}/{folder}")
        return {bucket: f"{folder}/_bucket={bucket}" for bucket in buckets}

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")

    def merge(self, batch: DataFrame, writer: str, batch_id: int) -> bool:
        """Merge a batch; False, and nothing happens, if this writer has committed it or a later one."""
        state = self.log.state()
        if state.committed(writer, batch_id):
            return False
        while "buckets" not in state.meta:
            self.log.commit(state, {}, meta={"buckets": str(self.buckets)})
            state = self.log.state()
        with scratch_scope(self.spark):
            rows = self.combine(batch.select(*self.schema.names).withColumn("_new", F.lit(1)), self.key)
            rows = stage(rows.withColumn("_bucket", self._bucket(int(state.meta["buckets"]))), "batch")
            touched = [str(r[0]) for r in rows.select("_bucket").distinct().collect()]
            made: dict[str, str] = {}
            base: dict[str, str | None] = {}
            while True:
                before = {b: state.live[b][1] if b in state.live else None for b in touched}
                again = [b for b in touched if b not in made or base[b] != before[b]]
                if again:
                    made |= self._rewrite(rows, state, again)
                    base |= {b: before[b] for b in again}
                unused = [name for name in before.values() if name]
                if self.log.commit(state, made, writer=writer, batch_id=batch_id, unused=unused):
                    return True
                state = self.log.state()
                if state.committed(writer, batch_id):
                    return False

    def sink(self, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that merges what ``prepare`` makes of each micro-batch; the query is named by its checkpoint."""
        writer = writer_of(checkpoint)

        def process(batch: DataFrame, batch_id: int) -> None:
            self.merge(prepare(batch), writer, batch_id)

        return process

    def vacuum(self, keep: int) -> int:
        """Delete the folders of buckets that the last ``keep`` versions do not read; returns how many went."""
        return self.log.vacuum(keep)
