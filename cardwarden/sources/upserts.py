"""Upserts into a parquet table: every micro-batch adds its latest rows in a folder of its own,
and readers take the latest row per key.

A batch never rewrites what earlier batches wrote, so its cost follows the batch and not the
table. What is part of the table, and in which order it was written, says its commit log (``commits``): a replayed batch is not committed again, a half-written
folder is never read, and of two writers' rows the one committed later wins, whatever is replayed or restarted in between. ``compact``, run beside
the writers, keeps the number of folders and what a reader has to merge in bounds; ``vacuum`` deletes what it has merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import latest_rows
from .commits import CommitLog, State

#: Columns that say in which version a row came, from which writer and batch.
_ORIGIN = T.StructType([
    T.StructField("written", T.LongType()),
    T.StructField("writer", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])
_COMPACTED = "compacted"


def writer_of(checkpoint: str) -> str:
    """A name for the query with this checkpoint: queries never replace each other's batches."""
    return md5(checkpoint.encode()).hexdigest()[:12]


def _folder(writer: str, batch_id: int) -> str:
    return f"writer={writer}/batch_id={batch_id}"


def append_batch(df: DataFrame, target: str, batch_id: int, writer: str = "batch") -> bool:
    """Add a batch; False, and nothing happens, if this writer has committed it or a later one."""
    log = CommitLog(df.sparkSession, target)
    state = log.state()
    if state.committed(writer, batch_id):
        return False
    folder = _folder(writer, batch_id)
    # What an attempt that ended before its commit has left goes.
    df.drop("written").write.mode("overwrite").parquet(f"{target}/{folder}")
    while not log.commit(state, {folder: None}, writer=writer, batch_id=batch_id):
        state = log.state()
    return True


def append_if_unchanged(df: DataFrame, target: str, state: State, batch_id: int, writer: str) -> bool:
    """Add rows if the table is still at ``state``; False if another writer was first, and nothing is added then.

    Unlike a batch these rows are never taken for a replay: whoever made them has looked at all that the table holds.
    """
    folder = _folder(writer, batch_id)
    if folder in state.live:
        folder = _folder(f"{writer}.{uuid.uuid4().hex[:8]}", batch_id)
    df.write.mode("overwrite").parquet(f"{target}/{folder}")
    return CommitLog(df.sparkSession, target).commit(state, {folder: None})


def replace_all(df: DataFrame, target: str, writer: str) -> None:
    """Make ``df`` the whole table; readers of older versions keep theirs."""
    log = CommitLog(df.sparkSession, target)
    folder = _folder(f"{writer}.{uuid.uuid4().hex[:8]}", -1)
    df.write.parquet(f"{target}/{folder}")
    state = log.state()
    while not log.commit(state, {folder: None}, drop=list(state.live), unused=list(state.live)):
        state = log.state()


def upsert_sink(
    target: str, key: str, order_by: Sequence[str], checkpoint: str
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts into ``target``; ``order_by`` picks within a batch."""
    writer = writer_of(checkpoint)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        append_batch(latest_rows(batch, key, order_by), target, batch_id, writer)

    return upsert


def _stored(spark: SparkSession, target: str, schema: T.StructType, folders: dict[str, int]) -> DataFrame:
    """The rows of some folders with their origin; merged rows keep the version they came in."""
    fields = [f for f in schema.fields if f.name not in _ORIGIN.names]
    full = T.StructType(fields + _ORIGIN.fields)
    if not folders:
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).option("basePath", target).parquet(*[f"{target}/{f}" for f in folders])
    # One row for each folder not merged yet.
    versions = spark.createDataFrame(list(folders.items()), "_folder string, _version long")
    name = F.concat(F.lit("writer="), F.col("writer"), F.lit("/batch_id="), F.col("batch_id").cast("string"))
    rows = rows.withColumn("_folder", name).join(F.broadcast(versions), "_folder", "left")
    return rows.withColumn("written", F.coalesce("written", "_version")).select(*full.names)


def read_batches(
    spark: SparkSession,
    target: str,
    schema: T.StructType,
    before: int | None = None,
    writer: str = "batch",
    state: State | None = None,
) -> DataFrame:
    """All rows committed, with their writer and batch; with ``state``, those of that state.

    With ``before``, this writer's batches from that one on are left out, and those of others stay.
    """
    state = state or CommitLog(spark, target).state()
    rows = _stored(spark, target, schema, {name: version for name, (version, _) in state.live.items()}).drop("written")
    if before is None:
        return rows
    return rows.where((F.col("writer") != writer) | (F.col("batch_id") < before))


def read_latest(
    spark: SparkSession, target: str, schema: T.StructType, key: str, order_by: Sequence[str]
) -> DataFrame:
    """The table as upserted, one row per key: the greatest by ``order_by``, then the last committed."""
    state = CommitLog(spark, target).state()
    rows = _stored(spark, target, schema, {name: version for name, (version, _) in state.live.items()})
    return latest_rows(rows, key, [*order_by, *_ORIGIN.names]).drop(*_ORIGIN.names)


def compact(
    spark: SparkSession, target: str, schema: T.StructType, key: str, order_by: Sequence[str]
) -> int:
    """Merge the batches there are now to one row per key; returns how many folders were merged.

    Writers may go on: their newer batches are left alone, and merged rows keep the version they
    came in, so they win or lose against these as before. The merged folders stay for those who read them, until ``vacuum``. Of two compactions at
    once one gives up.
    """
    log = CommitLog(spark, target)
    state = log.state()
    old = {name: version for name, (version, _) in state.live.items()}
    if len(old) < 2:
        return 0
    merged = latest_rows(_stored(spark, target, schema, old), key, [*order_by, *_ORIGIN.names]).drop("writer", "batch_id")
    folder = _folder(f"{_COMPACTED}.{uuid.uuid4().hex[:8]}", state.version)
    merged.write.parquet(f"{target}/{folder}")
    while not log.commit(state, {folder: None}, drop=list(old), unused=list(old)):
        state = log.state()
        if not old.keys() <= state.live.keys():
            log.files.delete(folder)
            return 0
    return len(old)


def vacuum(spark: SparkSession, target: str, keep: int) -> int:
    """Delete merged folders that the last ``keep`` versions do not read; returns how many went."""
    return CommitLog(spark, target).vacuum(keep)
