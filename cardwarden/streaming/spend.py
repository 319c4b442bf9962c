"""Spend per user, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.spend import spend_of, spend_parts
from ..sources.merged import MergedTable, add_up
from .sinks import foreach_batch_stream

BY = ("first", "last")


def spend_table(spark: SparkSession, target: str, buckets: int = 16) -> MergedTable:
    """The sums behind the report, in ``target``. Each user is one row, however many transactions there have been."""
    schema = T.StructType([
        *[T.StructField(c, T.StringType()) for c in BY], T.StructField("amount", T.DecimalType(38, 8)),
        *[T.StructField(c, T.LongType()) for c in ("priced", "ntxn", "ftxn")],
    ])
    return MergedTable(spark, target, schema, BY, add_up, buckets)


def spend_stream(raw: DataFrame, table: MergedTable, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Add a stream of records, raw or typed, to the table; a replayed micro-batch is not added twice."""
    return foreach_batch_stream(raw, table.sink(checkpoint, spend_parts), checkpoint, every)


def current_spend(table: MergedTable) -> DataFrame:
    """The report over all that has been added, as ``user_spend`` gives it."""
    return spend_of(table.read())
