"""Stored history as a stream of rows in the order of their times.

A file source takes files as they lie there, in any order of the rows' times, so no delay but the whole time range would be safe, and a join's state would hold it all.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_path

#: Rows that arrive at once, about, and those of them in a part of the state.
SLICE_ROWS = 3_000_000
PART_ROWS = 250_000

#: Row groups are small, so that a slice, a single file, is read by several tasks.
_ROW_GROUP = {"parquet.block.size": str(1024 * 1024)}


def slice_parts(rows: int, slice_rows: int = SLICE_ROWS, part_rows: int = PART_ROWS) -> int:
    """Parts for the state of one slice, of a table of so many rows."""
    return max(2, -(-min(rows, slice_rows) // part_rows))


def time_slices(df: DataFrame, rows: int, ts: str = "ts", slice_rows: int = SLICE_ROWS) -> Iterator[DataFrame]:
    """``df``, a table of ``rows`` rows, in slices of time of about ``slice_rows`` rows, in order. Rows without a time come first.

    One shuffle lays the table out, however many slices there are. The hash only breaks ties, so rows of one moment may go to several slices.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "slices")
    n = max(1, -(-rows // slice_rows))
    moment = F.col(ts).cast("timestamp")
    laid_out = df.repartitionByRange(n, moment, F.xxhash64(*df.columns)).withColumn("_slice", F.spark_partition_id())
    laid_out.write.partitionBy("_slice").parquet(path)
    slices = spark.read.schema(laid_out.schema).parquet(path)
    for i in range(n):
        yield slices.where(F.col("_slice") == i).drop("_slice")


def feed_in_order(slices: Iterator[DataFrame], landing: str, running: StreamingQuery) -> None:
    """Hand the slices to a running query that reads ``landing``, each when the one before is done; then stop the query.

    A slice is a single file and so appears as a whole: were it seen in parts, rows of a later part might be late.
    """
    try:
        for each in slices:
            each.coalesce(1).write.options(**_ROW_GROUP).mode("append").parquet(landing)
            running.processAllAvailable()
    finally:
        running.stop()
