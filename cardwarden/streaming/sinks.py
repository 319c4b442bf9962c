"""Sinks. Each query has a checkpoint of its own and continues from it after a restart."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..sources.upserts import upsert_sink


def _scheduled(writer: DataStreamWriter, checkpoint: str, every: str | None) -> DataStreamWriter:
    """Run for ever, a micro-batch every ``every``; or, without it, over what is there and stop."""
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def append_stream(
    df: DataFrame, path: str | None, checkpoint: str, every: str | None = None,
    format: str = "parquet", **options: str,
) -> StreamingQuery:
    """Append every finished row exactly once; connectors that need no path get None."""
    writer = df.writeStream.format(format).outputMode("append").options(**options)
    return _scheduled(writer, checkpoint, every).start(path)


def foreach_batch_stream(
    df: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    writer = df.writeStream.outputMode("append").foreachBatch(function)
    return _scheduled(writer, checkpoint, every).start()


def upsert_stream(
    df: DataFrame, target: str, key: str, order_by: Sequence[str], checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Keep the latest row per key in ``target``; read it with ``sources.read_latest``."""
    function = upsert_sink(target, key, order_by, checkpoint)
    return foreach_batch_stream(df, function, checkpoint, every)
