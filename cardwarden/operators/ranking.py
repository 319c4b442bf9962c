"""Row numbers and latest rows without gathering a table or a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def number_rows(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """Add a dense number from 0 in the order of ``order_by``; ``df`` should be a stored table.

    The table is range-partitioned on the order columns. Each partition numbers its own rows
    and adds the size of the partitions before it, of which there is one number per partition.
    """
    order = list(order_by)
    ranged = stage(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.row_number().over(within) - 1 + F.col("_before")).cast("bigint"))
        .drop("_part", "_before")
    )


def _pick(df: DataFrame, key: Sequence[str], chosen: Column) -> DataFrame:
    picked = df.groupBy(*key).agg(chosen.alias("_row"))
    return picked.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def latest_rows(df: DataFrame, key: str | Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The greatest row per key. An aggregate, not a window: tasks reduce their rows before the
    shuffle, so a key with many rows sends one row per task."""
    key = [key] if isinstance(key, str) else list(key)
    return _pick(df, key, F.max_by(F.struct(*df.columns), F.struct(*order_by)))


def first_rows(df: DataFrame, key: str | Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The least row per key, reduced like ``latest_rows``."""
    key = [key] if isinstance(key, str) else list(key)
    return _pick(df, key, F.min_by(F.struct(*df.columns), F.struct(*order_by)))
