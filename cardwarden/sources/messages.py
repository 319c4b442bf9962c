"""JSON messages, as a topic carries them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_messages(df: DataFrame, key: str) -> DataFrame:
    """One message per row: the key, and the whole row as JSON."""
    return df.select(
        F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value")
    )


def from_messages(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Rows from messages; binary payloads are read as UTF-8, absent fields as NULL."""
    return df.select(F.from_json(F.col(value).cast("string"), schema).alias("m")).select("m.*")
