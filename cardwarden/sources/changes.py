"""Change feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join

#: The operations whose change record carries the whole document.
DOCUMENT_OPERATIONS = ("insert", "update", "replace")


def unwrap_changes(df: DataFrame, operations: Sequence[str] = DOCUMENT_OPERATIONS) -> DataFrame:
    """The documents of a change feed, without their envelope."""
    return df.where(F.col("operationType").isin(*operations)).select("fullDocument.*")


def changes_for(df: DataFrame, keys: DataFrame, field: str = "txn_num") -> DataFrame:
    """Documents of a change feed whose ``field`` is among the watched keys."""
    return lookup_join(unwrap_changes(df), keys.select(field), field, "left_semi")
