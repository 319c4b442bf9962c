"""Bounded reads, look-ups by value, and simple filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .joins import lookup_join
from .ranking import first_rows

# Merchants per page, and rows of a preview.
PAGE_ROWS = 100
PREVIEW_ROWS = 10


def bounded_find(df: DataFrame, order_by: str | Sequence[str], limit: int = PAGE_ROWS) -> DataFrame:
    """The first rows in a fixed order; each task keeps only ``limit`` rows of its own."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*order).limit(limit)


def preview(df: DataFrame, order_by: str | Sequence[str]) -> DataFrame:
    return bounded_find(df, order_by, PREVIEW_ROWS)


def find_one(df: DataFrame, column: str, value, order_by: str) -> DataFrame:
    """The first row whose column equals the value."""
    return df.where(F.col(column) == F.lit(value)).orderBy(order_by).limit(1)


def find_each(
    df: DataFrame, requests: DataFrame, on: str | Sequence[str], order_by: str
) -> DataFrame:
    """``find_one`` for a table of requested values: one row per value found."""
    keys = [on] if isinstance(on, str) else list(on)
    return first_rows(lookup_join(df, requests.select(*keys), keys, "left_semi"), keys, [order_by])


def match_merchant(picks: DataFrame, merchants: DataFrame, order_by: str = "street") -> DataFrame:
    """Each (merchant, street) pick with the first merchant record of that name and street."""
    key = ["merchant", "street"]
    return lookup_join(picks, stage(first_rows(merchants, key, [order_by]), "merchants"), key)


def merchant_streets(merchants: DataFrame) -> DataFrame:
    """The streets of each merchant in order, each once, as a picker lists them."""
    streets = F.sort_array(F.collect_set("street"))
    return merchants.groupBy("merchant").agg(streets.alias("streets"))


def streets_of(merchants: DataFrame, merchant: str) -> DataFrame:
    """The streets of one merchant in order, each once."""
    return merchants.where(F.col("merchant") == merchant).select("street").distinct().orderBy("street")


def fraud_only(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    return df.where(F.col(label) == 1)


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows, as a one-row table."""
    return df.agg(F.count(F.lit(1)).alias("n"))
