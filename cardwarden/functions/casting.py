"""Casts that give NULL on bad input, and NULL-safe flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import as_column


def number(value: str | Column, kind: str) -> Column:
    """Text to a number; text that is no such number becomes NULL instead of failing the job."""
    return as_column(value).try_cast(kind)


def card_number(value: str | Column) -> Column:
    """Card number as an integer of up to 20 digits, as some 19-digit cards are beyond 64 bits."""
    return as_column(value).try_cast("decimal(20,0)")


def card_key(value: str | Column) -> Column:
    """Card number for joins: any length, without the blanks and leading zeros that do not count.
    Card 0 keeps one zero; blank text is no card."""
    digits = F.regexp_replace(F.trim(as_column(value).cast("string")), "^0+(?=.)", "")
    return F.nullif(digits, F.lit(""))


def nan_to_null(value: str | Column) -> Column:
    """NaN sorts above every number in Spark, so a limit of NaN must become NULL before a comparison."""
    return F.nanvl(as_column(value), F.lit(None).cast("double"))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def over(score: str | Column, threshold: float | Column) -> Column:
    """1 where the score is strictly above the threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return flag(nan_to_null(score) > limit)
