"""Checks on contact fields and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import email_problem, full_name, name_problem


def contact_quality(df: DataFrame) -> DataFrame:
    """Add what is wrong with the e-mail address and the name; empty where nothing is."""
    name = full_name("first", "last")
    return df.withColumns({
        "email_error": email_problem("email"),
        "name_error": name_problem(F.trim(name)),
    })


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Key values that break a primary key: NULL, or held by more than one row."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) | F.col(key).isNull())
    )


def require_primary_key(df: DataFrame, key: str) -> None:
    """Raise if ``key`` does not identify the rows of ``df``."""
    bad = key_violations(df, key).head(3)
    if bad:
        raise ValueError(f"{key} is no primary key: {[tuple(row) for row in bad]}")
