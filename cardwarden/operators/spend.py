"""Spend per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import number

#: Amounts are added as exact decimals, so totals do not depend on the order of rows.
MONEY = "decimal(28,8)"


def spend_parts(df: DataFrame, by: tuple[str, ...] = ("first", "last")) -> DataFrame:
    """Sums per user that can be added to those of other records: amounts, records with one, transactions, frauds."""
    typed = df.select(
        *by, number("amt", MONEY).alias("amt"), number("is_fraud", "int").alias("is_fraud")
    )
    return typed.groupBy(*by).agg(
        F.sum("amt").alias("amount"),
        F.count("amt").alias("priced"),
        F.sum(F.lit(1)).alias("ntxn"),
        F.sum("is_fraud").alias("ftxn"),
    )


def spend_of(parts: DataFrame, by: tuple[str, ...] = ("first", "last")) -> DataFrame:
    """The report from its sums."""
    total = F.col("amount").cast("double")
    return parts.select(*by, total.alias("total"), F.try_divide(total, F.col("priced")).alias("avg_txn_amt"), "ntxn", "ftxn")


def user_spend(df: DataFrame, by: tuple[str, ...] = ("first", "last")) -> DataFrame:
    """Total and average amount, transactions and frauds per user, from raw or typed records."""
    return spend_of(spend_parts(df, by), by)
