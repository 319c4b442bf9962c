"""Verdict rows, and the wait for a transaction's verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Verdicts, the deadline in seconds, and the reply when it passes.
REJECTED = "REJECTED"
AUTHORIZED = "AUTHORIZED"
DEADLINE_SECONDS = 60
TIMEOUT_STATUS = "Failed"
TIMEOUT_REASON = "timeout"

#: Length of a time slot in deadlines: longer slots repeat fewer verdicts, shorter ones split a
#: repeated number further.
SLOT_DEADLINES = 10


def verdict(df: DataFrame, key: str = "trans_num", prediction: str = "prediction") -> DataFrame:
    """One status row per scored transaction."""
    return df.select(
        F.col(key).alias("txn_num"),
        F.when(F.col(prediction) == 1, REJECTED).otherwise(AUTHORIZED).alias("txn_status"),
    )


def asked_slot(ts: str, seconds: int) -> Column:
    """Number of the time slot, ten deadlines long, a transaction falls in."""
    length = seconds * SLOT_DEADLINES
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return _slot(micros, length)


def answered_slots(ts: str, seconds: int) -> Column:
    """The slots of all transactions a verdict may answer: its own, and the one a deadline earlier
    where that differs, which it does for one verdict in ten."""
    length = seconds * SLOT_DEADLINES
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.array_distinct(
        F.array(_slot(micros, length), _slot(micros - F.lit(seconds * 1_000_000), length))
    )


def _slot(micros: Column, length: int) -> Column:
    step = F.lit(length * 1_000_000)
    return ((micros - F.pmod(micros, step)) / step).cast("bigint")


def timeout_reply(in_time: Column) -> list[Column]:
    """``status`` and ``reason``, filled only for transactions without a verdict in time."""
    return [
        F.when(~in_time, F.lit(TIMEOUT_STATUS)).alias("status"),
        F.when(~in_time, F.lit(TIMEOUT_REASON)).alias("reason"),
    ]


def verdict_within(
    txn: DataFrame,
    status: DataFrame,
    seconds: int = DEADLINE_SECONDS,
    key: str = "trans_num",
    ts: str = "ts",
    keyed: bool = False,
) -> DataFrame:
    """Each transaction with its first verdict at or after its time and within the deadline.

    ``keyed`` says that ``status`` holds one verdict per number, as the table an upsert keeps does;
    then a left join answers. Otherwise numbers may repeat on both sides, where a join would pair
    every transaction with every verdict of its number. Then the distinct (number, moment) pairs look
    ahead for their verdict, and each transaction is joined with its pair's answer; adaptive
    execution splits that join where copies of a transaction pile up.
    """
    if keyed:
        return _join_keyed(txn, status, seconds, key, ts)
    asked_at = F.col(ts).cast("timestamp")
    moments = txn.select(F.col(key).alias("_key"), asked_at.alias("_asked_at")).distinct()
    answers = _look_ahead(moments, status, seconds)
    joined = txn.join(
        answers, (F.col(key) == F.col("_key")) & (asked_at == F.col("_asked_at")), "left"
    )
    return joined.select(
        *txn.columns, "status_ts", "txn_status", *timeout_reply(F.col("_key").isNotNull())
    )


def _join_keyed(txn, status, seconds, key, ts):
    verdicts = status.select(
        F.col("txn_num").alias("_txn_num"),
        F.col("status_ts").cast("timestamp").alias("status_ts"),
        "txn_status",
    )
    asked_at = F.col(ts).cast("timestamp")
    in_time = F.col("status_ts").between(asked_at, asked_at + F.expr(f"interval {seconds} seconds"))
    joined = txn.join(verdicts, (F.col(key) == F.col("_txn_num")) & in_time, "left")
    return joined.select(
        *txn.columns, "status_ts", "txn_status", *timeout_reply(F.col("_txn_num").isNotNull())
    )


def _look_ahead(moments, status, seconds):
    """The next verdict in time for each (number, moment) that has one.

    Both tables are laid out by number and time slot, a verdict also in the slot before its own
    where it may still answer that one's moments. Going back in time, the answer is the last verdict
    passed. The work is linear even where a number is repeated on both sides, and a number repeated
    over time spreads over its slots.
    """
    asked = moments.where(F.col("_key").isNotNull() & F.col("_asked_at").isNotNull()).select(
        "_key",
        asked_slot("_asked_at", seconds).alias("_slot"),
        F.col("_asked_at").alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast("string").alias("txn_status"),
    )
    answered = (
        # Copies of a verdict merge before they travel.
        status.select("txn_num", F.col("status_ts").cast("timestamp").alias("_at"), "txn_status")
        .distinct()
        .where(F.col("txn_num").isNotNull() & F.col("_at").isNotNull())
        .select(
            F.col("txn_num").alias("_key"),
            F.explode(answered_slots("_at", seconds)).alias("_slot"),
            "_at",
            F.lit(0).alias("_kind"),
            "txn_status",
        )
    )
    passed = (
        Window.partitionBy("_key", "_slot")
        .orderBy(F.desc("_at"), "_kind", F.desc("txn_status"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = F.when(
        F.col("_kind") == 0, F.struct(F.col("_at").alias("status_ts"), "txn_status")
    )
    return (
        asked.unionByName(answered)
        .withColumn("_next", F.last(seen, ignorenulls=True).over(passed))
        .where(F.col("_kind") == 1)
        .where(F.col("_next.status_ts") <= F.col("_at") + F.expr(f"interval {seconds} seconds"))
        .select("_key", F.col("_at").alias("_asked_at"), "_next.status_ts", "_next.txn_status")
    )
