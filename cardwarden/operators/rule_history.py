"""Rules and limits as they were when a transaction was made.

Rule sets are few and their conditions are text, so a history of them becomes one expression: each row is judged by the set in force at its time, all sets in one pass.
Limits are many. Each change of a card's limits becomes the time span it holds for, and spans are joined by card and time; adaptive execution splits a hot card.
A row meets the changes of its own card only.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import card_key, card_number, flag
from .rules import RuleSet, _with_flags


def cascade_in_force(df: DataFrame, history: Sequence[tuple[datetime, RuleSet]], ts: str) -> DataFrame:
    """``case``, ``first_rule`` and ``rule_version`` by the set that holds from the last moment at or before ``ts``.

    Before the first set, and without a time, nothing is in force: no rule hits and the version is NULL. Of two sets from the same moment the later in the list holds.
    """
    when = F.col(ts).cast("timestamp_ntz")
    first = version = None
    newest_first = sorted(enumerate(history), key=lambda e: (e[1][0], e[0]), reverse=True)
    for _, (since, rules) in newest_first:
        hit = F.when(F.expr(rules.rules[0].condition), rules.rules[0].name)
        for rule in rules.rules[1:]:
            hit = hit.when(F.expr(rule.condition), rule.name)
        holds = when >= F.lit(since).cast("timestamp_ntz")
        first = F.when(holds, hit) if first is None else first.when(holds, hit)
        version = F.when(holds, rules.version) if version is None else version.when(holds, rules.version)
    if first is None:
        first = version = F.lit(None).cast("string")
    return _with_flags(df, {"first_rule": first, "case": flag(first.isNotNull()), "rule_version": version})


def limit_spans(limits: DataFrame, since: str, on: str = "cc_num") -> DataFrame:
    """Each change of a card's limits with the span it holds for, from ``since`` up to the next change.

    NULL counts as always. Rows of a card from the same moment are one change, the greatest by all columns.
    """
    start = F.coalesce(F.col(since).cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    rows = limits.withColumn("_card", card_key(on)).where(F.col("_card").isNotNull()).withColumn("_from", start)
    rest = [c for c in limits.columns if c not in (on, since)]
    changes = rows.groupBy("_card", "_from").agg(F.max(F.struct(*rest)).alias("_row"))
    later = Window.partitionBy("_card").orderBy("_from")
    return changes.select("_card", "_from", F.lead("_from").over(later).alias("_to"), *[F.col(f"_row.`{c}`") for c in rest])


def limits_in_force(txn: DataFrame, limits: DataFrame, ts: str, since: str, on: str = "cc_num") -> DataFrame:
    """Each transaction with the limits its card had at its time; NULL where there were none.

    Where both sides have a column, the transaction's stays.
    """
    spans = limit_spans(limits, since, on).drop(*[c for c in txn.columns if c != on])
    asked = txn.withColumn("_card_of", card_key(on)).withColumn("_at", F.col(ts).cast("timestamp_ntz"))
    spans = spans.withColumnRenamed("_card", "_of")
    in_force = (F.col("_card_of") == F.col("_of")) & (F.col("_at") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("_at") < F.col("_to")))
    joined = asked.join(spans, in_force, "left").drop("_card_of", "_at", "_of", "_from", "_to")
    return joined.withColumn(on, card_number(on))
