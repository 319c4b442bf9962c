"""One answer for each transaction on a stream: its first verdict in time, or the timeout reply.

A join gives a row for every verdict that fits. Here the transactions and verdicts of a number and time slot are gathered, and each transaction is answered once, when the
watermark has passed the last deadline of its slot; until then an earlier verdict may come. Slots are one deadline long, so an answer waits for at most one deadline more.
State follows the rows of the last deadlines and delay, not the length of the stream.

A verdict that answers transactions of two slots is in both, as in the batch operator: one number over all time is not one state. Copies of a verdict are kept once;
equal transactions are all answered. Transactions without number or time can have no verdict and are answered at once, without state.
The state is that of a plain aggregation, so any state store will do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.verdicts import DEADLINE_SECONDS, timeout_reply


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _first_from(asked: pd.Series, moments: pd.Series) -> pd.Series:
    """For each time asked for, the place of the first of the sorted moments at or after it."""
    return pd.Series([np.searchsorted(m, a).astype("int32") for a, m in zip(asked, moments, strict=True)], dtype=object)


def first_verdict_stream(
    txn: DataFrame,
    status: DataFrame,
    seconds: int = DEADLINE_SECONDS,
    key: str = "trans_num",
    ts: str = "ts",
    delay: str = "10 minutes",
) -> DataFrame:
    """Each transaction once, with its first verdict at or after its time and within the deadline, or the timeout reply.

    ``delay`` bounds how late rows of either stream may be; the slower of the two decides. The rows are those of ``verdict_within``, however often verdicts repeat.
    """
    txn = txn.withColumn(ts, F.col(ts).cast("timestamp"))
    named = F.col(key).isNotNull() & F.col(ts).isNotNull()
    asked = txn.where(named).select(
        F.col(ts).alias("_time"), F.col(key).cast("string").alias("_key"), F.struct(*txn.columns).alias("_row"),
        F.lit(None).cast("struct<status_ts: timestamp, txn_status: string>").alias("_verdict"),
    )
    status = status.where("txn_num is not null and status_ts is not null").withColumn("status_ts", F.col("status_ts").cast("timestamp"))
    answered = status.select(
        F.col("status_ts").alias("_time"), F.col("txn_num").cast("string").alias("_key"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"),
        F.struct("status_ts", F.col("txn_status").cast("string").alias("txn_status")).alias("_verdict"),
    )
    both = asked.withWatermark("_time", delay).unionByName(answered.withWatermark("_time", delay))
    wait = F.expr(f"interval {seconds} seconds")
    # A slot, and the deadline after it, in which verdicts may still answer its transactions.
    both = both.withColumn("_slot", F.window("_time", f"{2 * seconds} seconds", f"{seconds} seconds"))
    both = both.where(F.col("_row").isNull() | (F.col("_time") < F.col("_slot.start") + wait))
    slots = both.groupBy("_key", "_slot").agg(F.collect_list("_row").alias("_rows"), F.sort_array(F.collect_set("_verdict")).alias("_verdicts")).where(F.size("_rows") > 0)
    micros = lambda c: lambda e: F.unix_micros(e[c])
    slots = slots.withColumn("_nth", _first_from(F.transform("_rows", micros(ts)), F.transform("_verdicts", micros("status_ts"))))
    pairs = F.zip_with("_rows", "_nth", lambda row, nth: F.struct(row.alias("row"), F.get("_verdicts", nth).alias("hit")))
    in_time = F.coalesce(F.col("pair.hit.status_ts") <= F.col(f"pair.row.`{ts}`") + wait, F.lit(False))
    rows = slots.select(F.explode(pairs).alias("pair")).select(
        "pair.row.*", F.when(in_time, F.col("pair.hit.status_ts")).alias("status_ts"), F.when(in_time, F.col("pair.hit.txn_status")).alias("txn_status"), *timeout_reply(in_time)
    )
    never = txn.where(~named).select(
        "*", F.lit(None).cast("timestamp").alias("status_ts"), F.lit(None).cast("string").alias("txn_status"), *timeout_reply(F.lit(False))
    )
    return rows.unionByName(never)
