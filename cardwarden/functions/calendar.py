"""Dates and times of a transaction.

Local timestamps (``timestamp_ntz``) keep the written clock fields whatever the session's
time zone. Text in any other than the formats in use is no time and no date, hence NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import as_column


# How times and dates are written.
CLOCK_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
EPOCH = "1970-01-01 00:00:00"


def txn_time(value: str | Column) -> Column:
    """``2019-01-01 00:12:34`` or ``2023-02-14T06:36:30.258Z``, the fraction or not."""
    text = as_column(value).cast("string")
    known = text.rlike(CLOCK_PATTERN) | text.rlike(ISO_PATTERN)
    return F.when(known, F.regexp_replace(text, "Z$", "")).try_cast("timestamp_ntz")


def birth_date(value: str | Column) -> Column:
    """``1980-12-21``."""
    text = as_column(value).cast("string")
    return F.when(text.rlike(DATE_PATTERN), text).try_cast("date")


def calendar_fields(ts: str | Column) -> dict[str, Column]:
    ts = as_column(ts)
    return {"hour": F.hour(ts), "day": F.dayofmonth(ts), "month": F.month(ts)}


def age(ts: str | Column, born: str | Column) -> Column:
    """Difference of the calendar years; the birthday within the year plays no part."""
    return F.year(as_column(ts)) - F.year(as_column(born))


def clock_text(ts: str | Column) -> Column:
    return F.date_format(as_column(ts), "yyyy-MM-dd HH:mm:ss")


def epoch_text(ts: str | Column) -> Column:
    """Seconds since 1970 as text, milliseconds rounded to the nearest second. A local time counts
    from a local 1970, so the session's time zone has no part in it."""
    local = as_column(ts).cast("timestamp_ntz")
    millis = F.timestamp_diff("MILLISECOND", F.lit(EPOCH).cast("timestamp_ntz"), local)
    return F.floor((millis + 500) / 1000).cast("string")
