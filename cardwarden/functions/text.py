"""Names, merchants and contact fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import as_column

# The merchant prefix, the e-mail pattern and the messages shown to users.
MERCHANT_PREFIX = "fraud_"
EMAIL_PATTERN = r"\S+@\S+\.\S+"
EMAIL_EMPTY = "Email can't be empty."
EMAIL_INVALID = "Ooops! We need a valid email address."
NAME_EMPTY = "Name can't be empty."


def merchant_name(value: str | Column) -> Column:
    """Display name: the first ``fraud_`` goes, any later one stays."""
    return F.regexp_replace(as_column(value), f"(?s)^(.*?){MERCHANT_PREFIX}", "$1")


def full_name(first: str | Column, last: str | Column) -> Column:
    return F.concat_ws(" ", as_column(first), as_column(last))


def email_problem(value: str | Column) -> Column:
    """Empty text for a good address, otherwise what is wrong with it."""
    email = F.coalesce(as_column(value), F.lit(""))
    return (
        F.when(email == "", EMAIL_EMPTY)
        .when(~email.rlike(EMAIL_PATTERN), EMAIL_INVALID)
        .otherwise("")
    )


def name_problem(value: str | Column) -> Column:
    return F.when(F.coalesce(as_column(value), F.lit("")) == "", NAME_EMPTY).otherwise("")
