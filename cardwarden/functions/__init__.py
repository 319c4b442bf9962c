"""Column functions: built-in expressions only, the same in batch and in streams."""

from .calendar import age, birth_date, calendar_fields, clock_text, epoch_text, txn_time
from .casting import card_key, card_number, flag, nan_to_null, number, over
from .text import email_problem, full_name, merchant_name, name_problem

__all__ = [
    "age", "birth_date", "calendar_fields", "card_key", "card_number", "clock_text", "email_problem",
    "epoch_text", "flag", "full_name", "merchant_name", "name_problem", "nan_to_null",
    "number", "over", "txn_time",
]
