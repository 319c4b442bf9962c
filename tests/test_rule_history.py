"""Rules and limits of the time of a transaction."""

import datetime as dt

from cardwarden.operators.rule_history import cascade_in_force, limit_spans, limits_in_force
from cardwarden.operators.rules import Rule, RuleSet

D = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
TXN = "trans_num string, cc_num string, amt double, ts timestamp_ntz"


def test_sets_change_on_the_moment(spark):
    history = [(D(5), RuleSet("b", (Rule("any", "amt > 0"),))), (D(2), RuleSet("a", (Rule("big", "amt > 10"), Rule("huge", "amt > 5")))), (D(5), RuleSet("c", (Rule("same day", "amt > 7"),)))]
    txn = [("1", "1", 20.0, D(1)), ("2", "1", 20.0, D(2)), ("3", "1", 7.0, D(4, 23)), ("4", "1", 7.0, D(5)), ("5", "1", 8.0, D(9)), ("6", "1", float("nan"), D(3)), ("7", "1", 20.0, None)]
    got = {r["trans_num"]: (r["first_rule"], r["case"], r["rule_version"]) for r in cascade_in_force(spark.createDataFrame(txn, TXN), history, "ts").collect()}
    assert got == {
        "1": (None, 0, None), "2": ("big", 1, "a"), "3": ("huge", 1, "a"), "4": (None, 0, "c"), "5": ("same day", 1, "c"), "6": (None, 0, "a"), "7": (None, 0, None),
    }
    none = cascade_in_force(spark.createDataFrame(txn, TXN), [], "ts").collect()
    assert all(r["case"] == 0 and r["rule_version"] is None for r in none) and len(none) == 7


def test_limits_of_the_time(spark):
    limits = spark.createDataFrame(
        [("1", D(5), 50.0, "x"), ("1", None, 10.0, "x"), ("01", D(9), 90.0, "x"), ("1", D(5), 55.0, "x"), ("2", D(3), 3.0, "x"), (None, D(1), 1.0, "x")],
        "cc_num string, since timestamp_ntz, limit_ double, amt string",
    )
    assert limit_spans(limits, "since").count() == 4
    txn = [("a", "1", 1.0, D(1)), ("b", "1", 1.0, D(5)), ("c", " 1", 1.0, D(8, 23)), ("d", "1", 1.0, D(9)), ("e", "2", 1.0, D(2)), ("f", "3", 1.0, D(4)), ("g", None, 1.0, D(4)), ("h", "1", 1.0, None)]
    got = limits_in_force(spark.createDataFrame(txn, TXN), limits, "ts", "since")
    assert got.columns == ["trans_num", "cc_num", "amt", "ts", "limit_"]
    assert {r["trans_num"]: r["limit_"] for r in got.collect()} == {"a": 10.0, "b": 55.0, "c": 55.0, "d": 90.0, "e": None, "f": None, "g": None, "h": None}
    hot = spark.createDataFrame([(str(i), "1", 1.0, D(1 + i % 20)) for i in range(2000)], TXN)
    assert limits_in_force(hot, limits, "ts", "since").count() == 2000
