import datetime as dt
import random

import pytest

from cardwarden.operators.verdicts import verdict_within

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def answers(spark, txn, status, **options):
    t = spark.createDataFrame(txn, "trans_num string, ts timestamp_ntz, tag int")
    s = spark.createDataFrame(status, "txn_num string, status_ts timestamp_ntz, txn_status string")
    return {r["tag"]: r for r in verdict_within(t, s, **options).collect()}


@pytest.mark.parametrize("keyed", [False, True])
def test_deadline_edges(spark, keyed):
    got = answers(
        spark,
        [("a", at(5), 1), ("b", at(5), 2), ("c", at(5), 3), ("d", at(5), 4), (None, at(5), 5), ("e", None, 6)],
        [("a", at(65), "AUTHORIZED"), ("b", at(65.001), "AUTHORIZED"), ("c", at(5), "REJECTED"),
         ("d", at(4.999), "AUTHORIZED"), (None, at(6), "AUTHORIZED")],
        keyed=keyed,
    )
    assert got[1]["txn_status"] == "AUTHORIZED" and got[1]["status"] is None
    assert got[3]["txn_status"] == "REJECTED"
    for late in (2, 4, 5, 6):
        assert (got[late]["status"], got[late]["reason"]) == ("Failed", "timeout")
        assert got[late]["txn_status"] is None and got[late]["status_ts"] is None


def test_random_against_brute_force(spark):
    random.seed(5)
    keys = ["hot"] * 5 + [f"k{i}" for i in range(8)]
    txn = [(random.choice(keys), at(random.randrange(0, 900) / 2), i) for i in range(400)]
    status = [
        (random.choice(keys), at(random.randrange(0, 1000) / 2), random.choice(["REJECTED", "AUTHORIZED"]))
        for _ in range(200)
    ]
    status += status[:40]
    got = answers(spark, txn, status)
    assert len(got) == 400
    for key, ts, tag in txn:
        hits = [(s, v) for k, s, v in status if k == key and ts <= s <= ts + dt.timedelta(seconds=60)]
        row = got[tag]
        if hits:
            # status_ts is an instant; in the tests' time zone it reads as the same clock.
            assert row["txn_status"] == min(hits)[1] and row["status"] is None
        else:
            assert row["status"] == "Failed" and row["txn_status"] is None
