"""One answer per transaction on a stream, against the batch operator."""

import datetime as dt
import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from cardwarden.operators.verdicts import verdict_within
from cardwarden.session import settings
from cardwarden.streaming import append_stream, first_verdict_stream
from cardwarden.streaming.features import streaming_source

T0 = dt.datetime(2024, 1, 1)
TXN, STATUS = "trans_num string, ts timestamp, tag int, amt double", "txn_num string, status_ts timestamp, txn_status string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def rows_of(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def run(spark, tmp_path, slices, delay="10 seconds"):
    """The answers to slices of (transactions, verdicts) that arrive one after the other, each handled by a query that is started anew; and the state rows after each."""
    t_in, s_in, out, checkpoint = (str(tmp_path / n) for n in ("t", "s", "out", "cp"))
    states = []
    for txn, status in slices:
        spark.createDataFrame(txn, TXN).coalesce(1).write.mode("append").parquet(t_in)
        spark.createDataFrame(status, STATUS).coalesce(1).write.mode("append").parquet(s_in)
        answers = first_verdict_stream(
            streaming_source(spark, t_in + "/", spark.read.parquet(t_in).schema), streaming_source(spark, s_in + "/", spark.read.parquet(s_in).schema), delay=delay
        )
        with settings(spark, spark__sql__shuffle__partitions="2"):
            query = append_stream(answers, out, checkpoint)
            query.awaitTermination()
            progress = [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
            states.append([o["numRowsTotal"] for p in progress for o in p["stateOperators"]][-1])
    return spark.read.schema(answers.schema).parquet(out), states


def closing(seconds):
    return [("end", at(seconds), -1, None)], [("end", at(seconds), "x")]


def test_repeated_verdicts_give_one_answer(spark, tmp_path):
    txn = [("a", at(5), 1, 0.1), ("a", at(5), 1, 0.1), ("b", at(5), 2, float("nan")), ("c", at(5.000001), 3, None), ("d", at(5), 4, 1e300), ("e", at(5), 5, 1.0), (None, at(5), 6, 1.0), ("g", None, 7, 1.0)]
    status = [
        ("a", at(9), "REJECTED"), ("a", at(7), "AUTHORIZED"), ("a", at(7), "REJECTED"), ("a", at(7), "AUTHORIZED"), ("a", at(8), "REJECTED"),
        ("b", at(65), "AUTHORIZED"), ("b", at(65.5), "REJECTED"), ("c", at(65.000002), "AUTHORIZED"), ("d", at(4.999), "AUTHORIZED"), ("e", at(6), None), ("e", at(6), "REJECTED"),
        (None, at(6), "AUTHORIZED"), ("g", None, "AUTHORIZED"),
    ]
    got, _ = run(spark, tmp_path, [(txn, status), closing(1000)])
    want = verdict_within(spark.createDataFrame(txn, TXN), spark.createDataFrame(status, STATUS))
    got = got.where("tag > 0")
    assert rows_of(got) == rows_of(want) and got.count() == 8
    assert {r["tag"]: r["txn_status"] for r in got.collect()} == {1: "AUTHORIZED", 2: "AUTHORIZED", 3: None, 4: None, 5: None, 6: None, 7: None}


def test_restarts_late_verdicts_and_state(spark, tmp_path):
    """History in slices of half an hour, out of order within; numbers repeat over slots, verdicts repeat; state does not grow."""
    draw = random.Random(3)
    keys = ["hot"] * 4 + [f"k{i}" for i in range(12)]
    txn = [(draw.choice(keys), at(draw.randrange(0, 3600 * 4) / 2), i, draw.random()) for i in range(700)]
    status = [(k, t + dt.timedelta(seconds=draw.randrange(0, 160) / 2), draw.choice(["REJECTED", "AUTHORIZED"])) for k, t, _, _ in draw.sample(txn, 500)]
    status += draw.sample(status, 100)
    edges = [at(s) for s in (0, 1800, 3600, 5400, 9000)]
    slices = [([t for t in txn if a <= t[1] < b], [s for s in status if a <= s[1] < b]) for a, b in zip(edges, edges[1:], strict=False)]
    slices = [s for s in slices if s[0] and s[1]]
    got, states = run(spark, tmp_path, [*slices, closing(12000)])
    want = verdict_within(spark.createDataFrame(txn, TXN), spark.createDataFrame(status, STATUS))
    assert rows_of(got.where("tag >= 0")) == rows_of(want)
    assert got.where("tag >= 0").groupBy("tag").count().where("count > 1").count() == 0
    assert max(states) < 0.5 * (len(txn) + len(status)) and states[-1] < 12, states


def test_waiting_rows_survive_a_restart_between_question_and_answer(spark, tmp_path):
    first = [("a", at(0), 1, 1.5), ("b", at(1), 2, 2.5)], [("z", at(0), "AUTHORIZED")]
    second = [("c", at(30), 3, 3.5)], [("a", at(50), "REJECTED"), ("a", at(40), "AUTHORIZED")]
    got, states = run(spark, tmp_path, [first, second, closing(1000)], delay="60 seconds")
    assert states[0] > 0
    assert {r["tag"]: (r["txn_status"], r["status"], r["amt"]) for r in got.where("tag >= 0").collect()} == {1: ("AUTHORIZED", None, 1.5), 2: (None, "Failed", 2.5), 3: (None, "Failed", 3.5)}
    assert not list(Path(tmp_path).glob("out/*.tmp"))


def test_times_keep_their_digits(spark, tmp_path):
    txn = [("a", dt.datetime(2024, 1, 1, 0, 0, 0, 123456), 1, 0.1)]
    got, _ = run(spark, tmp_path, [(txn, [("a", dt.datetime(2024, 1, 1, 0, 0, 1, 654321), "x")]), closing(900)])
    row = got.where(F.col("tag") == 1).first()
    assert row["ts"].microsecond == 123456 and row["status_ts"].microsecond == 654321


def test_any_state_store_will_do(spark, tmp_path):
    txn, status = [("a", at(5), 1, 0.1), ("b", at(5), 2, 0.2)], [("a", at(9), "REJECTED"), ("a", at(7), "AUTHORIZED")]
    store = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    with settings(spark, spark__sql__streaming__stateStore__providerClass=store):
        got, _ = run(spark, tmp_path, [(txn, status), closing(1000)])
    assert {r["tag"]: r["txn_status"] for r in got.where("tag > 0").collect()} == {1: "AUTHORIZED", 2: None}


def test_the_query_keeps_rows_without_a_time(spark, tmp_path):
    from cardwarden.plans.queries import QUERIES

    rows = [(i, None if i == 3 else at(i * 100), 1, "view", 300.0, None) for i in range(1, 8)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r["trans_num"]: (r["txn_status"], r["reason"]) for r in QUERIES["verdict_first_stream"](spark, str(tmp_path)).collect()}
    assert len(got) == 7 and got["3"] == (None, "timeout") and got["5"] == (None, "timeout") and got["4"][0] == "REJECTED"
