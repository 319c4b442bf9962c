import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cardwarden import session
from cardwarden.operators import dictionary as dic
from cardwarden.operators import model, rules
from cardwarden.operators.features import ENCODED, build_features
from cardwarden.operators.verdicts import verdict, verdict_within
from cardwarden.schemas import RAW_TXN
from cardwarden.session import settings
from cardwarden.sources import read_latest
from cardwarden.streaming import (
    append_stream,
    feature_stream,
    foreach_batch_stream,
    load_dictionary,
    refreshing_features,
    save_dictionary,
    upsert_stream,
    verdict_stream,
    verdict_within_stream,
)
from cardwarden.streaming.features import streaming_source


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.fixture
def landing(spark, raw_rows, tmp_path):
    """Raw transactions arriving in two files."""
    path = str(tmp_path / "landing")
    for part in ("trans_num < 'c'", "trans_num >= 'c'"):
        raw_rows.where(part).coalesce(1).write.mode("append").parquet(path)
    return path + "/"


def test_stream_equals_batch(spark, raw_rows, landing, tmp_path):
    dictionaries = dic.build_dictionaries(raw_rows, ENCODED)
    stream = feature_stream(streaming_source(spark, landing, RAW_TXN, 1), dictionaries)
    append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = build_features(raw_rows, dictionaries, "trans_num")
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(batch)


def test_unseen_category_drops_on_the_stream(spark, raw_rows, landing, tmp_path):
    dictionaries = dic.build_dictionaries(raw_rows.where("category <> 'travel'"), ENCODED)
    stream = feature_stream(streaming_source(spark, landing, RAW_TXN), dictionaries)
    append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["trans_num"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a", "b", "d"}


def test_restart_continues_from_the_checkpoint(spark, raw_rows, landing, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    source = streaming_source(spark, landing, RAW_TXN).select("trans_num")
    append_stream(source, out, checkpoint).awaitTermination()
    raw_rows.where("trans_num = 'a'").withColumn("trans_num", F.lit("new")).coalesce(1) \
        .write.mode("append").parquet(landing)
    append_stream(source, out, checkpoint).awaitTermination()
    got = sorted(r["trans_num"] for r in spark.read.parquet(out).collect())
    assert got == ["a", "b", "c", "d", "new"]


def test_continuous_schedule(spark, landing, tmp_path):
    source = streaming_source(spark, landing, RAW_TXN).select("trans_num")
    query = append_stream(source, str(tmp_path / "out"), str(tmp_path / "cp"), every="1 second")
    query.processAllAvailable()
    assert query.isActive
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_refreshed_dictionaries_lose_no_row(spark, raw_rows, landing, tmp_path):
    paths = {c: str(tmp_path / c) for c in ENCODED}
    for column, d in dic.build_dictionaries(raw_rows.where("trans_num = 'b'"), ENCODED).items():
        save_dictionary(d, paths[column])
    process = refreshing_features(paths, str(tmp_path / "features"), str(tmp_path / "cp"))
    source = streaming_source(spark, landing, RAW_TXN, 1)
    foreach_batch_stream(source, process, str(tmp_path / "cp")).awaitTermination()

    def entries():
        return {r[0]: r[1] for r in load_dictionary(spark, paths["category"], "category", "cat_id").collect()}

    features = spark.read.parquet(str(tmp_path / "features"))
    assert features.count() == 4
    first = entries()
    assert first["music"] == 0 and sorted(first.values()) == [0, 1, 2]
    process(raw_rows.where("trans_num >= 'c'"), 1)  # a replayed batch changes nothing
    assert entries() == first and spark.read.parquet(str(tmp_path / "features")).count() == 4

    # A query with a checkpoint of its own adds to both and replaces nothing.
    other = refreshing_features(paths, str(tmp_path / "features"), str(tmp_path / "cp2"))
    more = raw_rows.where("trans_num = 'a'").withColumns({"trans_num": F.lit("e"), "category": F.lit("zoo")})
    scratch = Path(session.scratch_path(spark, "x")).parent
    before = set(scratch.iterdir())
    other(more, 0)
    assert entries() == first | {"zoo": 3} and set(scratch.iterdir()) <= before
    assert spark.read.parquet(str(tmp_path / "features")).count() == 5
    other(more.withColumn("trans_num", F.lit("f")), 1)
    assert entries() == first | {"zoo": 3}
    folders = {p.parent.name for p in (tmp_path / "category").glob("writer=*/batch_id=*")}
    assert len(folders) == 3 and len(list((tmp_path / "category").glob("writer=*/batch_id=*"))) == 4


def test_upsert_stream_keeps_the_latest(spark, tmp_path):
    landing = str(tmp_path / "in")
    schema = "k string, t int, v string"
    for rows in ([("a", 1, "a1"), ("a", 3, "a3")], [("a", 2, "a2"), ("b", 1, "b1")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    source = streaming_source(spark, landing + "/", spark.createDataFrame([], schema).schema, 1)
    target = str(tmp_path / "t")
    upsert_stream(source, target, "k", ["t"], str(tmp_path / "cp")).awaitTermination()
    got = {r["k"]: r["v"] for r in read_latest(spark, target, source.schema, "k", ["t"]).collect()}
    assert got == {"a": "a3", "b": "b1"}


def test_deadline_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    txn = [(f"t{i}", t0 + dt.timedelta(seconds=7 * i)) for i in range(60)]
    status = [
        (f"t{i}", t0 + dt.timedelta(seconds=7 * i + i * 3 % 100), "REJECTED" if i % 2 else "AUTHORIZED")
        for i in range(60) if i % 5
    ]
    end = t0 + dt.timedelta(days=1)
    t_schema, s_schema = "trans_num string, ts timestamp", "txn_num string, status_ts timestamp, txn_status string"
    t_in, s_in = str(tmp_path / "t"), str(tmp_path / "s")
    spark.createDataFrame(txn, t_schema).coalesce(1).write.parquet(t_in)
    spark.createDataFrame(status, s_schema).coalesce(1).write.parquet(s_in)
    answers = verdict_within_stream(
        streaming_source(spark, t_in + "/", spark.read.parquet(t_in).schema),
        streaming_source(spark, s_in + "/", spark.read.parquet(s_in).schema),
    )
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    with settings(spark, spark__sql__shuffle__partitions="2"):
        append_stream(answers, out, checkpoint).awaitTermination()
        early = spark.read.parquet(out).count()
        spark.createDataFrame([("end", end)], t_schema).write.mode("append").parquet(t_in)
        spark.createDataFrame([("end", end, "x")], s_schema).write.mode("append").parquet(s_in)
        append_stream(answers, out, checkpoint).awaitTermination()
    got = spark.read.parquet(out).where("trans_num <> 'end'")
    expected = verdict_within(
        spark.createDataFrame(txn, t_schema), spark.createDataFrame(status, s_schema)
    )
    assert early < 60 and rows_of(got) == rows_of(expected)


def test_verdict_stream_equals_batch(spark, raw_rows, landing, tmp_path):
    """Features, limits, model, rules and verdict in one streaming query."""
    dictionaries = dic.build_dictionaries(raw_rows, ENCODED)
    limits = spark.createDataFrame(
        [("42", 10.0, 500.0, 1.0), ("3000000000000000017", 1e6, 1000.0, 1.0)],
        "cc_num string, ACCT_AVL_CASH_BEFORE_AMT double, ACCT_CL_AMT double, AVG_DLY_AUTHZN_AMT double",
    )
    features = build_features(raw_rows, dictionaries, "trans_num")
    fitted = model.train(features, trees=1)
    stream = verdict_stream(streaming_source(spark, landing, RAW_TXN, 1), dictionaries, limits, fitted)
    target = str(tmp_path / "v")
    upsert_stream(stream, target, "txn_num", ["txn_status"], str(tmp_path / "cp")).awaitTermination()
    got = read_latest(spark, target, stream.schema, "txn_num", ["txn_status"])
    scored = model.score(rules.attach_rules(features, limits), fitted)
    assert rows_of(got) == rows_of(verdict(rules.combine(rules.cascade(scored))))
    statuses = {r["txn_num"]: r["txn_status"] for r in got.collect()}
    assert statuses["b"] == "REJECTED" and statuses["d"] == "REJECTED" and statuses["a"] == "AUTHORIZED"


def test_change_feed_and_messages_as_streams(spark, raw_rows, tmp_path):
    """Inserts of a change feed out as JSON messages, and the messages back into features."""
    from cardwarden.schemas import CHANGE
    from cardwarden.sources import from_messages, read_source, to_messages, unwrap_changes

    feed, topic, out = (str(tmp_path / n) for n in ("feed", "topic", "out"))
    raw_rows.select(
        F.when(F.col("trans_num") == "b", "delete").otherwise("insert").alias("operationType"),
        F.struct("*").alias("fullDocument"),
    ).write.json(feed)
    changes = unwrap_changes(read_source(spark, CHANGE, "json", feed, streaming=True))
    messages = to_messages(changes, "trans_num")
    append_stream(messages, topic, str(tmp_path / "cp1"), format="json").awaitTermination()
    arrived = read_source(spark, messages.schema, "json", topic, streaming=True)
    dictionaries = dic.build_dictionaries(raw_rows, ENCODED)
    features = feature_stream(from_messages(arrived, RAW_TXN), dictionaries)
    append_stream(features, out, str(tmp_path / "cp2")).awaitTermination()
    expected = build_features(raw_rows.where("trans_num <> 'b'"), dictionaries, "trans_num")
    assert rows_of(spark.read.parquet(out)) == rows_of(expected)
