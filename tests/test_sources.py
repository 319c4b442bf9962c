import json

import pytest
from pyspark.sql import functions as F

from cardwarden import session
from cardwarden.operators import find, quality
from cardwarden.operators.features import training_set
from cardwarden.operators.ranking import latest_rows
from cardwarden.schemas import CHANGE, RAW_TXN
from cardwarden import sources as src


def test_field_a_record_lacks_is_null(spark, tmp_path):
    path = tmp_path / "txn.json"
    path.write_text("\n".join(json.dumps(r) for r in (
        {"trans_num": "1", "job": "x", "amt": "1.5"}, {"trans_num": "2", "amt": "2"})))
    rows = {r["trans_num"]: r for r in src.read_source(spark, RAW_TXN, "json", str(path)).collect()}
    assert rows["1"]["job"] == "x" and rows["2"]["job"] is None and rows["2"]["amt"] == "2"


def test_collection_is_overwritten(spark, tmp_path):
    path = str(tmp_path / "c")
    for n in (3, 2):
        src.write_collection(spark.range(n), path)
    assert src.read_source(spark, path=path).count() == 2


def test_bucketed_tables_join_without_a_shuffle(spark):
    rows = spark.range(200).select(
        F.col("id").cast("string").alias("_id"), (F.col("id") % 2).cast("int").alias("is_fraud"),
        (F.col("id") * 2.0).alias("amt"),
    )
    labels = src.write_table(rows.select("_id", "is_fraud"), "labels_b", bucket_by="_id", buckets=4)
    features = src.write_feature_table(rows, "features_b", "_id", bucket_by="_id", buckets=4)
    assert features.columns == ["_id", "amt"]
    with session.settings(spark, spark__sql__autoBroadcastJoinThreshold="-1",
                          spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        joined = training_set(labels, features)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.columns == ["is_fraud", "amt"] and joined.count() == 200
    assert src.read_table(spark, "labels_b").count() == 200


def test_training_set_keeps_labels_without_features(spark):
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "_id string, is_fraud int")
    features = spark.createDataFrame([("a", 2.0)], "_id string, amt double")
    rows = training_set(labels, features).orderBy("is_fraud").collect()
    assert [tuple(r) for r in rows] == [(0, None), (1, 2.0)]


def test_primary_key_is_checked(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 0), ("a", 1), (None, 2)], "_id string, v int")
    assert {(r[0], r[1]) for r in quality.key_violations(rows, "_id").collect()} == {("a", 2), (None, 1)}
    with pytest.raises(ValueError, match="no primary key"):
        src.write_feature_table(rows, "never", "_id")
    assert not spark.catalog.tableExists("never")


def test_new_only(spark):
    old = spark.createDataFrame([("a",)], "k string")
    new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in src.new_only(new, old, "k").collect()] == [("b", 2)]


def test_changes(spark, raw_rows):
    feed = raw_rows.select(
        F.expr("case trans_num when 'a' then 'insert' when 'b' then 'update' else 'delete' end").alias("operationType"),
        F.struct("*").alias("fullDocument"),
    )
    assert feed.schema.fieldNames() == CHANGE.fieldNames()
    assert {r["trans_num"] for r in src.unwrap_changes(feed).collect()} == {"a", "b"}
    assert {r["trans_num"] for r in src.unwrap_changes(feed, ["insert"]).collect()} == {"a"}
    keys = spark.createDataFrame([("b",), ("c",)], "trans_num string")
    assert [r["trans_num"] for r in src.changes_for(feed, keys, "trans_num").collect()] == ["b"]


def test_messages_round_trip(spark, raw_rows):
    messages = src.to_messages(raw_rows, "trans_num")
    assert messages.columns == ["key", "value"]
    binary = messages.withColumn("value", F.col("value").cast("binary"))
    assert sorted(src.from_messages(binary, RAW_TXN).collect(), key=str) == sorted(raw_rows.collect(), key=str)


def test_upserts_replays_and_compaction(spark, tmp_path):
    target = str(tmp_path / "t")
    schema = spark.createDataFrame([("", 0, "")], "k string, t int, v string").schema
    batches = [[("a", 1, "a1"), ("b", 5, "b5"), ("b", 4, "b4")], [("a", 2, "a2"), ("b", 3, "b3"), ("c", 1, "c1")]]

    def latest(path):
        return {r["k"]: r["v"] for r in src.read_latest(spark, path, schema, "k", ["t"]).collect()}

    for batch_id in (0, 1, 1):  # the second batch is replayed
        rows = spark.createDataFrame(batches[batch_id], schema)
        src.append_batch(latest_rows(rows, "k", ["t"]), target, batch_id)
    assert latest(target) == {"a": "a2", "b": "b5", "c": "c1"}
    assert src.read_batches(spark, target, schema).count() == 5
    assert src.read_batches(spark, target, schema, before=1).count() == 2
    assert src.read_batches(spark, target, schema, before=0, writer="other").count() == 5
    assert src.compact(spark, target, schema, "k", ["t"]) == 2
    assert latest(target) == {"a": "a2", "b": "b5", "c": "c1"}
    assert src.read_batches(spark, target, schema).count() == 3
    # The writer goes on after, or replays a batch that has been merged.
    src.append_batch(latest_rows(spark.createDataFrame(batches[1], schema), "k", ["t"]), target, 1)
    src.append_batch(spark.createDataFrame([("a", 2, "a2-later"), ("b", 1, "b1")], schema), target, 2)
    assert latest(target) == {"a": "a2-later", "b": "b5", "c": "c1"}
    # The replay was no new batch, so the merged one and the later one are there.
    assert src.compact(spark, target, schema, "k", ["t"]) == 2 and src.compact(spark, target, schema, "k", ["t"]) == 0
    assert latest(target) == {"a": "a2-later", "b": "b5", "c": "c1"}


def test_the_verdict_written_last_stands(spark, tmp_path):
    """REJECTED first, then AUTHORIZED, in one query and from a new one whose batches begin at 0 again."""
    target = str(tmp_path / "t")
    schema = spark.createDataFrame([("", "")], "txn_num string, txn_status string").schema
    for checkpoint, batch_id, status in (("a", 7, "REJECTED"), ("a", 8, "AUTHORIZED"), ("b", 0, "REJECTED"), ("c", 0, "AUTHORIZED")):
        rows = spark.createDataFrame([("t", status)], schema)
        src.upsert_sink(target, "txn_num", ["txn_status"], checkpoint)(rows, batch_id)
        assert src.read_latest(spark, target, schema, "txn_num", []).first()["txn_status"] == status


def test_finds(spark):
    rows = spark.createDataFrame([(f"{i % 3}@x", i) for i in range(300)], "email string, n int")
    assert [r["n"] for r in find.bounded_find(rows, "n").collect()] == list(range(100))
    assert find.preview(rows, "n").count() == 10
    assert find.find_one(rows, "email", "2@x", "n").first()["n"] == 2
    asked = spark.createDataFrame([("1@x",), ("9@x",), ("1@x",)], "email string")
    assert [tuple(r) for r in find.find_each(rows, asked, "email", "n").collect()] == [("1@x", 1)]
    assert find.row_count(rows).first()["n"] == 300


def test_merchant_pick(spark):
    merchants = spark.createDataFrame(
        [("m", "s1", 2), ("m", "s1", 1), ("m", "s2", 3), ("n", "s1", 4)], "merchant string, street string, zip int")
    picks = spark.createDataFrame([(1, "m", "s1"), (2, "m", "s9")], "p int, merchant string, street string")
    got = find.match_merchant(picks, merchants, "zip").collect()
    assert [(r["p"], r["zip"]) for r in got] == [(1, 1)]
    listed = {r["merchant"]: r["streets"] for r in find.merchant_streets(merchants).collect()}
    assert listed == {"m": ["s1", "s2"], "n": ["s1"]}
    assert [r[0] for r in find.streets_of(merchants, "m").collect()] == ["s1", "s2"]


def test_shared_folder_comes_from_the_session(spark):
    assert session.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    staged = session.stage(spark.range(5))
    assert staged.count() == 5
    assert spark.conf.get("spark.checkpoint.dir") in staged.inputFiles()[0]
