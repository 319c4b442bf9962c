"""One query per operator, each over the whole test tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from ..operators import dictionary as dic
from ..operators import features as feat
from ..operators import find, metrics, model, quality, rule_history, rules, runs, spend, verdicts
from ..operators.ranking import latest_rows
from ..schemas import MODEL_FEATURES, RUNS
from ..session import parts_of, scratch_path, settings, stage
from ..sources import (
    IndexedTable,
    MergedTable,
    append_batch,
    apply_changes,
    change_table,
    changes_for,
    compact,
    documents_of,
    from_messages,
    keep_latest,
    load_new_files,
    message_sink,
    new_only,
    read_broken,
    read_good,
    read_latest,
    read_source,
    to_messages,
    unwrap_changes,
    upsert_sink,
    write_collection,
    write_feature_table,
    write_table,
)
from ..streaming import (
    append_stream,
    current_spend,
    feature_stream,
    feed_in_order,
    first_verdict_stream,
    foreach_batch_stream,
    load_dictionary,
    refreshing_features,
    save_dictionary,
    slice_parts,
    spend_stream,
    spend_table,
    time_slices,
    upsert_stream,
    verdict_within_stream,
)
from ..streaming.features import streaming_source
from . import inputs

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.raw_txn(spark, sf_dir)
    dictionaries = dic.build_dictionaries(raw, feat.ENCODED)
    return feat.build_features(feat.with_id(raw), dictionaries)


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.featurize(inputs.raw_txn(spark, sf_dir), "trans_num")


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with score and limits."""
    txn = inputs.with_score(_typed(spark, sf_dir).select("trans_num", "cc_num", "amt"))
    limits = inputs.account_rules(spark, sf_dir).drop("email")
    return rules.attach_rules(txn, limits)


# --- spend, types, text -----------------------------------------------------------------------


@query
def user_spend(spark, sf_dir):
    return spend.user_spend(inputs.raw_txn(spark, sf_dir))


@query
def user_spend_orders(spark, sf_dir):
    return spend.user_spend(inputs.order_txn(spark, sf_dir))


@query
def user_count(spark, sf_dir):
    return find.row_count(spend.user_spend(inputs.raw_txn(spark, sf_dir)))


@query
def typed_txn(spark, sf_dir):
    return _typed(spark, sf_dir)


@query
def calendar_features(spark, sf_dir):
    return feat.calendar_features(inputs.raw_txn(spark, sf_dir)).select(
        "trans_num",
        "trans_date_trans_time",
        F.col("dob").cast("string").alias("dob"),
        "hour",
        "day",
        "month",
        "age",
        fn.card_number("cc_num").cast("string").alias("cc_num"),
        fn.clock_text("trans_date_trans_time").alias("clock"),
        fn.epoch_text("trans_date_trans_time").alias("unix_time"),
    )


@query
def contact_quality(spark, sf_dir):
    return quality.contact_quality(inputs.accounts(spark, sf_dir))


@query
def account_names(spark, sf_dir):
    return inputs.accounts(spark, sf_dir).select(
        "cc_num", fn.full_name("first", "last").alias("full_name")
    )


@query
def merchant_names(spark, sf_dir):
    return inputs.merchants(spark, sf_dir).select(
        "street", "merchant", fn.merchant_name("merchant").alias("display_name")
    )


# --- dictionaries and features ------------------------------------------------------------------


@query
def distinct_categories(spark, sf_dir):
    return dic.distinct_values(inputs.raw_txn(spark, sf_dir), "category")


@query
def gender_dictionary(spark, sf_dir):
    return dic.build_dictionaries(inputs.raw_txn(spark, sf_dir), feat.ENCODED)["gender"]


@query
def category_dictionary(spark, sf_dir):
    return dic.build_dictionary(inputs.raw_txn(spark, sf_dir), "category", "cat_id")


@query
def merchant_dictionary(spark, sf_dir):
    return dic.build_dictionary(inputs.merchants(spark, sf_dir), "street", "street_id")


@query
def dictionary_extend(spark, sf_dir):
    raw = inputs.raw_txn(spark, sf_dir)
    known = stage(dic.build_dictionary(raw.where("is_fraud = '1'"), "category", "cat_id"))
    return dic.extend_dictionary(known, raw, "category", "cat_id")


@query
def featurized_txn(spark, sf_dir):
    return _features(spark, sf_dir)


@query
def featurized_unseen(spark, sf_dir):
    """Values missing in the dictionary keep their rows, with id -1."""
    raw = inputs.raw_txn(spark, sf_dir)
    known = stage(dic.build_dictionary(raw.where("is_fraud = '1'"), "category", "cat_id"))
    return dic.encode(raw.select("trans_num", "category"), known, "category", "cat_id", "left", True)


@query
def feature_table(spark, sf_dir):
    """Written as a catalog table under a checked primary key, and read back."""
    path = scratch_path(spark, "feature_table")
    name = "card_features_" + path.rsplit("-", 1)[1]
    return write_feature_table(stage(_features(spark, sf_dir), "typed"), name, "_id", path=path)


@query
def training_set(spark, sf_dir):
    typed = stage(_features(spark, sf_dir), "typed")
    rows = feat.training_set(typed.select("_id", "is_fraud"), typed.drop("is_fraud"))
    return feat.separate(feat.model_inputs(rows))


@query
def training_set_bucketed(spark, sf_dir):
    """Label and feature tables bucketed by their key, so that the join moves no rows."""
    typed = stage(_features(spark, sf_dir), "typed")
    paths = [scratch_path(spark, f"bucketed_{side}") for side in ("labels", "features")]
    names = [f"{p.rsplit('/', 1)[1].replace('-', '_')}" for p in paths]
    buckets = parts_of(typed)
    labels = write_table(typed.select("_id", "is_fraud"), names[0], paths[0], "_id", buckets)
    features = write_feature_table(
        typed, names[1], "_id", path=paths[1], bucket_by="_id", buckets=buckets
    )
    return feat.training_set(labels, features, exclude=())


@query
def key_violations(spark, sf_dir):
    """Orders keyed by customer: no primary key."""
    return quality.key_violations(inputs.table(spark, sf_dir, "orders"), "o_custkey")


# --- filters and look-ups -----------------------------------------------------------------------


@query
def dirty_typed_txn(spark, sf_dir):
    """Typed features of records with bad fields, in a session of another time zone."""
    with settings(spark, spark__sql__session__timeZone="America/New_York"):
        raw = inputs.dirty_txn(spark, sf_dir)
        epoch = raw.select("trans_num", fn.epoch_text(fn.txn_time("trans_date_trans_time")).alias("unix_time"))
        typed = feat.featurize(raw, "trans_num").drop("gender").join(epoch, "trans_num")
        return stage(typed, "dirty")


@query
def dirty_rule_cascade(spark, sf_dir):
    """Rules on cards 0 and beyond 64 bits, NaN limits, cards with two rule rows, and missing amounts."""
    txn = feat.featurize(inputs.dirty_txn(spark, sf_dir), "trans_num").select("trans_num", "cc_num", "amt")
    # As text before the join, as a card with many rule rows repeats it very often.
    txn = inputs.with_score(txn.withColumn("card", fn.card_number("cc_num").cast("string")))
    flagged = rules.cascade(rules.attach_rules(txn, inputs.dirty_rules(spark, sf_dir), many=True))
    return rules.combine(flagged).select("trans_num", F.col("card").alias("cc_num"), "first_rule", "case", "prediction")


@query
def fraud_only(spark, sf_dir):
    return find.fraud_only(_typed(spark, sf_dir))


@query
def fraud_preview(spark, sf_dir):
    return find.preview(find.fraud_only(_typed(spark, sf_dir)), "trans_num")


@query
def merchant_streets(spark, sf_dir):
    listed = find.merchant_streets(inputs.merchants(spark, sf_dir))
    return listed.select("merchant", F.array_join("streets", "|").alias("streets"))


@query
def merchant_match(spark, sf_dir):
    """The merchant record picked for each order line."""
    key = "concat(case when l_suppkey % 7 = 0 then 'fraud_fraud_' when l_suppkey % 5 = 0 then '' else 'fraud_' end, 'Shop ', cast(l_suppkey % 40 as string))"
    picks = inputs.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        f"{key} as merchant",
        "concat('Supplier#', lpad(cast(l_suppkey as string), 9, '0')) as street",
    )
    return find.match_merchant(picks, inputs.merchants(spark, sf_dir), "zip")


@query
def bounded_find(spark, sf_dir):
    return find.bounded_find(inputs.merchants(spark, sf_dir), ["merchant", "street"])


@query
def account_by_email(spark, sf_dir):
    """The first account of each address asked for."""
    accounts = inputs.accounts(spark, sf_dir)
    asked = stage(inputs.account_rules(spark, sf_dir).select("email").distinct())
    return find.find_each(accounts, asked, "email", "cc_num")


@query
def account_find_one(spark, sf_dir):
    accounts = inputs.accounts(spark, sf_dir)
    return find.find_one(accounts, "email", "machinery@mail.example", "cc_num")


# --- change feeds and messages ------------------------------------------------------------------


def _feed(spark, sf_dir):
    raw = inputs.raw_txn(spark, sf_dir)
    operation = "case category when 'signup' then 'delete' when 'view' then 'update' else 'insert' end"
    return raw.select(F.expr(operation).alias("operationType"), F.struct("*").alias("fullDocument"))


@query
def change_feed_unwrap(spark, sf_dir):
    return unwrap_changes(_feed(spark, sf_dir))


@query
def watched_changes(spark, sf_dir):
    """Verdict changes of the transactions waited for."""
    events = inputs.table(spark, sf_dir, "events")
    feed = inputs.txn_status(events).select(
        F.lit("insert").alias("operationType"), F.struct("*").alias("fullDocument")
    )
    waiting = events.where("value > 100").select(F.col("event_id").cast("string").alias("txn_num"))
    return changes_for(feed, stage(waiting, "waiting"))


@query
def message_roundtrip(spark, sf_dir):
    """Raw transactions through JSON messages on disk and back."""
    raw = inputs.raw_txn(spark, sf_dir)
    path = scratch_path(spark, "messages")
    write_collection(to_messages(raw, "trans_num"), path, "json")
    messages = read_source(spark, T.StructType().add("key", "string").add("value", "string"), "json", path)
    return from_messages(messages, raw.schema)


# --- rules and verdicts -------------------------------------------------------------------------


@query
def rules_attached(spark, sf_dir):
    return _limits(spark, sf_dir).drop("score").withColumn("cc_num", F.col("cc_num").cast("string"))


@query
def rule_cascade(spark, sf_dir):
    return rules.cascade(_limits(spark, sf_dir)).select("trans_num", "case", "first_rule", "rule_version")


@query
def rule_and_vector(spark, sf_dir):
    return rules.rule_vector(_limits(spark, sf_dir)).select(
        "trans_num", "case0", "case1", "case2", "prediction"
    )


@query
def rule_or_model(spark, sf_dir):
    return rules.combine(rules.cascade(_limits(spark, sf_dir))).select("trans_num", "prediction")


@query
def rule_model_review(spark, sf_dir):
    return rules.model_review(rules.cascade(_limits(spark, sf_dir))).select("trans_num", "prediction")


@query
def user_rules(spark, sf_dir):
    """A rule set of the user's own, stored as data and read back."""
    own = rules.RuleSet("own-2", (
        rules.Rule("large", "amt > 200"),
        rules.Rule("burst", "amt > 3 * AVG_DLY_AUTHZN_AMT"),
        rules.Rule("credit", "amt > ACCT_CL_AMT"),
    ))
    path = scratch_path(spark, "rule_sets")
    for rule_set in (rules.LIMIT_RULES, own):
        rules.save_rules(spark, rule_set, path)
    stored = rules.load_rules(spark, path, "own-2")
    return rules.cascade(_limits(spark, sf_dir), stored).select(
        "trans_num", "case", "first_rule", "rule_version"
    )


@query
def rules_in_force(spark, sf_dir):
    """Rule sets that change twice and limits that change once, each transaction by those of its time."""
    txn = inputs.card_events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("trans_num"), F.col("user_id").cast("string").alias("cc_num"), F.col("value").alias("amt"), F.col("ts").cast("timestamp_ntz").alias("ts")
    )
    limits = inputs.dated_rules(spark, sf_dir)
    burst = rules.RuleSet("limits-2", (rules.Rule("large", "amt > 200"), *rules.LIMIT_RULES.rules))
    history = [(datetime(2024, 1, 20), burst), (datetime(2024, 1, 5), rules.LIMIT_RULES)]
    attached = rule_history.limits_in_force(txn, limits, "ts", "valid_from")
    judged = rule_history.cascade_in_force(attached, history, "ts")
    return judged.select("trans_num", F.col("cc_num").cast("string").alias("cc_num"), "ACCT_AVL_CASH_BEFORE_AMT", "first_rule", "case", "rule_version")


@query
def txn_verdict(spark, sf_dir):
    scored = rules.combine(rules.cascade(_limits(spark, sf_dir)))
    return verdicts.verdict(scored)


@query
def verdict_within_60s(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events")
    answers = verdicts.verdict_within(inputs.txn_times(events), inputs.txn_status(events))
    return answers.withColumn("status_ts", F.col("status_ts").cast("timestamp_ntz"))


@query
def verdict_within_60s_keyed(spark, sf_dir):
    """The same from a status table checked to hold one verdict per number."""
    events = inputs.table(spark, sf_dir, "events")
    status = inputs.txn_status(events)
    quality.require_primary_key(status, "txn_num")
    answers = verdicts.verdict_within(inputs.txn_times(events), status, keyed=True)
    return answers.withColumn("status_ts", F.col("status_ts").cast("timestamp_ntz"))


# --- metrics ------------------------------------------------------------------------------------


def _scored(spark, sf_dir):
    return inputs.with_score(_typed(spark, sf_dir).select("trans_num", "amt", "is_fraud"))


@query
def train_test_split(spark, sf_dir):
    raw = inputs.raw_txn(spark, sf_dir).select("trans_num")
    return model.split_side(raw, "trans_num")


@query
def auc_scores(spark, sf_dir):
    return metrics.auc(_scored(spark, sf_dir), "is_fraud", "score").select(F.round("auc", 6).alias("auc"))


@query
def auc_thresholded(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return metrics.auc_thresholded(scored, "is_fraud", "score", rules.THRESHOLD).select(
        F.round("auc", 6).alias("auc")
    )


def _report(spark, sf_dir, threshold):
    predicted = _scored(spark, sf_dir).withColumn("prediction", fn.over("score", threshold))
    lines = metrics.report(metrics.confusion(predicted, "is_fraud", "prediction"))
    return lines.select(
        "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")], "support"
    )


@query
def classification_report_030(spark, sf_dir):
    return _report(spark, sf_dir, 0.3)


@query
def classification_report_050(spark, sf_dir):
    return _report(spark, sf_dir, 0.5)


# --- runs ---------------------------------------------------------------------------------------


def _daily_runs(spark, sf_dir):
    """One evaluation run per day of transactions and threshold."""
    candidates = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(threshold).alias("threshold"))
        for name, threshold in (("strict", 0.3), ("loose", 0.2))
    ])
    scored = inputs.card_events(spark, sf_dir).select(
        F.to_date("ts").alias("day"),
        (F.col("value") / F.lit(500.0)).alias("score"),
        F.expr("cast(event_type = 'error' and value > 100 as int)").alias("is_fraud"),
        F.inline(candidates),
    )
    rates = metrics.auc_thresholded(scored, "is_fraud", "score", F.col("threshold"), ("name", "day"))
    return rates.select(
        F.concat_ws("-", "name", F.col("day").cast("string")).alias("run_id"),
        "name",
        F.col("day").cast("timestamp_ntz").alias("start_time"),
        F.lit(model.TREES).alias("n_estimators"),
        F.round("auc", 6).alias("auc"),
    )


@query
def promotion_gate(spark, sf_dir):
    return runs.promoted(_daily_runs(spark, sf_dir), metric="auc")


@query
def auc_of_days(spark, sf_dir):
    """AUC of all rows from one bounded sketch per day, and what it may be off by."""
    scored = inputs.table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("day"), (F.col("value") / F.lit(500.0)).alias("score"), F.expr("cast(event_type = 'error' and value > 100 as int)").alias("is_fraud")
    )
    days = stage(metrics.score_sketch(scored, "is_fraud", "score", ("day",)), "sketches")
    found = metrics.sketch_auc(metrics.merge_sketches(days))
    return found.select(F.round("auc", 6).alias("auc"), F.round("error", 6).alias("error"))


@query
def latest_run(spark, sf_dir):
    return runs.latest_run(_daily_runs(spark, sf_dir), "loose")


# --- loads and upserts --------------------------------------------------------------------------


@query
def incremental_load(spark, sf_dir):
    """The transactions a table of the first days lacks."""
    raw = inputs.raw_txn(spark, sf_dir)
    early = raw.where("trans_date_trans_time < '2024-01-10 00:00:00'")
    loaded = stage(early.select("trans_num"), "loaded")
    return new_only(raw, loaded, "trans_num")


@query
def incremental_index_load(spark, sf_dir):
    """Three loads, each with the rows before it, into a table whose index says which files may hold a key."""
    raw = inputs.raw_txn(spark, sf_dir).select("trans_num", "cc_num", "category", "amt")
    raw = stage(raw, "raw")
    table = IndexedTable(spark, scratch_path(spark, "indexed"), raw.schema, "trans_num", max(4, parts_of(raw)))
    part = F.pmod(F.xxhash64("trans_num"), F.lit(3))
    for batch_id in range(3):
        table.load(raw.where(part <= batch_id), "loads", batch_id)
    table.load(raw, "loads", 2)
    return table.read()


@query
def messages_quarantined(spark, sf_dir):
    """Messages, some broken, split by a stream: which could be read, and the text of the others."""
    path = scratch_path(spark, "messages")
    schema = T.StructType([T.StructField("trans_num", T.StringType()), T.StructField("amt", T.StringType())])
    inputs.broken_messages(spark, sf_dir).write.parquet(f"{path}/topic")
    arriving = streaming_source(spark, f"{path}/topic/", T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
    foreach_batch_stream(arriving, message_sink(f"{path}/out", schema, f"{path}/checkpoint"), f"{path}/checkpoint").awaitTermination()
    good = read_good(spark, f"{path}/out", schema).select(F.lit("good").alias("side"), F.col("trans_num").alias("key"), F.col("amt").alias("content"))
    return good.unionByName(read_broken(spark, f"{path}/out").select(F.col("reason").alias("side"), "key", F.col("value").alias("content")))


@query
def upsert_latest(spark, sf_dir):
    """Last transaction per card after three upserts whose times overlap."""
    raw = inputs.raw_txn(spark, sf_dir).select("cc_num", "trans_date_trans_time", "trans_num", "amt")
    raw = stage(raw, "arrivals")
    target = scratch_path(spark, "upserts")
    order = ["trans_date_trans_time", "trans_num"]
    first = F.coalesce(F.substring("amt", 1, 1), F.lit(""))
    group = F.when(first < "2", 0).when(first < "4", 1).otherwise(2)
    for batch_id in range(3):
        rows = raw.where(group == batch_id)
        append_batch(latest_rows(rows, "cc_num", order), target, batch_id)
    return read_latest(spark, target, raw.schema, "cc_num", order)


@query
def merged_latest(spark, sf_dir):
    """Last transaction per card in a bucketed table, after three merges whose times overlap and a replay."""
    raw = inputs.raw_txn(spark, sf_dir).select("cc_num", "trans_date_trans_time", "trans_num", "amt")
    raw = stage(raw, "arrivals")
    buckets = max(4, parts_of(raw))
    table = MergedTable(spark, scratch_path(spark, "merged"), raw.schema, "cc_num", keep_latest(["trans_date_trans_time", "trans_num"]), buckets)
    group = F.pmod(F.xxhash64("trans_num"), F.lit(3))
    for batch_id in (0, 1, 2, 1):
        table.merge(raw.where(group == batch_id), "arrivals", batch_id)
    return table.read()


@query
def verdict_replayed(spark, sf_dir):
    """One writer rejects every transaction, another judges them, the first replays its batch: the later verdict stands."""
    path = scratch_path(spark, "replayed")
    judged = stage(verdicts.verdict(rules.combine(rules.cascade(_limits(spark, sf_dir)))), "judged")
    first = judged.withColumn("txn_status", F.lit(verdicts.REJECTED))
    for writer, rows in (("a", first), ("b", judged), ("a", first)):
        upsert_sink(f"{path}/rows", "txn_num", ["txn_status"], f"{path}/{writer}")(rows, 0)
    return read_latest(spark, f"{path}/rows", judged.schema, "txn_num", [])


@query
def change_feed_applied(spark, sf_dir):
    """The collection after a feed of replacements, partial updates and deletes that come late and twice."""
    document = T.StructType([T.StructField("category", T.StringType()), T.StructField("amt", T.DoubleType())])
    feed = stage(inputs.mixed_feed(spark, sf_dir), "feed")
    table = change_table(spark, scratch_path(spark, "changes"), document, T.LongType(), buckets=max(4, parts_of(feed)))
    group = F.pmod(F.xxhash64("at"), F.lit(3))
    for batch_id, part in enumerate((2, 0, 1, 2)):
        apply_changes(table, feed.where(group == part), document, "feed", batch_id)
    return documents_of(table.read())


# --- streams ------------------------------------------------------------------------------------


def _dictionaries(spark, sf_dir):
    return dic.build_dictionaries(inputs.raw_txn(spark, sf_dir), feat.ENCODED)


def _raw_stream(spark, sf_dir):
    return inputs.raw_txn(spark, sf_dir, inputs.event_stream(spark, sf_dir))


def _run_append(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, label)
    append_stream(df, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


@query
def featurized_stream(spark, sf_dir):
    features = feature_stream(_raw_stream(spark, sf_dir), _dictionaries(spark, sf_dir))
    return _run_append(features, "feature_stream")


@query
def stream_dictionary_refresh(spark, sf_dir):
    """Starts with dictionaries of fraud rows only; shown with the ids read back as text."""
    raw = inputs.raw_txn(spark, sf_dir)
    path = scratch_path(spark, "refresh")
    paths = {column: f"{path}/{column}" for column in feat.ENCODED}
    for column, dictionary in dic.build_dictionaries(raw.where("is_fraud = '1'"), feat.ENCODED).items():
        save_dictionary(dictionary, paths[column])
    process = refreshing_features(paths, f"{path}/features", f"{path}/checkpoint")
    stream = foreach_batch_stream(_raw_stream(spark, sf_dir), process, f"{path}/checkpoint")
    stream.awaitTermination()
    rows = spark.read.parquet(f"{path}/features").select("trans_num", "cat_id", "gender_id")
    for column, id_column in feat.ENCODED.items():
        entries = load_dictionary(spark, paths[column], column, id_column)
        rows = dic.lookup_join(rows, entries, id_column).drop(id_column)
    return rows


@query
def upsert_stream_latest(spark, sf_dir):
    """Last transaction per card, kept by a stream."""
    raw = _raw_stream(spark, sf_dir).select("cc_num", "trans_date_trans_time", "trans_num", "amt")
    path = scratch_path(spark, "upsert_stream")
    order = ["trans_date_trans_time", "trans_num"]
    upsert_stream(raw, f"{path}/rows", "cc_num", order, f"{path}/checkpoint").awaitTermination()
    return read_latest(spark, f"{path}/rows", raw.schema, "cc_num", order)


@query
def continuous_copy(spark, sf_dir):
    """A stream over the files another stream wrote, upserted by card: the latest transaction stays."""
    columns = ["cc_num", "trans_num", "trans_date_trans_time", "category", "amt"]
    first = _raw_stream(spark, sf_dir).select(*columns)
    path = scratch_path(spark, "copy")
    append_stream(first, f"{path}/processed", f"{path}/checkpoint_1").awaitTermination()
    second = streaming_source(spark, f"{path}/processed", first.schema)
    order = ["trans_date_trans_time", "trans_num"]
    upsert_stream(second, f"{path}/rows", "cc_num", order, f"{path}/checkpoint_2").awaitTermination()
    compact(spark, f"{path}/rows", first.schema, "cc_num", order)
    return read_latest(spark, f"{path}/rows", first.schema, "cc_num", order)


@query
def dictionary_two_queries(spark, sf_dir):
    """Two queries, each with a checkpoint of its own, extend one dictionary one after the other.

    Every row of both is there, and every value has one id that no other value has.
    """
    raw = inputs.raw_txn(spark, sf_dir)
    path = scratch_path(spark, "two_queries")
    paths = {column: f"{path}/{column}" for column in feat.ENCODED}
    for column, dictionary in dic.build_dictionaries(raw.where("is_fraud = '1'"), feat.ENCODED).items():
        save_dictionary(dictionary, paths[column])
    early = F.coalesce(F.col("category").isin("click", "view"), F.lit(False))
    for name, side in (("first", early), ("second", ~early)):
        process = refreshing_features(paths, f"{path}/features", f"{path}/{name}")
        rows = _raw_stream(spark, sf_dir).where(side)
        foreach_batch_stream(rows, process, f"{path}/{name}").awaitTermination()
    rows = spark.read.parquet(f"{path}/features").select("trans_num", "cat_id")
    entries = stage(load_dictionary(spark, paths["category"], "category", "cat_id"), "entries")
    per_id = entries.groupBy("cat_id").agg(F.count("*").alias("values_of_id"))
    per_value = entries.groupBy("category").agg(F.count("*").alias("ids_of_value"))
    return rows.join(entries, "cat_id").join(per_id, "cat_id").join(per_value, "category").select(
        "trans_num", "category", "values_of_id", "ids_of_value"
    )


@query
def dictionary_queries_at_once(spark, sf_dir):
    """Two queries that run at the same time extend one dictionary: every value has one id, every id one value, and no number is left out."""
    raw = inputs.raw_txn(spark, sf_dir)
    path = scratch_path(spark, "at_once")
    paths = {column: f"{path}/{column}" for column in feat.ENCODED}
    for column, dictionary in dic.build_dictionaries(raw.where("is_fraud = '1'"), feat.ENCODED).items():
        save_dictionary(dictionary, paths[column])
    odd = F.col("trans_num").cast("long") % 2 == 1
    started = []
    for name, side in (("first", F.coalesce(odd, F.lit(False))), ("second", ~F.coalesce(odd, F.lit(False)))):
        process = refreshing_features(paths, f"{path}/features", f"{path}/{name}")
        rows = _raw_stream(spark, sf_dir).where(side)
        started.append(foreach_batch_stream(rows, process, f"{path}/{name}"))
    for each in started:
        each.awaitTermination()
    entries = stage(load_dictionary(spark, paths["category"], "category", "cat_id"), "entries")
    counts = entries.agg(F.count("*").alias("n"), F.countDistinct("category").alias("n_values"), F.countDistinct("cat_id").alias("n_ids"), F.max("cat_id").alias("last")).first()
    dense = counts["n"] == counts["n_values"] == counts["n_ids"] == (counts["last"] or 0) + 1
    rows = spark.read.parquet(f"{path}/features").select("trans_num", "cat_id")
    return dic.lookup_join(rows, entries, "cat_id").select("trans_num", "category", F.lit(dense).alias("is_dense"))


@query
def user_spend_stream(spark, sf_dir):
    """Spend per user, added up by a stream in two runs over a growing set of files."""
    raw = inputs.raw_txn(spark, sf_dir).select("first", "last", "trans_num", "amt", "is_fraud")
    path = scratch_path(spark, "spend")
    table = spend_table(spark, f"{path}/table", max(4, parts_of(raw)))
    early = F.coalesce(F.col("trans_num") % 3 == 0, F.lit(False))
    for batch in (early, ~early):
        raw.where(batch).write.mode("append").parquet(f"{path}/landing")
        spend_stream(streaming_source(spark, f"{path}/landing/", raw.schema), table, f"{path}/checkpoint").awaitTermination()
    return current_spend(table)


@query
def verdict_changed(spark, sf_dir):
    """Each transaction is first REJECTED, then judged anew by a later query: the later verdict stands."""
    path = scratch_path(spark, "changed")
    judged = verdicts.verdict(rules.combine(rules.cascade(_limits(spark, sf_dir))))
    judged = stage(judged, "judged")
    first = judged.withColumn("txn_status", F.lit(verdicts.REJECTED))
    for batch_id, rows in ((1, first), (0, judged)):
        upsert_sink(f"{path}/rows", "txn_num", ["txn_status"], f"{path}/{batch_id}")(rows, batch_id)
    return read_latest(spark, f"{path}/rows", judged.schema, "txn_num", [])


@query
def watched_changes_stream(spark, sf_dir):
    """The change feed filtered as it arrives."""
    events = inputs.event_stream(spark, sf_dir)
    feed = inputs.txn_status(events).select(
        F.lit("insert").alias("operationType"), F.struct("*").alias("fullDocument")
    )
    waiting = inputs.table(spark, sf_dir, "events").where("value > 100")
    watched = waiting.select(F.col("event_id").cast("string").alias("txn_num"))
    return _run_append(changes_for(feed, stage(watched, "waiting")), "watched")


@query
def incremental_files(spark, sf_dir):
    """Two scheduled runs over a growing set of files; the second adds only the new ones."""
    raw = inputs.raw_txn(spark, sf_dir).select("trans_num", "category", "amt")
    path = scratch_path(spark, "files")
    early = F.coalesce(F.col("category").isin("click", "view"), F.lit(False))
    for batch in (early, ~early):
        raw.where(batch).write.mode("append").parquet(f"{path}/landing")
        arrivals = streaming_source(spark, f"{path}/landing/", raw.schema)
        load_new_files(arrivals, f"{path}/loaded", f"{path}/checkpoint")
    return spark.read.schema(raw.schema).parquet(f"{path}/loaded")


@query
def stream_verdicts(spark, sf_dir):
    """Raw stream to verdict rows, with a fixed score in place of a model."""
    features = feature_stream(_raw_stream(spark, sf_dir), _dictionaries(spark, sf_dir))
    limits = inputs.account_rules(spark, sf_dir).drop("email")
    scored = inputs.with_score(rules.attach_rules(features, limits))
    return _run_append(verdicts.verdict(rules.combine(rules.cascade(scored))), "verdicts")


@query
def verdict_within_60s_stream(spark, sf_dir):
    """Stream-stream join over stored history.

    It comes in slices of time, in order, so the delay is short, and the state is that of one slice at most.
    A closing row and a restart let the last deadlines pass.
    """
    path = scratch_path(spark, "deadline")
    batch = inputs.table(spark, sf_dir, "events").select("event_id", "ts", "value")
    last, n = batch.agg(F.max("ts"), F.count("*")).first()
    batch.where("false").write.parquet(f"{path}/events")
    events = streaming_source(spark, f"{path}/events/", batch.schema)
    answers = verdict_within_stream(inputs.txn_times(events), inputs.txn_status(events))
    with settings(spark, spark__sql__shuffle__partitions=str(slice_parts(n))):
        running = append_stream(answers, f"{path}/rows", f"{path}/checkpoint", every="0 seconds")
        feed_in_order(time_slices(batch, n), f"{path}/events", running)
        row = {"event_id": -1, "ts": last + timedelta(days=1)}
        end = spark.createDataFrame([tuple(row.get(c) for c in batch.columns)], batch.schema)
        end.write.mode("append").parquet(f"{path}/events")
        append_stream(answers, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    rows = spark.read.schema(answers.schema).parquet(f"{path}/rows").where("trans_num <> '-1'")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "status_ts")})


@query
def verdict_first_stream(spark, sf_dir):
    """One answer per transaction where verdicts repeat.

    History comes in slices of time, in order; each is handled by a query that goes on from the last one's checkpoint. So the delay is short,
    and the state is that of one slice at most. A closing row lets the last deadlines pass.
    """
    path = scratch_path(spark, "first")
    batch = inputs.table(spark, sf_dir, "events")
    first, last = batch.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / 3
    edges = [first, first + step, first + 2 * step, last + timedelta(seconds=1)]
    row = {"event_id": -1, "ts": last + timedelta(days=1)}
    closing = spark.createDataFrame([tuple(row.get(c) for c in batch.columns)], batch.schema)
    slices = [batch.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))) for a, b in zip(edges, edges[1:], strict=False)]
    # A row without a time is answered whenever it comes.
    slices[0] = slices[0].unionByName(batch.where("ts is null"))
    with settings(spark, spark__sql__shuffle__partitions=str(max(4, parts_of(batch)))):
        for arriving in [*slices, closing]:
            arriving.write.mode("append").parquet(f"{path}/events")
            events = streaming_source(spark, f"{path}/events/", batch.schema)
            answers = first_verdict_stream(inputs.txn_times(events), inputs.repeated_status(events))
            append_stream(answers, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    rows = spark.read.schema(answers.schema).parquet(f"{path}/rows").where("trans_num <> '-1'")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "status_ts")})


# --- models -------------------------------------------------------------------------------------


#: Where the model of an application and a folder of tables is.
_MODELS: dict[tuple[str, str], str] = {}


def _trained(spark, sf_dir):
    """Features and the model fitted on their training rows, once per application."""
    features = stage(feat.model_inputs(_features(spark, sf_dir)), "features")
    train_rows, test_rows = model.split(features, "_id")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        path = scratch_path(spark, "model")
        model.save(model.train(train_rows), path)
        _MODELS[key] = path
    return features, test_rows, model.load(_MODELS[key])


@query
def gbt_scores(spark, sf_dir):
    """Every transaction with its score."""
    features, _, fitted = _trained(spark, sf_dir)
    scored = model.score(features, fitted, "prediction")
    return scored.select("_id", "is_fraud", "prediction", F.col("prediction").between(0, 1).alias("is_probability"))


@query
def gbt_importances(spark, sf_dir):
    """The features and their importance, the greatest first."""
    _, _, fitted = _trained(spark, sf_dir)
    return model.importances(spark, fitted)


@query
def gbt_reload_check(spark, sf_dir):
    """Each test row, and whether its score is the same after another saving and loading."""
    _, test_rows, fitted = _trained(spark, sf_dir)
    path = scratch_path(spark, "model")
    model.save(fitted, path)
    both = model.score(model.score(test_rows, fitted, "before"), model.load(path), "after")
    return both.select("_id", F.col("before").eqNullSafe(F.col("after")).alias("is_equal"))


@query
def gbt_stream_scores(spark, sf_dir):
    """Every streamed transaction with its score."""
    _, _, fitted = _trained(spark, sf_dir)
    features = feature_stream(_raw_stream(spark, sf_dir), _dictionaries(spark, sf_dir))
    scored = model.score(feat.model_inputs(features), fitted, "prediction")
    is_probability = F.col("prediction").between(0, 1).alias("is_probability")
    return _run_append(scored.select("trans_num", "prediction", is_probability), "scores")


@query
def logged_runs(spark, sf_dir):
    """The evaluation of each day logged as a run, and the log read back."""
    path = scratch_path(spark, "runs")
    daily = _daily_runs(spark, sf_dir).where("auc is not null")
    runs.log_runs(daily.select("*", F.col("auc").alias("auc_thresholded"), F.lit("none").alias("model_path")), path)
    log = spark.read.schema(RUNS).parquet(path)
    return log.select("run_id", "name", "n_estimators", "auc", F.col("auc_thresholded"))


@query
def promoted_model_used(spark, sf_dir):
    """A run above the gate, then one below it: scoring goes by the first."""
    features, test_rows, fitted = _trained(spark, sf_dir)
    path = scratch_path(spark, "promoted")
    model.save(fitted, f"{path}/good")
    for day, (name, value) in enumerate((("good", 0.97), ("bad", 0.5)), 1):
        runs.log_run(
            spark, f"{path}/runs", name, "trees", datetime(2024, 1, day), model.TREES, value, value, f"{path}/{name}"
        )
    used = model.load(runs.model_in_use(spark.read.schema(RUNS).parquet(f"{path}/runs"), "trees"))
    both = model.score(model.score(features, fitted, "own"), used, "used")
    return both.select("_id", F.col("own").eqNullSafe(F.col("used")).alias("is_equal"))


@query
def gbt_stream_matches_batch(spark, sf_dir):
    """Every streamed transaction, and whether its score is a probability and the batch's score."""
    features, _, fitted = _trained(spark, sf_dir)
    streamed = feature_stream(_raw_stream(spark, sf_dir), _dictionaries(spark, sf_dir))
    streamed = model.score(feat.model_inputs(streamed), fitted, "streamed")
    rows = _run_append(streamed.select("trans_num", "streamed"), "scores")
    batch = model.score(features, fitted, "prediction").select(
        F.col("_id").alias("trans_num"), "prediction"
    )
    return rows.join(batch, "trans_num", "left").select(
        "trans_num",
        F.col("prediction").between(0, 1).alias("is_probability"),
        (F.abs(F.col("streamed") - F.col("prediction")) < 1e-12).alias("is_equal"),
    )


@query
def custom_model_scores(spark, sf_dir):
    """A user's own vectorized model over the feature columns."""

    def predict(rows: pd.DataFrame) -> pd.Series:
        return 1.0 / (1.0 + np.exp(-(rows["amt"] / 100.0 - 1.0 + rows["hour"] / 48.0)))

    scored = _features(spark, sf_dir).withColumn("prediction", model.custom_score(predict, MODEL_FEATURES))
    return scored.select("_id", F.round("prediction", 6).alias("prediction"))
