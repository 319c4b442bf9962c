"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from cardwarden.operators import dictionary as dic
from cardwarden.operators import features as feat
from cardwarden.operators import find, quality, rules
from cardwarden.operators.ranking import latest_rows
from cardwarden.operators.spend import user_spend
from cardwarden.session import stage
from cardwarden.sources import write_table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def raw(spark):
    from cardwarden.plans import inputs

    return stage(feat.with_id(inputs.raw_txn(spark, "/root/testdata/sf0.001")), "raw")


def test_features_need_no_python_and_no_shuffle(raw):
    plan = plan_of(feat.build_features(raw, dic.build_dictionaries(raw, feat.ENCODED)))
    features = plan.split("BroadcastExchange")[0]
    assert "Python" not in plan and plan.count("BroadcastHashJoin") == 2
    assert "hashpartitioning" not in features
    scanned = re.search(r"ReadSchema: struct<([^>]*)", features).group(1)
    assert "merchant:" not in scanned and "first:" not in scanned


def test_spend_reads_four_columns_and_shuffles_once(raw):
    plan = plan_of(user_spend(raw))
    assert plan.count("Exchange") == 1 and "partial_sum" in plan.split("Exchange")[1]
    assert "ReadSchema: struct<amt:string,first:string,last:string,is_fraud:string>" in plan


def test_fraud_filter_reaches_the_scan(raw):
    typed = stage(feat.featurize(raw), "typed")
    assert "EqualTo(is_fraud,1)" in plan_of(find.fraud_only(typed))


def test_rules_are_one_stage(spark, raw):
    limits = spark.createDataFrame(
        [("1", 1.0, 2.0, 3.0)],
        "cc_num string, ACCT_AVL_CASH_BEFORE_AMT double, ACCT_CL_AMT double, AVG_DLY_AUTHZN_AMT double",
    )
    scored = feat.featurize(raw).withColumn("score", F.lit(0.1))
    plan = plan_of(rules.combine(rules.cascade(rules.attach_rules(scored, stage(limits)))))
    assert "hashpartitioning" not in plan and "Python" not in plan and "BroadcastHashJoin" in plan


def test_latest_rows_reduce_before_the_shuffle(raw):
    plan = plan_of(latest_rows(raw.select("cc_num", "amt", "trans_num"), "cc_num", ["trans_num"]))
    assert plan.count("Exchange") == 1 and "partial_max_by" in plan.split("Exchange")[1]
    assert "Window" not in plan


def test_bounded_find_sorts_no_whole_table(raw):
    assert "TakeOrderedAndProject" in plan_of(find.bounded_find(raw, "_id"))


def test_key_check_of_a_bucketed_table_moves_no_rows(raw):
    table = write_table(raw.select("_id", "amt"), "keyed_plan", bucket_by="_id", buckets=4)
    assert "Exchange" not in plan_of(quality.key_violations(table, "_id"))
