from datetime import datetime

import pytest

from cardwarden.operators.features import with_id
from cardwarden.operators.rules import Rule, RuleSet, save_rules
from cardwarden.operators.runs import latest_run, log_run, promoted
from cardwarden.schemas import RUNS
from cardwarden.plans import inputs, jobs
from cardwarden.sources import read_latest
from cardwarden.operators.verdicts import verdict

SF = "/root/testdata/sf0.001"


def test_from_raw_transactions_to_verdicts(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    raw = with_id(inputs.raw_txn(spark, SF))
    typed, features = jobs.build_feature_tables(
        raw, at("dictionaries"), "job_txn", "job_features", buckets=4
    )
    assert typed.count() == raw.count() and "is_fraud" not in features.columns

    _, metrics = jobs.train_and_log(typed, features, at("runs"), at("models"), trees_count=12)
    log = spark.read.schema(RUNS).parquet(at("runs"))
    run = latest_run(log, jobs.RUN_NAME).first()
    assert (run["auc"], run["auc_thresholded"]) == (metrics["auc"], metrics["auc_thresholded"])
    assert promoted(log).count() == 1
    assert spark.read.parquet(at("runs") + "-reports").select("threshold").distinct().count() == 2

    # A later run that fails the gate changes nothing: its model is not even there.
    late = datetime(2100, 1, 1)
    log_run(spark, at("runs"), "bad", jobs.RUN_NAME, late, 1, 0.95, 0.91, at("nowhere"))
    scored = jobs.score_table(typed, at("runs"))
    log_run(spark, at("bad_runs"), "bad", jobs.RUN_NAME, late, 1, 0.95, 0.91, at("nowhere"))
    with pytest.raises(LookupError, match="above"):
        jobs.score_table(typed, at("bad_runs"))
    assert scored.where("prediction between 0 and 1").count() == typed.count()

    limits = inputs.account_rules(spark, SF)
    stream = inputs.raw_txn(spark, SF, inputs.event_stream(spark, SF))
    jobs.start_verdict_stream(
        stream, at("dictionaries"), lambda: limits, at("runs"), at("verdicts"), at("checkpoint")
    ).awaitTermination()
    schema = verdict(scored.selectExpr("_id as trans_num", "1 as prediction")).schema
    rows = read_latest(spark, at("verdicts"), schema, "txn_num", [])
    assert rows.count() == typed.count()
    assert rows.select("txn_status").distinct().count() == 2


def test_command_line(spark, tmp_path):
    from cardwarden.__main__ import main

    at = lambda name: str(tmp_path / name)
    inputs.raw_txn(spark, SF).write.json(at("raw"))
    inputs.account_rules(spark, SF).write.json(at("rules"))
    tables = ["--transaction-table", "cli_txn"]
    both = [*tables, "--feature-table", "cli_features"]
    main(["features", "--raw", at("raw"), "--format", "json", "--dictionaries", at("d"), "--spend-table", "cli_spend", *both])
    main(["train", "--runs", at("runs"), "--models", at("m"), "--trees", "12", *both])
    main(["score", "--runs", at("runs"), "--output", at("scored"), *tables])
    save_rules(spark, RuleSet("all-pass", (Rule("never", "amt < 0"),)), at("own"))
    main(["stream", "--raw", at("raw"), "--rules", at("rules"), "--format", "json", "--output", at("v"),
          "--checkpoint", at("cp"), "--dictionaries", at("d"), "--runs", at("runs"), "--rule-set", at("own")])
    main(["feature-stream", "--raw", at("raw"), "--format", "json", "--output", at("f"),
          "--checkpoint", at("cp2"), "--dictionaries", at("d")])
    n = spark.read.json(at("raw")).count()
    assert spark.read.parquet(at("scored")).count() == n == spark.read.parquet(at("v")).count()
    assert spark.read.parquet(at("f")).count() == n and spark.table("cli_spend").count() > 0
