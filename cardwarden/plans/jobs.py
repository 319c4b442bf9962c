"""The jobs a deployment runs: batch features, training, batch scoring and the verdict stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import model as trees
from ..operators.dictionary import build_dictionaries
from ..operators.features import ENCODED, build_features, separate, training_set
from ..functions import over
from ..operators.metrics import auc, auc_thresholded, confusion, report
from ..operators.rules import LIMIT_RULES, THRESHOLD, RuleSet
from ..operators.runs import log_run, model_in_use, run_in_use
from ..operators.spend import user_spend
from ..schemas import RUNS
from ..session import stage
from ..sources import write_feature_table, write_table
from ..streaming import (
    foreach_batch_stream,
    load_dictionary,
    promoted_verdict_batches,
    refreshing_features,
    save_dictionary,
)

# Default table and run names.
TRANSACTION_TABLE = "txn_data"
FEATURE_TABLE = "txn_features"
SPEND_TABLE = "user_spend"
RUN_NAME = "tree_model_train"
#: Thresholds of the reports that go with a run.
REPORT_THRESHOLDS = (0.3, 0.5)


def build_feature_tables(
    raw: DataFrame,
    dictionary_dir: str,
    transaction_table: str = TRANSACTION_TABLE,
    feature_table: str = FEATURE_TABLE,
    key: str = "_id",
    buckets: int = 0,
    **table,
) -> tuple[DataFrame, DataFrame]:
    """Raw transactions to saved dictionaries, typed table and feature table.

    ``raw`` is scanned twice: narrowly for the dictionaries, then once for all features. With
    ``buckets`` both tables are bucketed by the key, so training joins them without a shuffle.
    """
    spark = raw.sparkSession
    for column, dictionary in build_dictionaries(raw, ENCODED).items():
        save_dictionary(dictionary, f"{dictionary_dir}/{column}")
    if buckets:
        table.update(bucket_by=key, buckets=buckets)
    typed = build_features(raw, saved_dictionaries(spark, dictionary_dir), key)
    typed = write_table(typed, transaction_table, **table)
    features = write_feature_table(typed, feature_table, key, **table)
    return typed, features


def saved_dictionaries(spark: SparkSession, dictionary_dir: str) -> Mapping[str, DataFrame]:
    return {
        column: load_dictionary(spark, f"{dictionary_dir}/{column}", column, id_column)
        for column, id_column in ENCODED.items()
    }


def train_and_log(
    transactions: DataFrame,
    features: DataFrame,
    runs_path: str,
    models_dir: str,
    key: str = "_id",
    trees_count: int = trees.TREES,
    threshold: float = THRESHOLD,
) -> tuple[PipelineModel, dict[str, float]]:
    """Train on 80 % of the rows, save the model under the run's id, log the run and its reports.

    Returns the model and both AUCs. The promotion gate looks at that of the 0/1 predictions. No
    earlier model is touched, so what is in use stays in use until a run passes the gate.
    """
    spark = transactions.sparkSession
    run_id = uuid.uuid4().hex
    model_path = f"{models_dir}/{run_id}"
    labels = transactions.select(key, "is_fraud")
    rows = training_set(labels, features, key, exclude=())
    train_rows, test_rows = trees.split(rows, key)
    fitted = trees.train(separate(train_rows), trees=trees_count)
    trees.save(fitted, model_path)
    scored = stage(trees.score(separate(test_rows), fitted).select("is_fraud", "score"), "scored")
    metrics = {
        "auc": auc(scored, "is_fraud", "score").first()["auc"],
        "auc_thresholded": auc_thresholded(scored, "is_fraud", "score", threshold).first()["auc"],
    }
    for limit in REPORT_THRESHOLDS:
        predicted = scored.withColumn("prediction", over("score", limit))
        lines = report(confusion(predicted, "is_fraud", "prediction"))
        path = f"{runs_path}-reports/run_id={run_id}/threshold={limit}"
        lines.coalesce(1).write.mode("overwrite").parquet(path)
    log_run(
        spark, runs_path, run_id, RUN_NAME, datetime.now(timezone.utc), trees_count,
        metrics["auc"], metrics["auc_thresholded"], model_path,
    )
    return fitted, metrics


def promoted_model(spark: SparkSession, runs_path: str) -> PipelineModel:
    """The model of the last run that passed the gate; an error if there is none."""
    return trees.load(model_in_use(spark.read.schema(RUNS).parquet(runs_path), RUN_NAME))


def score_table(transactions: DataFrame, runs_path: str) -> DataFrame:
    """The whole transaction table with the promoted model's probability of fraud."""
    model = promoted_model(transactions.sparkSession, runs_path)
    return trees.score(transactions, model, "prediction")


def build_spend_table(raw: DataFrame, spend_table: str = SPEND_TABLE, **table) -> DataFrame:
    """Spend per user as a table."""
    return write_table(user_spend(raw), spend_table, **table)


def start_feature_stream(
    raw: DataFrame, dictionary_dir: str, target: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Typed and encoded features of a stream of raw transactions, dictionaries kept up to date."""
    paths = {column: f"{dictionary_dir}/{column}" for column in ENCODED}
    process = refreshing_features(paths, target, checkpoint)
    return foreach_batch_stream(raw, process, checkpoint, every)


def start_verdict_stream(
    raw: DataFrame,
    dictionary_dir: str,
    load_rules: Callable[[], DataFrame],
    runs_path: str,
    target: str,
    checkpoint: str,
    every: str | None = None,
    rule_set: RuleSet = LIMIT_RULES,
) -> StreamingQuery:
    """Keep verdict rows for a stream of raw transactions up to date, by the promoted model; model, limits and
    dictionaries are looked up per batch. Without a promoted model the stream does not start."""
    spark = raw.sparkSession
    in_use = lambda: run_in_use(spark.read.schema(RUNS).parquet(runs_path), RUN_NAME)
    in_use()
    process = promoted_verdict_batches(
        lambda: saved_dictionaries(spark, dictionary_dir), load_rules, in_use, target, checkpoint, rule_set
    )
    return foreach_batch_stream(raw, process, checkpoint, every)
