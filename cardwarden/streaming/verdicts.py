"""Verdicts on a stream, and the wait for them."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import build_features, model_inputs
from ..operators.model import load, score
from ..operators.ranking import latest_rows
from ..operators.rules import LIMIT_RULES, THRESHOLD, RuleSet, attach_rules, cascade, combine
from ..operators.verdicts import (
    DEADLINE_SECONDS,
    answered_slots,
    asked_slot,
    timeout_reply,
    verdict,
)
from ..sources.commits import Files
from ..sources.upserts import append_batch, writer_of


def verdict_stream(
    raw: DataFrame,
    dictionaries: Mapping[str, DataFrame],
    rules: DataFrame,
    model: PipelineModel,
    rule_set: RuleSet = LIMIT_RULES,
    threshold: float = THRESHOLD,
    salts: int = 1,
) -> DataFrame:
    """Raw transactions, streamed or not, to verdict rows: features, limits, rules, model, verdict.

    ``salts`` is for a stream whose limits are too many to broadcast; see ``lookup_join``.
    """
    features = build_features(raw, dictionaries, key="trans_num")
    scored = score(model_inputs(attach_rules(features, rules, salts=salts)), model)
    return verdict(combine(cascade(scored, rule_set), "score", threshold))


def verdict_batches(
    load_dictionaries: Callable[[], Mapping[str, DataFrame]],
    load_rules: Callable[[], DataFrame],
    model: PipelineModel,
    target: str,
    checkpoint: str,
    rule_set: RuleSet = LIMIT_RULES,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps verdict rows in ``target``.

    Every micro-batch reads dictionaries and limits afresh, so changes to them take effect, and is
    joined as a table is, adaptively. The verdict written last stands; within a batch, where a card
    has several rule rows, REJECTED does.
    """
    writer = writer_of(checkpoint)

    def process(batch: DataFrame, batch_id: int) -> None:
        rows = verdict_stream(batch, load_dictionaries(), load_rules(), model, rule_set)
        append_batch(latest_rows(rows, "txn_num", ["txn_status"]), target, batch_id, writer)

    return process


def promoted_verdict_batches(
    load_dictionaries: Callable[[], Mapping[str, DataFrame]],
    load_rules: Callable[[], DataFrame],
    run_in_use: Callable[[], tuple[str, str]],
    target: str,
    checkpoint: str,
    rule_set: RuleSet = LIMIT_RULES,
) -> Callable[[DataFrame, int], None]:
    """Like ``verdict_batches``, by the model that is promoted when a micro-batch begins; verdicts carry its ``run_id``.

    ``run_in_use`` gives that run and where its model is. The choice is written down before the batch is scored, so a batch that is
    run again is scored by the same model, whatever has been promoted since. A model is loaded when it changes.
    """
    writer = writer_of(checkpoint)
    loaded: dict[str, PipelineModel] = {}

    def process(batch: DataFrame, batch_id: int) -> None:
        files = Files(batch.sparkSession, target)
        choice = f"_models/{writer}-{batch_id}.json"
        if f"{writer}-{batch_id}.json" not in files.names("_models"):
            files.create(choice, json.dumps(run_in_use()))
        run_id, path = json.loads(files.read(choice))
        if path not in loaded:
            loaded.clear()
            loaded[path] = load(path)
        rows = verdict_stream(batch, load_dictionaries(), load_rules(), loaded[path], rule_set)
        rows = latest_rows(rows, "txn_num", ["txn_status"]).withColumn("run_id", F.lit(run_id))
        append_batch(rows, target, batch_id, writer)

    return process


def verdict_within_stream(
    txn: DataFrame,
    status: DataFrame,
    seconds: int = DEADLINE_SECONDS,
    key: str = "trans_num",
    ts: str = "ts",
    delay: str = "10 minutes",
) -> DataFrame:
    """Each transaction with its verdict, or the timeout reply once the watermark passes its deadline.

    ``delay`` bounds how late rows may arrive; both watermarks and the time bound let the state of
    older rows go. Key and time slot together are the join key, so a number repeated over time does
    not gather in one state partition. Repeated verdicts each give a row; ``first_rows`` by number
    and time keeps the earliest.
    """
    asked = (
        txn.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, delay)
        .withColumn("_slot", asked_slot(ts, seconds))
    )
    answered = (
        status.select(
            F.col("txn_num").alias("_txn_num"), F.col("status_ts").cast("timestamp"), "txn_status"
        )
        .withWatermark("status_ts", delay)
        .withColumn("_answer_slot", F.explode(answered_slots("status_ts", seconds)))
    )
    joined = asked.join(
        answered,
        (F.col(key) == F.col("_txn_num"))
        & (F.col("_slot") == F.col("_answer_slot"))
        & (F.col("status_ts") >= F.col(ts))
        & (F.col("status_ts") <= F.col(ts) + F.expr(f"interval {seconds} seconds")),
        "leftOuter",
    )
    return joined.select(
        *txn.columns, "status_ts", "txn_status", *timeout_reply(F.col("_txn_num").isNotNull())
    )
