"""Command line for the jobs: ``python -m cardwarden features|train|score|stream|feature-stream``."""

from __future__ import annotations

import argparse

from .operators.features import with_id
from .operators.rules import LIMIT_RULES, load_rules
from .plans import jobs
from .schemas import RAW_TXN, RULES
from .session import build_session
from .sources import read_source, read_table, write_collection


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="cardwarden")
    steps = main.add_subparsers(dest="step", required=True)

    features = steps.add_parser("features", help="raw transactions to dictionaries and tables")
    features.add_argument("--raw", required=True)
    features.add_argument("--buckets", type=int, default=0)

    train = steps.add_parser("train", help="fit, save and log a model")
    train.add_argument("--models", required=True)
    train.add_argument("--trees", type=int, default=jobs.trees.TREES)

    score = steps.add_parser("score", help="score the transaction table")
    score.add_argument("--output", required=True)

    stream = steps.add_parser("stream", help="verdicts for a stream of raw transactions")
    stream.add_argument("--raw", required=True)
    stream.add_argument("--rules", required=True)
    stream.add_argument("--rule-set", help="folder of a stored rule set; without it, the built-in one")

    typed = steps.add_parser("feature-stream", help="features of a stream of raw transactions")
    typed.add_argument("--raw", required=True)

    for step in (stream, typed):
        step.add_argument("--output", required=True)
        step.add_argument("--checkpoint", required=True)
        step.add_argument("--every", help="interval such as '10 seconds'; without it, run once")
    for step in (features, stream, typed):
        step.add_argument("--format", default="parquet")
        step.add_argument("--dictionaries", required=True)
    for step in (train, score, stream):
        step.add_argument("--runs", required=True)
    features.add_argument("--spend-table", default=jobs.SPEND_TABLE)
    for step in (features, train, score):
        step.add_argument("--transaction-table", default=jobs.TRANSACTION_TABLE)
    for step in (features, train):
        step.add_argument("--feature-table", default=jobs.FEATURE_TABLE)
    return main


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = build_session()
    if args.step == "features":
        raw = read_source(spark, RAW_TXN, args.format, args.raw)
        jobs.build_feature_tables(
            with_id(raw), args.dictionaries, args.transaction_table, args.feature_table,
            buckets=args.buckets,
        )
        jobs.build_spend_table(raw, args.spend_table)
    elif args.step == "train":
        _, metrics = jobs.train_and_log(
            read_table(spark, args.transaction_table), read_table(spark, args.feature_table),
            args.runs, args.models, trees_count=args.trees,
        )
        print(metrics)
    elif args.step == "score":
        scored = jobs.score_table(read_table(spark, args.transaction_table), args.runs)
        write_collection(scored, args.output)
    elif args.step == "feature-stream":
        raw = read_source(spark, RAW_TXN, args.format, args.raw, streaming=True)
        jobs.start_feature_stream(
            raw, args.dictionaries, args.output, args.checkpoint, args.every
        ).awaitTermination()
    else:
        raw = read_source(spark, RAW_TXN, args.format, args.raw, streaming=True)
        limits = RULES.fieldNames()[:4]
        rule_set = load_rules(spark, args.rule_set) if args.rule_set else LIMIT_RULES
        jobs.start_verdict_stream(
            raw, args.dictionaries,
            lambda: read_source(spark, RULES, args.format, args.rules).select(*limits),
            args.runs, args.output, args.checkpoint, args.every, rule_set,
        ).awaitTermination()


if __name__ == "__main__":
    main()
