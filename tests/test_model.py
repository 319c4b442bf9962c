import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cardwarden.operators import model, runs
from cardwarden.operators.metrics import auc

FEATURES = ["amt", "hour", "noise"]


@pytest.fixture(scope="module")
def data(spark):
    random.seed(4)
    rows = []
    for i in range(1500):
        amt, hour = random.random() * 100, random.randrange(24)
        fraud = int(amt > 70 and hour < 8 or random.random() < 0.01)
        rows.append((f"t{i}", amt if i % 50 else None, hour, random.random(), fraud))
    schema = "_id string, amt double, hour int, noise double, is_fraud int"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def fitted(data):
    return model.train(data, FEATURES, trees=5)


def test_split_does_not_depend_on_partitioning(data):
    train, test = model.split(data, "_id")
    again, _ = model.split(data.repartition(9), "_id")
    ids = {r[0] for r in train.select("_id").collect()}
    assert ids == {r[0] for r in again.select("_id").collect()}
    assert train.count() + test.count() == data.count()
    assert 0.75 < train.count() / data.count() < 0.85
    marked = model.split_side(data, "_id").where("side = 'train'")
    assert ids == {r[0] for r in marked.select("_id").collect()}


def test_scores_are_probabilities_and_missing_features_are_scored(data, fitted):
    scored = model.score(data, fitted)
    assert scored.columns == data.columns + ["score"]
    low, high, n = scored.agg(F.min("score"), F.max("score"), F.count("score")).first()
    assert 0 <= low <= high <= 1 and n == data.count()
    assert auc(scored, "is_fraud", "score").first()["auc"] > 0.9


def test_saved_model_scores_the_same(data, fitted, tmp_path):
    model.save(fitted, str(tmp_path / "m"))
    again = model.load(str(tmp_path / "m"))
    before = {r["_id"]: r["score"] for r in model.score(data, fitted).collect()}
    after = {r["_id"]: r["score"] for r in model.score(data, again).collect()}
    assert before == after


def test_scoring_uses_no_python_worker(data, fitted):
    plan = model.score(data, fitted)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_importances_descend(spark, fitted):
    rows = model.importances(spark, fitted, FEATURES).collect()
    values = [r["importance"] for r in rows]
    assert values == sorted(values, reverse=True) and sum(values) == pytest.approx(1)
    assert {r["feature"] for r in rows} == set(FEATURES) and rows[-1]["feature"] == "noise"


def test_custom_score(data):
    def predict(rows: pd.DataFrame) -> pd.Series:
        return np.minimum(rows["amt"].fillna(0) / 100 + rows["hour"] * 0, 1)

    got = data.select("amt", model.custom_score(predict, ["amt", "hour"]).alias("p")).collect()
    assert all(r["p"] == pytest.approx((r["amt"] or 0) / 100) for r in got)


def test_runs_log_latest_and_gate(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i, (name, value) in enumerate([("a", 0.95), ("a", 0.91), ("b", 0.99)]):
        runs.log_run(spark, path, f"r{i}", name, dt.datetime(2024, 1, 1 + i), 100, 0.99, value, f"m{i}")
    log = spark.read.parquet(path)
    assert runs.latest_run(log, "a").first()["run_id"] == "r1"
    assert {r["run_id"] for r in runs.promoted(log).collect()} == {"r0", "r2"}
    assert runs.model_in_use(log, "a") == "m0"
    with pytest.raises(LookupError):
        runs.model_in_use(log, "c")


def test_scores_keep_columns_with_the_names_of_model_outputs(data, fitted):
    given = data.limit(5).withColumns({c: F.lit("own") for c in ("prediction", "probability", "features", "rawPrediction")})
    row = model.score(given, fitted).first()
    assert {row[c] for c in ("prediction", "probability", "features", "rawPrediction")} == {"own"} and 0 <= row["score"] <= 1


def walk(tree, point):
    """Follow one tree, as Spark prints it, to its prediction."""
    import re

    lines = [line for line in tree.splitlines() if re.search("If|Else|Predict", line)]
    at = 0
    while True:
        text = lines[at].strip()
        if text.startswith("Predict"):
            return float(text.split(":")[1])
        depth = len(lines[at]) - len(lines[at].lstrip())
        number, sign, cut = re.search(r"feature (\d+) (<=|>) (\S+)\)", text).groups()
        assert (text.startswith("If"), sign) in ((True, "<="), (False, ">"))
        if text.startswith("Else") or point[int(number)] <= float(cut):
            at += 1
        else:
            at = next(i for i in range(at + 1, len(lines)) if lines[i].lstrip().startswith("Else") and len(lines[i]) - len(lines[i].lstrip()) == depth)


def test_scores_are_those_of_the_trees(data, fitted):
    """Each tree followed by hand for every row, and the logistic of twice their weighted sum."""
    trees = fitted.stages[-1]
    texts, weights = [t.toDebugString for t in trees.trees], trees.treeWeights
    for row in model.score(data, fitted).limit(400).collect():
        point = [-1e30 if row[c] is None else float(row[c]) for c in FEATURES]
        margin = sum(w * walk(t, point) for t, w in zip(texts, weights, strict=True))
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-2 * margin)), abs=1e-9)


def test_a_second_fit_gives_the_same_values(spark, data, fitted):
    again = model.train(data.repartition(5), FEATURES, trees=5)
    assert model.importances(spark, again, FEATURES).collect() == model.importances(spark, fitted, FEATURES).collect()
    first, second = ({r["_id"]: r["score"] for r in model.score(data, m).collect()} for m in (fitted, again))
    assert first == second and len(set(first.values())) > 5


def test_many_runs_in_one_append(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = [(f"r{i}", "a", dt.datetime(2024, 1, 1 + i), 100, 0.9, 0.92, f"m{i}") for i in range(20)]
    from cardwarden.schemas import RUNS

    runs.log_runs(spark.createDataFrame(rows, RUNS).withColumn("more", F.lit(1)), path)
    runs.log_run(spark, path, "last", "a", dt.datetime(2024, 2, 1), 100, 0.9, 0.93, "m")
    log = spark.read.schema(RUNS).parquet(path)
    assert log.count() == 21 and runs.run_in_use(log, "a") == ("last", "m")


def test_a_promotion_takes_effect_at_the_next_batch(spark, raw_rows, tmp_path):
    from cardwarden.operators.dictionary import build_dictionaries
    from cardwarden.operators.features import ENCODED, build_features
    from cardwarden.sources import read_batches
    from cardwarden.streaming import promoted_verdict_batches
    from pyspark.sql import types as T

    dictionaries = build_dictionaries(raw_rows, ENCODED)
    features = build_features(raw_rows, dictionaries, "trans_num")
    for name, fraud in (("old", "1"), ("new", "0")):
        labelled = features.withColumn("is_fraud", F.when(F.col("trans_num") == "a", 1 - int(fraud)).otherwise(int(fraud)))
        model.save(model.train(labelled, trees=1), str(tmp_path / name))
    limits = spark.createDataFrame([("42", 1e9, 1e9, 1.0)], "cc_num string, ACCT_AVL_CASH_BEFORE_AMT double, ACCT_CL_AMT double, AVG_DLY_AUTHZN_AMT double")
    in_use, asked = ["old"], []

    def current():
        asked.append(in_use[0])
        return in_use[0], str(tmp_path / in_use[0])

    target = str(tmp_path / "v")
    start = lambda: promoted_verdict_batches(lambda: dictionaries, lambda: limits, current, target, str(tmp_path / "cp"))
    process = start()
    process(raw_rows.where("trans_num = 'b'"), 0)
    in_use[0] = "new"
    process(raw_rows.where("trans_num = 'c'"), 1)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("txn_num", "txn_status", "run_id")])

    def verdicts():
        return {r["txn_num"]: (r["txn_status"], r["run_id"]) for r in read_batches(spark, target, schema).collect()}

    assert verdicts() == {"b": ("REJECTED", "old"), "c": ("AUTHORIZED", "new")} and asked == ["old", "new"]
    # A batch whose choice was made and whose verdicts were lost is scored as it was meant, by a new process too.
    in_use[0] = "old"
    from cardwarden.sources.commits import Files
    from cardwarden.sources.upserts import writer_of

    Files(spark, target).create(f"_models/{writer_of(str(tmp_path / 'cp'))}-2.json", f'["new", "{tmp_path / "new"}"]')
    start()(raw_rows.where("trans_num = 'd'"), 2)
    start()(raw_rows.where("trans_num = 'd'"), 2)
    assert verdicts()["d"] == ("AUTHORIZED", "new") and len(asked) == 2


def test_training_parts_follow_the_rows(data):
    parts = model.dealt(data, 300).rdd.glom().collect()
    assert len(parts) == 5 and max(map(len, parts)) < 450 and sorted(r["_id"] for p in parts for r in p) == sorted(r["_id"] for r in data.collect())
    assert model.dealt(data).rdd.getNumPartitions() == 1


def test_a_fit_over_many_parts(data):
    scored = model.score(data, model.train(data, FEATURES, trees=5, part_rows=200))
    assert auc(scored, "is_fraud", "score").first()["auc"] > 0.9
