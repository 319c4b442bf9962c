import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cardwarden.functions import over
from cardwarden.operators import metrics

random.seed(8)
ROWS = []
for _ in range(900):
    y = int(random.random() < 0.2)
    ROWS.append((y, round(min(1.0, max(0.0, random.gauss(0.25 + 0.3 * y, 0.2))), 2)))
ROWS += [(0, 0.4)] * 500 + [(1, 0.4)] * 40  # one score holds a third of the rows


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(ROWS, "y int, s double").repartition(5).cache()


def test_auc_is_exact(scored):
    assert metrics.auc(scored, "y", "s").first()["auc"] == pytest.approx(brute_auc(ROWS), abs=1e-12)


def test_auc_agrees_with_the_evaluator(scored):
    vectors = scored.select(F.col("y").cast("double").alias("label"),
                            array_to_vector(F.array(1 - F.col("s"), F.col("s"))).alias("rawPrediction"))
    judge = BinaryClassificationEvaluator(numBins=0)
    assert metrics.auc(scored, "y", "s").first()["auc"] == pytest.approx(judge.evaluate(vectors), abs=1e-9)


def test_auc_of_one_class_is_null(scored):
    assert metrics.auc(scored.where("y = 0"), "y", "s").first()["auc"] is None


def test_thresholded_auc_is_auc_of_the_flags(scored):
    flags = [(y, float(s > 0.3)) for y, s in ROWS]
    got = metrics.auc_thresholded(scored, "y", "s", 0.3).first()["auc"]
    assert got == pytest.approx(brute_auc(flags), abs=1e-12)


def test_report(scored):
    lines = metrics.report(metrics.confusion(scored.withColumn("p", over("s", 0.3)), "y", "p"))
    got = {r["label"]: r for r in lines.collect()}
    tp = sum(y == 1 and s > 0.3 for y, s in ROWS)
    fp = sum(y == 0 and s > 0.3 for y, s in ROWS)
    fn = sum(y == 1 and s <= 0.3 for y, s in ROWS)
    tn = len(ROWS) - tp - fp - fn
    assert got["1"]["precision"] == pytest.approx(tp / (tp + fp))
    assert got["1"]["recall"] == pytest.approx(tp / (tp + fn))
    assert got["0"]["f1_score"] == pytest.approx(2 * tn / (2 * tn + fn + fp))
    assert got["accuracy"]["f1_score"] == pytest.approx((tp + tn) / len(ROWS))
    assert got["accuracy"]["precision"] is None
    assert got["macro avg"]["recall"] == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)
    weighted = (tp / (tp + fp) * (tp + fn) + tn / (tn + fn) * (tn + fp)) / len(ROWS)
    assert got["weighted avg"]["precision"] == pytest.approx(weighted)
    assert {r["support"] for r in got.values()} == {tp + fn, tn + fp, len(ROWS)}


def test_class_never_predicted_scores_zero(scored):
    lines = metrics.report(metrics.confusion(scored.withColumn("p", F.lit(0)), "y", "p"))
    got = {r["label"]: r for r in lines.collect()}
    assert (got["1"]["precision"], got["1"]["recall"], got["1"]["f1_score"]) == (0.0, 0.0, 0.0)
    assert got["0"]["recall"] == 1.0


def test_sketches_merge_within_their_bound(spark):
    import random

    from cardwarden.operators.metrics import auc, merge_sketches, score_sketch, sketch_auc

    draw = random.Random(2)
    rows = [(d, int(draw.random() < 0.3), draw.random()) for d in "abc" for _ in range(700)]
    rows = [(d, y, min(1.0, s + 0.2 * y)) for d, y, s in rows] + [("a", 1, None), ("a", None, 0.5), ("b", 0, -1.0), ("b", 1, 2.0)]
    df = spark.createDataFrame(rows, "day string, y int, s double")
    exact = auc(df, "y", "s").first()["auc"]
    errors = []
    for bins in (4096, 64, 3):
        days = score_sketch(df, "y", "s", ("day",), bins)
        assert days.groupBy("day").count().where(f"count > {bins}").count() == 0
        found = sketch_auc(merge_sketches(days)).first()
        assert abs(found["auc"] - exact) <= found["error"] + 1e-12
        assert found == sketch_auc(score_sketch(df, "y", "s", bins=bins)).first()
        errors.append(found["error"])
        by_day = {r["day"]: r for r in sketch_auc(merge_sketches(days, ("day",)), ("day",)).collect()}
        for d in "abc":
            own = auc(df.where(df.day == d), "y", "s").first()["auc"]
            assert abs(by_day[d]["auc"] - own) <= by_day[d]["error"] + 1e-12
    assert errors[0] < 0.002 and errors == sorted(errors)
    assert sketch_auc(score_sketch(df.limit(0), "y", "s")).first()["auc"] is None
    assert sketch_auc(score_sketch(df.where("y = 1"), "y", "s")).first()["auc"] is None
