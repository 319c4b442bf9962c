"""Model quality: confusion counts, classification report and exact ROC AUC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import over


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per (label, prediction); a handful of groups, reduced before the shuffle."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def report(counts: DataFrame) -> DataFrame:
    """Per class precision, recall, f1 and support, then accuracy and both averages.

    ``counts`` is a confusion table. A class never predicted, or never seen, scores 0.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").cast("string").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("prediction").cast("string").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    per_class = (
        counts.select(F.explode(sides).alias("s"))
        .groupBy("s.label")
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "hits")])
        .withColumn("precision", _ratio("hits", "predicted"))
        .withColumn("recall", _ratio("hits", "support"))
        .withColumn("f1_score", F.coalesce(
            F.try_divide(2 * F.col("hits").cast("double"), F.col("support") + F.col("predicted")),
            F.lit(0.0),
        ))
    )
    scores = ["precision", "recall", "f1_score"]
    totals = per_class.rollup("label").agg(
        F.grouping("label").alias("is_total"),
        *[F.avg(c).alias(f"macro_{c}") for c in scores],
        *[F.sum(F.col(c) * F.col("support")).alias(f"sum_{c}") for c in scores],
        F.sum("support").alias("support"),
        F.sum("hits").alias("hits"),
    )
    none = F.lit(None).cast("double")

    def line(name, values):
        return F.struct(name.alias("label"), *[v.alias(c) for c, v in zip(scores, values)],
                        F.col("support").alias("support"))

    own = line(F.col("label"), [F.col(f"macro_{c}") for c in scores])
    accuracy = line(F.lit("accuracy"), [none, none, _ratio("hits", "support")])
    macro = line(F.lit("macro avg"), [F.col(f"macro_{c}") for c in scores])
    weighted = line(F.lit("weighted avg"), [_ratio(f"sum_{c}", "support") for c in scores])
    lines = F.when(F.col("is_total") == 1, F.array(accuracy, macro, weighted)).otherwise(F.array(own))
    return totals.select(F.explode(lines).alias("l")).select("l.*")


def _ratio(part: str, whole: str):
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; one row.

    Rows are first reduced to distinct scores. Those are range-partitioned, each partition adds up
    its own pairs, and the negatives of the partitions below follow from one number per partition,
    so neither a task nor the driver sees all scores.
    """
    scored = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = scored.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0.0).otherwise(1.0)).alias("neg"),
    )
    ranged = counts.repartitionByRange("score").withColumn("part", F.spark_partition_id())
    lower = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(lower), F.lit(0.0))
    parts = (
        ranged.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
        .groupBy("part")
        .agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "won")])
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("neg_before", F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)))
        .agg(
            F.sum(F.col("won") + F.col("pos") * F.col("neg_before")).alias("won"),
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
        )
        .select(F.try_divide(F.col("won"), F.col("pos") * F.col("neg")).alias("auc"))
    )


def auc_thresholded(
    df: DataFrame, label: str, score: str, threshold: float | Column, by: tuple[str, ...] = ()
) -> DataFrame:
    """ROC AUC of 0/1 predictions, which is the mean of both classes' recall; optionally per group."""
    hit = over(score, threshold) == F.col(label)
    rates = [
        F.try_divide(
            F.sum(F.when((F.col(label) == value) & hit, 1.0).otherwise(0.0)),
            F.sum(F.when(F.col(label) == value, 1.0).otherwise(0.0)),
        )
        for value in (1, 0)
    ]
    return df.groupBy(*by).agg(((rates[0] + rates[1]) / 2).alias("auc"))


#: Bins of a score sketch: scores 0 to 1 in equal steps.
SKETCH_BINS = 4096


def score_sketch(df: DataFrame, label: str, score: str, by: tuple[str, ...] = (), bins: int = SKETCH_BINS) -> DataFrame:
    """Counts of both classes per bin of the score; sketches of days or runs merge by adding up (``merge_sketches``).

    A sketch has at most ``bins`` rows for each group, however many rows it was made of. Scores outside 0 to 1 count as the nearest of these, NaN as 1.
    """
    scored = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    place = F.floor(F.when(F.isnan(score), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double")))) * bins)
    return scored.groupBy(*by, F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) != 1, 1)).alias("neg")
    )


def merge_sketches(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The sketch of all rows behind several, per group; pairs of bins have the same bounds in all."""
    return sketches.groupBy(*by, "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def sketch_auc(sketch: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``auc`` per group and ``error``, what it differs by at most from the exact value.

    Pairs in different bins are counted as they are, and those in one bin as ties, so each of these is wrong by a half at most.
    """
    below = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sketch.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    own = F.col("pos").cast("double") * F.col("neg")
    sums = ranked.groupBy(*by).agg(
        F.sum(F.col("pos").cast("double") * F.col("below") + own / 2).alias("won"), F.sum(own / 2).alias("tied"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    pairs = F.col("pos").cast("double") * F.col("neg")
    return sums.select(*by, F.try_divide(F.col("won"), pairs).alias("auc"), F.try_divide(F.col("tied"), pairs).alias("error"))
