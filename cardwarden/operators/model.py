"""Boosted-tree classifier: split, train, score, save, reload; and a hook for other models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MODEL_FEATURES
from ..session import stage

# Share of training rows in percent, seed and number of trees.
TRAIN_PERCENT = 80
SEED = 42
TREES = 100

#: Rows of one training part, about: some 15 MB as MLlib keeps them.
PART_ROWS = 100_000

#: Stands for a missing feature: NULL, NaN and infinities go below every real value, so that the
#: trees can tell them apart.
MISSING = "1e30D"


def split_bucket(key: str | Column) -> Column:
    """0..99 from the key's MD5, so a row's side never depends on partitioning or other rows."""
    digits = F.substring(F.md5(F.col(key) if isinstance(key, str) else key), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") % 100


def split_side(df: DataFrame, key: str, train_percent: int = TRAIN_PERCENT) -> DataFrame:
    """Each row marked as ``train`` or ``test``, in one pass."""
    side = F.when(split_bucket(key) < train_percent, "train").otherwise("test")
    return df.withColumn("side", side)


def split(
    df: DataFrame, key: str, train_percent: int = TRAIN_PERCENT
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, the same on every run."""
    bucket = split_bucket(key)
    return df.where(bucket < train_percent), df.where(bucket >= train_percent)


def train(
    df: DataFrame,
    features: Sequence[str] = MODEL_FEATURES,
    label: str = "is_fraud",
    trees: int = TREES,
    part_rows: int = PART_ROWS,
    **params,
) -> PipelineModel:
    """Fit boosted trees on the named columns.

    The training rows are written once, as every tree level passes over them again, and dealt by
    their values to as many sorted parts as their number asks for; so the fitted trees do not depend
    on how ``df`` was partitioned, and what a task passes over does not grow. MLlib cuts the growing lineage of the boosting rounds by
    checkpoints in the session's ``spark.checkpoint.dir``.
    """
    present = ", ".join(
        f"CASE WHEN `{c}` BETWEEN -{MISSING} AND {MISSING} THEN CAST(`{c}` AS DOUBLE)"
        f" ELSE -{MISSING} END AS `_in_{c}`"
        for c in features
    )
    fill = SQLTransformer(statement=f"SELECT *, {present} FROM __THIS__")
    assembler = VectorAssembler(inputCols=[f"_in_{c}" for c in features], outputCol="_features")
    trees_stage = GBTClassifier(
        featuresCol="_features", labelCol="_label", predictionCol="_predicted", maxIter=trees,
        seed=SEED, **params
    ).setRawPredictionCol("_raw").setProbabilityCol("_chance")
    labelled = df.where(F.col(label).isNotNull()).select(
        *features, F.col(label).cast("double").alias("_label")
    )
    labelled = stage(labelled, "labelled")
    return Pipeline(stages=[fill, assembler, trees_stage]).fit(dealt(labelled, part_rows))


def dealt(df: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows of a stored table by their values, in sorted parts of about ``part_rows``."""
    parts = max(1, -(-df.count() // part_rows))
    return df.repartition(parts, *df.columns).sortWithinPartitions(*df.columns)


def score(df: DataFrame, model: PipelineModel, name: str = "score") -> DataFrame:
    """Add the probability of fraud; works on a stream as on a table, without Python workers."""
    scored = model.transform(df)
    kept = [c for c in df.columns if c != name]
    return scored.select(*kept, vector_to_array("_chance")[1].alias(name))


def importances(
    spark: SparkSession, model: PipelineModel, features: Sequence[str] = MODEL_FEATURES
) -> DataFrame:
    """Importance of each feature, greatest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def custom_score(
    predict: Callable[[pd.DataFrame], pd.Series], features: Sequence[str] = MODEL_FEATURES
) -> Column:
    """Score column from any model that maps a pandas frame of features to probabilities.

    The features travel as one struct in Arrow batches; ``predict`` is called once per batch.
    """

    def apply(rows: pd.DataFrame) -> pd.Series:
        return predict(rows).astype("float64")

    scorer = F.pandas_udf(apply, "double")
    return scorer(F.struct(*features))
