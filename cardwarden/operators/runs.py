"""Training runs: log, latest run and promotion gate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RUNS

#: Fixed value: a run must beat this thresholded AUC to be promoted.
PROMOTION_FLOOR = 0.91


def log_run(
    spark: SparkSession, path: str, run_id: str, name: str, start_time: datetime,
    n_estimators: int, auc: float, auc_thresholded: float, model_path: str,
) -> None:
    """Append one run to the log: its parameter, the AUC of the scores, that of the 0/1 predictions,
    and where its model is."""
    values = (run_id, name, start_time, n_estimators, auc, auc_thresholded, model_path)
    row = spark.createDataFrame([values], RUNS)
    row.coalesce(1).write.mode("append").parquet(path)


def log_runs(runs: DataFrame, path: str) -> None:
    """Append many runs, one row each with the columns of a log, in one distributed write."""
    runs.select(*[F.col(f.name).cast(f.dataType) for f in RUNS.fields]).write.mode("append").parquet(path)


def latest_run(runs: DataFrame, name: str) -> DataFrame:
    """The last run started under a name."""
    return runs.where(F.col("name") == name).orderBy(F.desc("start_time"), F.desc("run_id")).limit(1)


def promoted(
    runs: DataFrame, floor: float = PROMOTION_FLOOR, metric: str = "auc_thresholded"
) -> DataFrame:
    """Runs good enough to be used for scoring."""
    return runs.where(F.col(metric) > floor)


def run_in_use(runs: DataFrame, name: str, floor: float = PROMOTION_FLOOR) -> tuple[str, str]:
    """The last promoted run under a name, and where its model is; without one there is nothing to use."""
    row = latest_run(promoted(runs, floor), name).first()
    if row is None:
        raise LookupError(f"no run of {name} has an AUC above {floor}")
    return row["run_id"], row["model_path"]


def model_in_use(runs: DataFrame, name: str, floor: float = PROMOTION_FLOOR) -> str:
    """Where the model of the last promoted run under a name is."""
    return run_in_use(runs, name, floor)[1]
