"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streaming state that outgrows the heap spills to local disk and is restored from the checkpoint.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # A checkpoint uploads what changed rather than whole stores; a join keeps one store per task.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def build_session(app: str = "cardwarden", **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it then gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cardwarden-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application for later clean-up."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark).rstrip('/')}/{app}/{label}-{uuid.uuid4().hex}"
    for paths in _SCOPES.get(threading.get_ident(), []):
        paths.append(path)
    return path


#: Scratch paths to remove at the end of each open block, by thread.
_SCOPES: dict[int, list[list[str]]] = {}


@contextmanager
def scratch_scope(spark: SparkSession):
    """Remove at the end what the block staged, as a micro-batch must; nothing lazy may outlive it."""
    own = _SCOPES.setdefault(threading.get_ident(), [])
    paths: list[str] = []
    own.append(paths)
    try:
        yield
    finally:
        own.remove(paths)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and the copy
    survives executor loss."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> bool:
    """Remove this application's staged tables once no result still reads them."""
    return _delete(spark, f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}")


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Set session options for a block; a streaming query keeps those in force at its start."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


#: Bytes of the files behind one bucket, about; in memory rows take some ten times that.
PART_BYTES = 16 * 1024 * 1024


def parts_of(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Parts for a stored table, by the size of the files ``df`` is made from.

    Of a join it is the sum of both sides, as Spark takes a join that it knows nothing of for as large as their product.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if leaves.size() == 1:
        # What is read of a single table, less the columns left out.
        size = min(size, int(plan.stats().sizeInBytes()))
    return max(1, -(-size // part_bytes))
