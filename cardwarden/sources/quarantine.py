"""Messages in, rows out, and what is no message kept with its text.

A micro-batch is split into rows and broken messages, and both sides are committed in one step (``commits``): a replay writes nothing twice, and no reader sees one side
without the other. Broken are messages that are no JSON object, in whole or in part, and empty ones. Absent fields are NULL, as in ``from_messages``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import CommitLog
from .upserts import writer_of

_BROKEN = "_broken"
_GOOD, _BAD = "good", "bad"
#: What is kept of a broken message.
BROKEN = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("reason", T.StringType())])


def split_messages(df: DataFrame, schema: T.StructType, key: str = "key", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows of the messages that can be read, and the key, text and fault of the others."""
    text = F.col(value).cast("string")
    full = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    read = df.select(F.col(key).cast("string").alias("key"), text.alias("value"), F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}).alias("m"))
    empty = F.col("value").isNull() | (F.trim("value") == "")
    no_object = ~F.coalesce(F.ltrim("value").startswith("{"), F.lit(False))
    reason = F.when(empty, "empty").when(no_object, "no object").when(F.col(f"m.{_BROKEN}").isNotNull(), "unreadable")
    judged = read.withColumn("reason", reason)
    good = judged.where("reason is null").select(*[F.col(f"m.`{f.name}`") for f in schema.fields])
    return good, judged.where("reason is not null").select(*BROKEN.names)


def message_sink(target: str, schema: T.StructType, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds the rows and the broken messages of each micro-batch to ``target``."""
    writer = writer_of(checkpoint)

    def process(batch: DataFrame, batch_id: int) -> None:
        log = CommitLog(batch.sparkSession, target)
        state = log.state()
        if state.committed(writer, batch_id):
            return
        batch.persist()
        try:
            names = {}
            for side, rows in zip((_GOOD, _BAD), split_messages(batch, schema), strict=True):
                name = f"{side}/{writer}-{batch_id}"
                rows.write.mode("overwrite").parquet(f"{target}/{name}")
                names[name] = None
        finally:
            batch.unpersist()
        while not log.commit(state, names, writer=writer, batch_id=batch_id):
            state = log.state()

    return process


def _side(spark: SparkSession, target: str, side: str, schema: T.StructType) -> DataFrame:
    paths = [f"{target}/{name}" for name in CommitLog(spark, target).state().live if name.startswith(f"{side}/")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_good(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    return _side(spark, target, _GOOD, schema)


def read_broken(spark: SparkSession, target: str) -> DataFrame:
    return _side(spark, target, _BAD, BROKEN)
