"""Collections and tables. The format is a parameter, so any installed connector will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.quality import require_primary_key


def read_source(
    spark: SparkSession,
    schema: T.StructType | None = None,
    format: str = "parquet",
    path: str | None = None,
    streaming: bool = False,
    **options: str,
) -> DataFrame:
    """Scan a collection, once or as a stream of inserts.

    With a schema, a field some records lack reads as NULL and nothing is inferred.
    """
    reader = (spark.readStream if streaming else spark.read).format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def write_collection(
    df: DataFrame, path: str | None = None, format: str = "parquet", mode: str = "overwrite", **options: str
) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    writer.save(path) if path else writer.save()


def write_table(
    df: DataFrame,
    name: str,
    path: str | None = None,
    bucket_by: str | None = None,
    buckets: int = 0,
    mode: str = "overwrite",
) -> DataFrame:
    """Write a catalog table and return it as read back.

    Tables bucketed by the same key and number of buckets join on that key without a shuffle.
    """
    if bucket_by:
        # One task per bucket, so that each bucket is one sorted file.
        df = df.repartition(buckets, bucket_by)
    writer = df.write.format("parquet").mode(mode)
    if path:
        writer = writer.option("path", path)
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)
    return df.sparkSession.read.table(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def write_feature_table(
    df: DataFrame, name: str, primary_key: str, label: str = "is_fraud", **table
) -> DataFrame:
    """Write features, without the label, under a primary key that is checked first."""
    require_primary_key(df, primary_key)
    return write_table(df.drop(label), name, **table)


def new_only(df: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key the target does not hold yet.

    Both sides are unique in the key. Where the source only ever adds files, ``load_new_files``
    finds the same rows without comparing keys.
    """
    return df.join(target.select(key), key, "left_anti")


def load_new_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append what arrived on the streaming ``df`` since the last call, then stop."""
    (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
        .awaitTermination()
    )
