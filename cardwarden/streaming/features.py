"""Features of a stream of raw transactions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.dictionary import distinct_values, new_entries
from ..operators.features import ENCODED, build_features
from ..session import scratch_scope, stage
from ..sources.commits import CommitLog, State
from ..sources.upserts import append_batch, append_if_unchanged, read_batches, replace_all, writer_of


def feature_stream(
    raw: DataFrame, dictionaries: Mapping[str, DataFrame], how: str = "inner"
) -> DataFrame:
    """The batch features, keyed by the transaction number."""
    return build_features(raw, dictionaries, key="trans_num", how=how)


def _dictionary_schema(column: str, id_column: str) -> T.StructType:
    return T.StructType([
        T.StructField(column, T.StringType()), T.StructField(id_column, T.LongType()),
    ])


def save_dictionary(dictionary: DataFrame, path: str) -> None:
    """Store a dictionary that streams may extend; one that is there already is replaced."""
    replace_all(dictionary, path, "initial")


def load_dictionary(
    spark: SparkSession, path: str, column: str, id_column: str, state: State | None = None
) -> DataFrame:
    """The entries stored; with ``state``, those of that state of the dictionary."""
    schema = _dictionary_schema(column, id_column)
    return read_batches(spark, path, schema, state=state).select(column, id_column)


def extend_stored(
    df: DataFrame, path: str, column: str, id_column: str, batch_id: int, writer: str
) -> DataFrame:
    """Add the values of ``df`` that the stored dictionary lacks; returns all entries.

    Any number of queries may do so at once. Ids are allocated on a state of the dictionary and committed only if it is still
    the newest; whoever comes second sees the other's entries and allocates again for what is left. So a
    value has one id, an id one value, and ids have no gaps. A replay finds its values there.
    """
    log = CommitLog(df.sparkSession, path)
    values = stage(distinct_values(df, column), "values")
    while True:
        state = log.state()
        known = load_dictionary(df.sparkSession, path, column, id_column, state)
        entries = stage(new_entries(known, values, column, id_column), "entries")
        if entries.isEmpty():
            return known
        if append_if_unchanged(entries, path, state, batch_id, writer):
            return known.unionByName(entries)


def refreshing_features(
    dictionary_paths: Mapping[str, str], target: str, checkpoint: str
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds the batch's unseen values to the dictionaries before
    it encodes, so no row is lost.

    The query is named by its checkpoint: what it writes never replaces another query's. Any number of such queries may extend a dictionary at once; see
    ``extend_stored``. Entries are never changed, hence a replay gives the same ids again. A batch without unseen values adds
    nothing to a dictionary, and its scratch tables go with it.
    """
    writer = writer_of(checkpoint)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            with scratch_scope(spark):
                dictionaries = {}
                for column, id_column in ENCODED.items():
                    path = dictionary_paths[column]
                    dictionaries[column] = extend_stored(batch, path, column, id_column, batch_id, writer)
                append_batch(feature_stream(batch, dictionaries), target, batch_id, writer)
        finally:
            batch.unpersist()

    return process


def streaming_source(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """A stream of the parquet files in a folder; fewer files per batch mean smaller batches."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
