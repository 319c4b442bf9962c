"""A collection kept up from its change feed: inserts, replacements, partial updates and deletes, in whatever order and however often they arrive.

An event has a key and its place in the feed, ``at``, unique within the key. ``insert`` and ``replace`` carry a whole document; ``update`` may carry one, or
else the changed fields, as a map from the field's name to its new value as text (NULL unsets it); ``delete`` carries nothing.

The state of a key is, for each field, the value with the greatest place, and for the document, its last beginning or end with its place. Whole documents and deletes
speak for all fields. Taking the greatest of everything is the merge, so late and repeated events change nothing they should not: a late partial update does not
touch what came after it, and one before its document's insert waits for it. Deletes stay as tombstones, which keep late events from bringing a document back.
A partial update alone makes no document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merged import MergedTable

#: Kinds of events.
WHOLE = ("insert", "replace")
UPDATE = "update"
DELETE = "delete"


def change_schema(document: T.StructType, at: T.DataType) -> T.StructType:
    """The columns of an event."""
    return T.StructType([
        T.StructField("operationType", T.StringType()), T.StructField("key", T.StringType()), T.StructField("at", at),
        T.StructField("fullDocument", document), T.StructField("changed", T.MapType(T.StringType(), T.StringType())),
    ])


def state_schema(document: T.StructType, at: T.DataType) -> T.StructType:
    begin = T.StructType([T.StructField("at", at), T.StructField("alive", T.BooleanType())])
    values = [T.StructField(f.name, T.StructType([T.StructField("at", at), T.StructField("value", f.dataType)])) for f in document.fields]
    return T.StructType([T.StructField("key", T.StringType()), T.StructField("begin", begin), T.StructField("fields", T.StructType(values))])


def event_states(events: DataFrame, document: T.StructType) -> DataFrame:
    """What each event says of its key; events of other kinds, or without key or place, say nothing."""
    kind, at = F.col("operationType"), F.col("at")
    whole = (kind.isin(*WHOLE) | (kind == UPDATE)) & F.col("fullDocument").isNotNull()
    ends = kind == DELETE
    begin = F.when(whole & kind.isin(*WHOLE) | ends, F.struct(at.alias("at"), whole.alias("alive")))
    fields = []
    for f in document.fields:
        partial = (kind == UPDATE) & F.map_contains_key("changed", F.lit(f.name))
        value = F.when(whole, F.col(f"fullDocument.`{f.name}`")).when(partial, F.col("changed")[f.name].try_cast(f.dataType))
        fields.append(F.when(whole | ends | F.coalesce(partial, F.lit(False)), F.struct(at.alias("at"), value.alias("value"))).alias(f.name))
    kinds = [*WHOLE, UPDATE, DELETE]
    said = events.where(kind.isin(*kinds) & F.col("key").isNotNull() & at.isNotNull())
    return said.select("key", begin.alias("begin"), F.struct(*fields).alias("fields"))


def combine_states(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The state of a key from several: the greatest of everything."""
    names = rows.schema["fields"].dataType.names
    merged = rows.groupBy(*by).agg(F.max("begin").alias("begin"), *[F.max(f"fields.`{n}`").alias(f"_{i}") for i, n in enumerate(names)])
    return merged.select(*by, "begin", F.struct(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)]).alias("fields"))


def documents_of(states: DataFrame) -> DataFrame:
    """The documents that exist, with their key."""
    names = states.schema["fields"].dataType.names
    return states.where("begin.alive").select("key", *[F.col(f"fields.`{n}`.value").alias(n) for n in names])


def change_table(spark: SparkSession, target: str, document: T.StructType, at: T.DataType, buckets: int = 16) -> MergedTable:
    """The states of a collection; ``documents_of(table.read())`` are its documents."""
    return MergedTable(spark, target, state_schema(document, at), "key", combine_states, buckets)


def apply_changes(table: MergedTable, events: DataFrame, document: T.StructType, writer: str, batch_id: int) -> bool:
    """Merge a batch of events; it is not merged twice."""
    return table.merge(event_states(events, document), writer, batch_id)
