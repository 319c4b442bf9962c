"""Dictionaries: a stable number for each distinct value of a column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .joins import lookup_join
from .ranking import number_rows

UNKNOWN_ID = -1


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column; NULL is no value, as no join could ever find it."""
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def build_dictionary(df: DataFrame, column: str, id_column: str) -> DataFrame:
    """Number the distinct values from 0 in their own order."""
    numbered = number_rows(stage(distinct_values(df, column)), [column], id_column)
    return stage(numbered, "dictionary")


def build_dictionaries(df: DataFrame, columns: Mapping[str, str]) -> dict[str, DataFrame]:
    """One dictionary per column, all from a single scan of ``df``."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    values = stage(
        df.select(F.explode(pairs).alias("p"))
        .select("p.field", "p.value")
        .where(F.col("value").isNotNull())
        .distinct()
    )
    return {
        column: stage(
            number_rows(
                values.where(F.col("field") == column)
                .select(F.col("value").cast(df.schema[column].dataType).alias(column)),
                [column],
                id_column,
            ),
            "dictionary",
        )
        for column, id_column in columns.items()
    }


def new_entries(dictionary: DataFrame, df: DataFrame, column: str, id_column: str) -> DataFrame:
    """Entries for the values of ``df`` the dictionary lacks, numbered on from its last id."""
    unseen = stage(distinct_values(df, column).join(dictionary, column, "left_anti"))
    last = dictionary.agg(F.max(id_column).alias("last")).first()["last"]
    start = 0 if last is None else last + 1
    numbered = number_rows(unseen, [column], id_column)
    return numbered.withColumn(id_column, F.col(id_column) + F.lit(start).cast("bigint"))


def extend_dictionary(
    dictionary: DataFrame, df: DataFrame, column: str, id_column: str
) -> DataFrame:
    """The dictionary with the unseen values of ``df`` added; ids once given never change."""
    return dictionary.unionByName(new_entries(dictionary, df, column, id_column))


def encode(
    df: DataFrame,
    dictionary: DataFrame,
    column: str,
    id_column: str,
    how: str = "inner",
    keep: bool = False,
) -> DataFrame:
    """Replace a column by its dictionary id, in batch or in a stream.

    ``inner`` drops rows whose value the dictionary lacks; ``left`` keeps them with id -1.
    """
    joined = lookup_join(df, dictionary.select(column, id_column), column, how)
    if how == "left":
        joined = joined.withColumn(id_column, F.coalesce(id_column, F.lit(UNKNOWN_ID).cast("bigint")))
    return joined if keep else joined.drop(column)
