"""From raw text records to typed model features; one code path for batch and streams."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import age, birth_date, calendar_fields, number, txn_time
from ..schemas import FEATURE_COLUMNS, FEATURE_INPUTS, MODEL_FEATURES
from .dictionary import encode

#: Numeric type of each feature column that arrives as text.
FEATURE_TYPES = {
    "amt": "double",
    "lat": "double",
    "long": "double",
    "merch_lat": "double",
    "merch_long": "double",
    "is_fraud": "int",
    "city_pop": "int",
    "zip": "int",
}

#: Columns encoded by a dictionary, with the id column that replaces each.
ENCODED = {"category": "cat_id", "gender": "gender_id"}


def with_id(df: DataFrame, key: str = "trans_num", name: str = "_id") -> DataFrame:
    """Copy the transaction number into the document key."""
    return df.withColumn(name, F.col(key))


def calendar_features(
    df: DataFrame, ts: str = "trans_date_trans_time", born: str = "dob"
) -> DataFrame:
    """Parse both dates and add hour, day, month and age."""
    parsed = df.withColumns({ts: txn_time(ts), born: birth_date(born)})
    return parsed.withColumns({**calendar_fields(ts), "age": age(ts, born)})


def cast_features(df: DataFrame) -> DataFrame:
    """Give each numeric feature its type; text that is no number becomes NULL."""
    return df.withColumns({c: number(c, kind) for c, kind in FEATURE_TYPES.items() if c in df.columns})


def featurize(df: DataFrame, key: str = "_id") -> DataFrame:
    """Typed features with category and gender still as text."""
    dated = calendar_features(df.select(key, *FEATURE_INPUTS))
    return cast_features(dated.select(key, *FEATURE_COLUMNS))


def build_features(
    df: DataFrame,
    dictionaries: Mapping[str, DataFrame],
    key: str = "_id",
    how: str = "inner",
) -> DataFrame:
    """The full feature row: typed, dated and encoded."""
    features = featurize(df, key)
    for column, id_column in ENCODED.items():
        features = encode(features, dictionaries[column], column, id_column, how)
    return features


def model_inputs(df: DataFrame) -> DataFrame:
    """Narrow the whole-number model inputs to 32 bits, as the model was trained on them."""
    narrow = ["city_pop", "day", "hour", "month", "zip"]
    return df.withColumns({c: F.col(c).cast("int") for c in narrow})


def training_set(
    labels: DataFrame, features: DataFrame, key: str = "_id", exclude: tuple[str, ...] = ("_id",)
) -> DataFrame:
    """Labels with their looked-up features, less the excluded columns.

    Both sides are unique in ``key``, so no group is large. Stored as tables bucketed by the key
    (``sources.write_table``), they join without a shuffle.
    """
    return labels.join(features, key, "left").drop(*exclude)


def separate(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Label and model features, without the columns the model must not see."""
    return df.drop("cc_num", "age", "gender_id").select(label, *MODEL_FEATURES)
