"""Schemas of the collections. Raw records arrive with every field as text."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: The fields of a raw transaction.
RAW_TXN = _strings(
    "trans_date_trans_time", "cc_num", "merchant", "category", "amt", "first", "last",
    "gender", "street", "city", "state", "zip", "lat", "long", "city_pop", "job", "dob",
    "trans_num", "unix_time", "merch_lat", "merch_long", "is_fraud",
)

#: Change-feed record: what happened, and the whole record after it.
CHANGE = T.StructType([
    T.StructField("operationType", T.StringType()),
    T.StructField("fullDocument", RAW_TXN),
])

#: Per-card limits; the same document is the account holder's profile.
RULES = T.StructType([
    T.StructField("cc_num", T.StringType()),
    T.StructField("ACCT_AVL_CASH_BEFORE_AMT", T.DoubleType()),
    T.StructField("ACCT_CL_AMT", T.DoubleType()),
    T.StructField("AVG_DLY_AUTHZN_AMT", T.DoubleType()),
    T.StructField("email", T.StringType()),
    T.StructField("first", T.StringType()),
    T.StructField("last", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("dob", T.StringType()),
])

#: The fields of a merchant record.
MERCHANT = T.StructType([
    T.StructField("merchant", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("street", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("zip", T.IntegerType()),
    T.StructField("city_pop", T.IntegerType()),
    T.StructField("merch_lat", T.DoubleType()),
    T.StructField("merch_long", T.DoubleType()),
])

STATUS = T.StructType([
    T.StructField("txn_num", T.StringType()),
    T.StructField("status_ts", T.TimestampType()),
    T.StructField("txn_status", T.StringType()),
])

RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("n_estimators", T.IntegerType()),
    T.StructField("auc", T.DoubleType()),
    T.StructField("auc_thresholded", T.DoubleType()),
    T.StructField("model_path", T.StringType()),
])

#: The raw columns the feature build reads, after its key.
FEATURE_INPUTS = [
    "cc_num", "category", "amt", "zip", "lat", "long", "gender", "city_pop",
    "merch_lat", "merch_long", "dob", "trans_date_trans_time", "is_fraud",
]

#: The typed feature columns, after the key and before encoding.
FEATURE_COLUMNS = [
    "cc_num", "category", "gender", "amt", "zip", "lat", "long", "city_pop",
    "merch_lat", "merch_long", "age", "hour", "day", "month", "is_fraud",
]

#: The model's inputs, by name.
MODEL_FEATURES = [
    "amt", "cat_id", "city_pop", "day", "hour", "lat", "long", "merch_lat", "merch_long",
    "month", "zip",
]
