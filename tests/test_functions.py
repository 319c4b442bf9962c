import datetime as dt

from pyspark.sql import functions as F

from cardwarden import functions as fn
from cardwarden.operators import features as feat
from cardwarden.operators.quality import contact_quality
from cardwarden.operators.spend import user_spend


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_both_time_formats_and_calendar(spark, raw_rows):
    rows = {r["trans_num"]: r for r in feat.calendar_features(raw_rows).collect()}
    assert rows["a"]["trans_date_trans_time"] == dt.datetime(2020, 5, 6, 0, 7, 8)
    assert rows["b"]["trans_date_trans_time"] == dt.datetime(2021, 8, 9, 10, 11, 12, 345000)
    assert (rows["b"]["hour"], rows["b"]["day"], rows["b"]["month"]) == (10, 9, 8)


def test_age_ignores_the_birthday(spark, raw_rows):
    ages = {r["trans_num"]: r["age"] for r in feat.calendar_features(raw_rows).collect()}
    assert ages == {"a": 29, "b": 36, "c": 29, "d": None}


def test_clock_fields_do_not_depend_on_the_session_time_zone(spark, raw_rows):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        hours = {r["trans_num"]: r["hour"] for r in feat.calendar_features(raw_rows).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert hours["a"] == 0 and hours["b"] == 10


def test_bad_numbers_become_null(spark, raw_rows):
    rows = {r["trans_num"]: r for r in feat.featurize(raw_rows, "trans_num").collect()}
    assert rows["c"]["amt"] is None and rows["c"]["is_fraud"] == 1
    assert rows["d"]["zip"] is None and rows["a"]["zip"] == 1234
    assert rows["a"]["amt"] == 20.25


def test_feature_types(spark, raw_rows):
    types = dict(feat.featurize(feat.with_id(raw_rows)).dtypes)
    assert types["_id"] == "string" and types["cc_num"] == "string"
    assert {types[c] for c in ("amt", "lat", "long", "merch_lat", "merch_long")} == {"double"}
    assert {types[c] for c in ("age", "hour", "day", "month", "zip", "city_pop", "is_fraud")} == {"int"}


def test_card_number(spark):
    row = one(spark, "a string, b string, c string, d string", ("9300000000000000017", " 0042 ", "4x", "0"),
              *[fn.card_number(c).alias(c) for c in "abcd"])
    assert tuple(row) == (9300000000000000017, 42, None, 0)


def test_card_keys(spark):
    rows = spark.createDataFrame([("0",), ("000",), (" 0042 ",), ("",), (" ",), (None,), ("9300000000000000017",)], "a string")
    assert [r[0] for r in rows.select(fn.card_key("a")).collect()] == ["0", "0", "42", None, None, None, "9300000000000000017"]


def test_only_the_written_formats_are_dates_and_times(spark):
    times = ["2020-05-06 00:07:08", "2020-05-06T00:07:08.5Z", "2020", "2020-05-06", "2020-05-06T00", "2020-13-01 00:00:00", "2020-05-06 00:07:08+02:00", None, "2023-02-14T06:36:30Z", "2023-02-14T06:36:30.Z"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(fn.txn_time("t")).collect()]
    assert [g is not None for g in got] == [True, True, *[False] * 6, True, False]
    born = ["1991-02-03", "1991", "1991-02", "1991-02-30", "1991-02-03 00:00:00", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in born], "t string").select(fn.birth_date("t")).collect()]
    assert got == [dt.date(1991, 2, 3), *[None] * 5]


def test_merchant_name_loses_only_the_first_prefix(spark):
    row = one(spark, "a string, b string, c string",
              ("fraud_Lantern and Oak", "fraud_fraud_X", "No prefix"),
              *[fn.merchant_name(c).alias(c) for c in "abc"])
    assert tuple(row) == ("Lantern and Oak", "fraud_X", "No prefix")


def test_clock_and_epoch_text(spark):
    for zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        row = one(spark, "t timestamp_ntz", (dt.datetime(2021, 8, 9, 10, 11, 12, 500000),),
                  fn.clock_text("t"), fn.epoch_text("t"))
        assert tuple(row) == ("2021-08-09 10:11:12", "1628503873")


def test_contact_quality(spark):
    rows = spark.createDataFrame(
        [("a@b.c", "Ann", "Lee"), ("", "", ""), (None, None, None), ("a@b", "Ann", None)],
        "email string, first string, last string",
    )
    found = [(r["email_error"], r["name_error"]) for r in contact_quality(rows).collect()]
    assert found == [
        ("", ""),
        ("Email can't be empty.", "Name can't be empty."),
        ("Email can't be empty.", "Name can't be empty."),
        ("Ooops! We need a valid email address.", ""),
    ]


def test_over_is_strict_and_safe(spark):
    rows = spark.createDataFrame([(0.3,), (0.31,), (float("nan"),), (None,)], "s double")
    assert [r[0] for r in rows.select(fn.over("s", 0.3)).collect()] == [0, 1, 0, 0]


def test_user_spend_counts_every_transaction(spark, raw_rows):
    row = user_spend(raw_rows).first()
    assert row["total"] == 3040.5 and row["ntxn"] == 4 and row["ftxn"] == 1
    assert row["avg_txn_amt"] == 3040.5 / 3


def test_narrow_model_inputs(spark):
    row = spark.range(1).select(*[F.col("id").alias(c) for c in ("city_pop", "day", "hour", "month", "zip")])
    assert {t for _, t in feat.model_inputs(row).dtypes} == {"int"}
