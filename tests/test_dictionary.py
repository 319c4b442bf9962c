import random

from cardwarden.operators import dictionary as dic
from cardwarden.operators.features import ENCODED, build_features, with_id
from cardwarden.operators.ranking import first_rows, latest_rows


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_ids_follow_value_order(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "v string")
    assert as_dict(dic.build_dictionary(rows, "v", "id")) == {"a": 0, "b": 1, "c": 2}


def test_numbering_goes_by_value_and_not_by_partition(spark):
    random.seed(1)
    values = [f"{random.random()}" for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values] * 3, "v string")
    for parts in (1, 7):
        found = as_dict(dic.build_dictionary(rows.repartition(parts), "v", "id"))
        assert found == {v: i for i, v in enumerate(sorted(values))}


def test_several_dictionaries_in_one_scan(spark, raw_rows):
    made = dic.build_dictionaries(raw_rows, ENCODED)
    assert as_dict(made["category"]) == {"books": 0, "music": 1, "travel": 2}
    assert as_dict(made["gender"]) == {"F": 0, "M": 1}


def test_extension_keeps_old_ids(spark):
    old = spark.createDataFrame([("m", 0), ("z", 7)], "v string, id bigint")
    rows = spark.createDataFrame([("z",), ("b",), ("a",), ("a",), (None,)], "v string")
    assert as_dict(dic.extend_dictionary(old, rows, "v", "id")) == {"m": 0, "z": 7, "a": 8, "b": 9}


def test_extension_of_an_empty_dictionary(spark):
    old = spark.createDataFrame([], "v string, id bigint")
    rows = spark.createDataFrame([("b",), ("a",)], "v string")
    assert as_dict(dic.extend_dictionary(old, rows, "v", "id")) == {"a": 0, "b": 1}


def test_unseen_values_drop_or_stay(spark):
    d = spark.createDataFrame([("a", 0)], "v string, id bigint")
    rows = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "k int, v string")
    assert [tuple(r) for r in dic.encode(rows, d, "v", "id").collect()] == [(1, 0)]
    kept = dic.encode(rows, d, "v", "id", "left").orderBy("k").collect()
    assert [tuple(r) for r in kept] == [(1, 0), (2, -1), (3, -1)]


def test_features_are_encoded(spark, raw_rows):
    features = build_features(with_id(raw_rows), dic.build_dictionaries(raw_rows, ENCODED))
    assert "category" not in features.columns and "gender" not in features.columns
    rows = {r["_id"]: (r["cat_id"], r["gender_id"]) for r in features.collect()}
    assert rows == {"a": (0, 1), "b": (1, 0), "c": (2, 1), "d": (0, 1)}


def test_latest_and_first_rows(spark):
    random.seed(2)
    data = [(random.randrange(9), random.randrange(50), i) for i in range(500)]
    rows = spark.createDataFrame(data, "k int, t int, i int").repartition(6)
    best, least = {}, {}
    for k, t, i in data:
        best[k] = max(best.get(k, (-1, -1)), (t, i))
        least[k] = min(least.get(k, (99, 999)), (t, i))
    assert {r["k"]: (r["t"], r["i"]) for r in latest_rows(rows, "k", ["t", "i"]).collect()} == best
    assert {r["k"]: (r["t"], r["i"]) for r in first_rows(rows, "k", ["t", "i"]).collect()} == least
