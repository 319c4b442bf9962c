import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cardwarden.operators.joins import lookup_join, spread_join
from cardwarden.session import settings, stage

random.seed(3)
# One key holds a third of the rows, NULL a tenth; some keys have no lookup row, some have two.
KEYS = [7 if random.random() < 0.34 else None if random.random() < 0.15 else random.randrange(60)
        for _ in range(4000)]
LEFT = [(k, i) for i, k in enumerate(KEYS)]
RIGHT = [(k, f"r{k}-{j}") for k in range(3, 80) for j in range(1 + (k % 4 == 3))] + [(None, "none")]


def expected(how):
    found = {}
    for k, v in RIGHT:
        if k is not None:
            found.setdefault(k, []).append(v)
    out = []
    for k, i in LEFT:
        hits = found.get(k, [])
        if how in ("inner", "left"):
            out += [(k, i, v) for v in hits] or ([(k, i, None)] if how == "left" else [])
        elif bool(hits) == (how == "left_semi"):
            out.append((k, i))
    return Counter(out)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame(LEFT, "k int, i int").repartition(6)
    return left, spark.createDataFrame(RIGHT, "k int, v string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("salts", [1, 5])
@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_every_path_gives_the_same_rows(spark, sides, how, salts, limit):
    left, right = sides
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=limit, spark__sql__adaptive__autoBroadcastJoinThreshold=limit):
        joined = lookup_join(left, right, "k", how, salts)
        assert Counter(map(tuple, joined.collect())) == expected(how)


def test_each_side_is_read_once(spark, sides):
    left, right = (stage(s, "side") for s in sides)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        plan = lookup_join(left, right, "k", "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "SortMergeJoin" in plan


def test_salts_deal_a_hot_key_to_several_tasks(sides):
    left, right = sides
    joined = lookup_join(left, right, "k", "inner", 8).where("k = 7")
    assert joined.count() == sum(k == 7 for k in KEYS) * 2
    salt = F.pmod(F.xxhash64("k", "i"), F.lit(8))
    assert left.where("k = 7").select(salt).distinct().count() == 8


def test_two_column_keys(spark):
    left = spark.createDataFrame([(i % 3, i % 2, i) for i in range(600)], "a int, b int, i int")
    right = spark.createDataFrame([(0, 0, "x"), (1, 1, "y")], "a int, b int, v string")
    joined = lookup_join(left, right, ["a", "b"], "left")
    assert joined.count() == 600
    assert joined.where("v = 'x'").count() == 100 and joined.where("v is null").count() == 400


def test_a_result_larger_than_its_tables_is_dealt_by_its_rows(spark):
    """1,500 x 40 rows of one key, single rows, missing and null keys: as a plain left join, in many parts."""
    left = spark.range(2000).selectExpr("case when id < 1500 then 'hot' when id < 1900 then concat('k', id % 50) end as k", "id", "id % 7 as more")
    right = spark.range(80).selectExpr("case when id < 40 then 'hot' when id < 75 then concat('k', id % 30) end as k", "id as limit")
    got = spread_join(left, right, "k", pair_rows=5000)
    want = left.join(right, "k", "left").select(*got.columns)
    assert got.columns == ["k", "id", "more", "limit"] and want.count() > 60_000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    sizes = [len(p) for p in got.select("id").rdd.glom().collect()]
    assert len(sizes) > 12 and max(sizes) < 25_000, sizes


def test_pairs_of_few_left_rows_and_of_equal_rows_are_dealt_too(spark):
    """3 x 20,000 pairs of one key and 400 equal rows x 50 of another: by the left rows' values all pairs of a row, or of equal rows, were one task's."""
    left = spark.range(403).selectExpr("if(id < 3, 'wide', 'equal') as k", "if(id < 3, id, 0) as id")
    right = spark.range(20050).selectExpr("if(id < 20000, 'wide', 'equal') as k", "id % 5 as limit")
    got = spread_join(left, right, "k", pair_rows=5000)
    sizes = [len(p) for p in got.select("id").rdd.glom().collect()]
    assert sum(sizes) == 80_000 and max(sizes) < 20_000, sizes


@pytest.mark.parametrize("pair_rows", [1, 4, 50, 1000])
def test_blocks_and_shares_change_no_row(spark, pair_rows):
    """Blocks of one right row and more, some left empty; keys on one side only, null keys, null limits and rows that come twice."""
    left = spark.createDataFrame([(k, i // 2) for i, k in enumerate(["a"] * 12 + ["b"] + ["c"] * 3 + ["left only"] * 9 + [None] * 7)], "k string, id int")
    rows = [("a", 1.0)] * 3 + [("a", None)] * 2 + [("b", float(i % 3)) for i in range(31)] + [("c", 2.0), ("right only", 3.0), (None, 4.0), (None, 4.0)] + [("right only", 5.0)] * 20
    right = spark.createDataFrame(rows, "k string, limit double")
    got = spread_join(left, right, "k", pair_rows=pair_rows)
    assert got.dtypes == [("k", "string"), ("id", "int"), ("limit", "double")]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, "k", "left").collect()))


def test_what_is_moved_grows_with_the_root_of_the_pairs_of_a_task(spark):
    """400 x 200 pairs in tasks of 1,000: 400 rows for each of 7 blocks and 7 blocks for each of 12 shares, not 200 rows for each of 80."""
    left, right = (spark.range(n).selectExpr("1 as k", f"id as {c}") for n, c in ((400, "id"), (200, "limit")))
    got = spread_join(left, right, "k", pair_rows=1000)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        assert Counter(r["id"] for r in got.collect()) == Counter({i: 200 for i in range(400)})
    stages = got._jdf.queryExecution().executedPlan().executedPlan().plan().collectLeaves()
    moved = [stages.apply(i).shuffle().metrics().apply("shuffleRecordsWritten").value() for i in range(stages.size())]
    assert sorted(moved) == [84, 2800]
