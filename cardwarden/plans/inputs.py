"""The collections, derived from the test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..session import stage
from ..streaming.features import streaming_source


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # A pattern, as a plain streaming path must be a folder and the table may be a single file.
    return streaming_source(spark, f"{sf_dir}/events.parque[t]", schema)


def card_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events with their customer."""
    if events is None:
        events = table(spark, sf_dir, "events")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_name", "c_nationkey", "c_mktsegment"
    )
    return lookup_join(events.drop("props"), customers, "user_id")


RAW_COLUMNS = {
    "trans_num": "cast(event_id as string)",
    "trans_date_trans_time": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    "cc_num": "cast(user_id as string)",
    "merchant": "concat('fraud_Shop ', cast(event_id % 40 as string))",
    "category": "event_type",
    "amt": "cast(value as string)",
    "first": "split_part(c_name, '#', 1)",
    "last": "split_part(c_name, '#', 2)",
    "gender": "c_mktsegment",
    "zip": "cast(10000 + c_nationkey as string)",
    "lat": "cast(30.0D + c_nationkey * 0.5D as string)",
    "long": "cast(-100.0D + user_id % 40 as string)",
    "city_pop": "cast(1000 + user_id * 37 as string)",
    "dob": "date_format(date_add(date'1950-01-01', cast(user_id * 97 % 18000 as int)), 'yyyy-MM-dd')",
    "merch_lat": "cast(30.0D + event_id % 20 * 0.5D as string)",
    "merch_long": "cast(-100.0D + event_id % 30 as string)",
    "is_fraud": "case when event_type = 'error' and value > 100 then '1' else '0' end",
}


def raw_txn(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Raw transactions, all text; from the events table or a stream of it."""
    rows = card_events(spark, sf_dir, events)
    return rows.select(*[F.expr(e).alias(c) for c, e in RAW_COLUMNS.items()])


DIRTY_COLUMNS = RAW_COLUMNS | {
    "trans_date_trans_time": "case event_id % 7 when 0 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
    " when 1 then '2024' when 2 then date_format(ts, 'yyyy-MM-dd')"
    " else date_format(ts, 'yyyy-MM-dd HH:mm:ss') end",
    "amt": "case event_id % 10 when 0 then 'abc' when 1 then '' when 2 then null else cast(value as string) end",
    "dob": "case user_id % 5 when 0 then '1980' when 1 then '1980-13-40' else '1981-02-03' end",
    "cc_num": "case user_id % 9 when 0 then '0' when 1 then concat('93000000000000', lpad(cast(user_id as string), 5, '0'))"
    " else concat(' 00', cast(user_id as string)) end",
    "zip": "case event_id % 4 when 0 then '12x' else '777' end",
}


def dirty_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transactions with bad numbers, three kinds of times, partial dates, card 0 and cards beyond 64 bits."""
    rows = card_events(spark, sf_dir)
    return rows.select(*[F.expr(e).alias(c) for c, e in DIRTY_COLUMNS.items()])


def dirty_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of those cards, some NaN, some cards twice."""
    rules = table(spark, sf_dir, "customer").selectExpr(
        "case c_custkey % 9 when 0 then '000' when 1 then concat('93000000000000', lpad(cast(c_custkey as string), 5, '0'))"
        " else cast(c_custkey as string) end as cc_num",
        "case when c_custkey % 6 = 0 then double('NaN') else 150.0D end as ACCT_AVL_CASH_BEFORE_AMT",
        "50.0D * (c_custkey % 10) as ACCT_CL_AMT",
        "double('NaN') as AVG_DLY_AUTHZN_AMT",
        "explode(sequence(0, case when c_custkey % 8 = 0 then 1 else 0 end)) as copy",
    )
    return stage(rules.where("cc_num <> '000' or copy = 1").drop("copy"), "dirty_rules")


def order_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger set of transactions for the spend report."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name"
    )
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderstatus")
    return lookup_join(orders, customers, "o_custkey").select(
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last"),
        F.col("o_totalprice").alias("amt"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_fraud"),
    )


def account_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits per card, as a stored collection."""
    daily = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("c_custkey"))
        .agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / 30).alias("avgv"))
    )
    rules = (
        table(spark, sf_dir, "customer")
        .where("c_custkey % 7 <> 0")
        .join(daily, "c_custkey", "left")
        .selectExpr(
            "cast(c_custkey as string) as cc_num",
            "c_acctbal as ACCT_AVL_CASH_BEFORE_AMT",
            "50.0D * (c_custkey % 10) as ACCT_CL_AMT",
            "avgv as AVG_DLY_AUTHZN_AMT",
            "concat(lower(c_mktsegment), '@',"
            " case when c_custkey % 11 = 0 then 'nodot' else 'mail.example' end) as email",
        )
    )
    return stage(rules, "rules")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account holders; some e-mail addresses and names are empty or bad."""
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) as cc_num",
        "split_part(c_name, '#', 1) as first",
        "split_part(c_name, '#', 2) as last",
        "case when c_custkey % 13 = 0 then '' when c_custkey % 17 = 0 then null"
        " else concat(lower(c_mktsegment), '@',"
        " case when c_custkey % 11 = 0 then 'nodot' else 'mail.example' end) end as email",
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchant records; some names carry the prefix twice or not at all."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat(case when s_suppkey % 7 = 0 then 'fraud_fraud_' when s_suppkey % 5 = 0 then ''"
        " else 'fraud_' end, 'Shop ', cast(s_suppkey % 40 as string)) as merchant",
        "s_name as street",
        "cast(s_nationkey as string) as state",
        "10000 + s_nationkey as zip",
        "30.0D + s_nationkey * 0.5D as merch_lat",
    )


def txn_times(events: DataFrame) -> DataFrame:
    return events.selectExpr("cast(event_id as string) as trans_num", "ts")


def txn_status(events: DataFrame) -> DataFrame:
    """Verdicts: one transaction in five has none, some come too late."""
    return events.where("event_id % 5 <> 0").selectExpr(
        "cast(event_id as string) as txn_num",
        "ts + make_dt_interval(0, 0, 0, event_id % 90) as status_ts",
        "case when value > 250 then 'REJECTED' else 'AUTHORIZED' end as txn_status",
    )


def repeated_status(events: DataFrame) -> DataFrame:
    """Those verdicts, each again five seconds later, and for some transactions an earlier one before them."""
    seconds = "ts + make_dt_interval(0, 0, 0, {})"
    return events.where("event_id % 5 <> 0").selectExpr(
        "cast(event_id as string) as txn_num",
        f"""inline(filter(array(
            named_struct('status_ts', {seconds.format("event_id % 90")}, 'txn_status', case when value > 250 then 'REJECTED' else 'AUTHORIZED' end),
            named_struct('status_ts', {seconds.format("event_id % 90 + 5")}, 'txn_status', 'AGAIN'),
            named_struct('status_ts', {seconds.format("event_id % 90")}, 'txn_status', case when value > 250 then 'REJECTED' else 'AUTHORIZED' end),
            named_struct('status_ts', {seconds.format("event_id % 90 * 0.5")}, 'txn_status', case event_id % 3 when 0 then 'EARLY' end)
        ), s -> s.txn_status is not null))""",
    )


def mixed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change feed over some keys per user, in the order of the event ids: replacements, deletes, and updates of one field or both."""
    return table(spark, sf_dir, "events").selectExpr(
        "case when event_id % 10 = 0 then 'delete' when event_id % 10 in (1, 2) then 'replace' else 'update' end as operationType",
        "concat(cast(user_id as string), '-', cast(event_id % 7 as string)) as key",
        "event_id as at",
        "case when event_id % 10 in (1, 2) then named_struct('category', event_type, 'amt', value) end as fullDocument",
        "case when event_id % 10 > 2 then map_from_entries(filter(array(if(event_id % 4 < 2, named_struct('key', 'category', 'value', event_type), null),"
        " if(event_id % 4 > 0, named_struct('key', 'amt', 'value', cast(value as string)), null)), e -> e is not null)) end as changed",
    )


def dated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of cards that have some; every third card's cash is halved on a day within the range."""
    rules = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0")
    rows = rules.selectExpr(
        "cast(c_custkey as string) as cc_num", "50.0D * (c_custkey % 10) as ACCT_CL_AMT",
        "inline(filter(array(named_struct('valid_from', cast(null as timestamp_ntz), 'ACCT_AVL_CASH_BEFORE_AMT', c_acctbal),"
        " named_struct('valid_from', timestamp_ntz'2024-01-10 12:00:00', 'ACCT_AVL_CASH_BEFORE_AMT', if(c_custkey % 3 = 0, c_acctbal / 2, null))),"
        " r -> r.valid_from is null or c_custkey % 3 = 0))",
    )
    return stage(rows, "dated_rules")


def broken_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a message; some are cut off, some no JSON, some no object, some empty."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(event_id as string) as key",
        "case when event_id % 11 = 0 then concat('{\"trans_num\": \"', cast(event_id as string), '\", \"am')"
        " when event_id % 13 = 0 then '{bad' when event_id % 17 = 0 then '[1, 2]' when event_id % 19 = 0 then ' ' when event_id % 23 = 0 then null"
        " else concat('{\"trans_num\": \"', cast(event_id as string), '\", \"amt\": \"', cast(user_id as string), '\"}') end as value",
    )


def with_score(df: DataFrame) -> DataFrame:
    """A fixed score in place of a model."""
    return df.withColumn("score", F.col("amt") / F.lit(500.0))
