"""DuckDB SQL giving the same rows as each registered query."""

from __future__ import annotations

RAW = """raw as (
  select cast(event_id as varchar) trans_num,
         strftime(ts, '%Y-%m-%d %H:%M:%S') trans_date_trans_time,
         cast(user_id as varchar) cc_num,
         concat('fraud_Shop ', cast(event_id % 40 as varchar)) merchant,
         event_type category, cast(value as varchar) amt,
         split_part(c_name, '#', 1) "first", split_part(c_name, '#', 2) "last",
         c_mktsegment gender, cast(10000 + c_nationkey as varchar) zip,
         cast(cast(30.0 + c_nationkey * 0.5 as double) as varchar) lat,
         cast(cast(-100.0 + user_id % 40 as double) as varchar) "long",
         cast(1000 + user_id * 37 as varchar) city_pop,
         strftime(date '1950-01-01' + cast(user_id * 97 % 18000 as int), '%Y-%m-%d') dob,
         cast(cast(30.0 + event_id % 20 * 0.5 as double) as varchar) merch_lat,
         cast(cast(-100.0 + event_id % 30 as double) as varchar) merch_long,
         case when event_type = 'error' and value > 100 then '1' else '0' end is_fraud
  from events join customer on c_custkey = user_id)"""

TYPED = """typed as (
  select trans_num, cc_num, category, gender,
         try_cast(amt as double) amt, try_cast(zip as int) zip, try_cast(lat as double) lat,
         try_cast("long" as double) "long", try_cast(city_pop as int) city_pop,
         try_cast(merch_lat as double) merch_lat, try_cast(merch_long as double) merch_long,
         cast(date_part('year', t) - date_part('year', b) as int) age,
         cast(date_part('hour', t) as int) "hour", cast(date_part('day', t) as int) "day",
         cast(date_part('month', t) as int) "month", try_cast(is_fraud as int) is_fraud
  from (select *, strptime(trans_date_trans_time, '%Y-%m-%d %H:%M:%S') t,
               strptime(dob, '%Y-%m-%d') b from raw))"""

DICTIONARIES = """
  cats as (select category, row_number() over (order by category) - 1 cat_id
           from (select distinct category from raw)),
  genders as (select gender, row_number() over (order by gender) - 1 gender_id
              from (select distinct gender from raw))"""

ENCODED = f"""{RAW}, {TYPED}, {DICTIONARIES},
  encoded as (select * exclude (category, gender)
              from typed join cats using (category) join genders using (gender))"""

EMAIL = """concat(lower(c_mktsegment), '@',
  case when c_custkey % 11 = 0 then 'nodot' else 'mail.example' end)"""

RULES = f"""rules as (
  select c_custkey cc_num, c_acctbal ACCT_AVL_CASH_BEFORE_AMT,
         cast(50.0 * (c_custkey % 10) as double) ACCT_CL_AMT, avgv AVG_DLY_AUTHZN_AMT
  from customer left join (
    select user_id, cast(sum(cast(value as decimal(18, 2))) as double) / 30 avgv
    from events group by user_id) on user_id = c_custkey
  where c_custkey % 7 <> 0)"""

LIMITS = f"""{RAW}, {RULES},
  limits as (
    select trans_num, cast(raw.cc_num as bigint) cc_num, cast(amt as double) amt,
           cast(amt as double) / 500 score,
           ACCT_AVL_CASH_BEFORE_AMT, ACCT_CL_AMT, AVG_DLY_AUTHZN_AMT
    from raw left join rules on rules.cc_num = cast(raw.cc_num as bigint)),
  cascade as (
    select *, case when amt > ACCT_AVL_CASH_BEFORE_AMT then 'cash'
                   when amt > ACCT_CL_AMT then 'credit' end first_rule,
           cast(coalesce(amt > ACCT_AVL_CASH_BEFORE_AMT, false)
                or coalesce(amt > ACCT_CL_AMT, false) as int) "case"
    from limits)"""

SCORED = f"""{RAW}, scored as (
  select trans_num, cast(amt as double) / 500 score, cast(is_fraud as int) is_fraud from raw)"""

ACCOUNTS = f"""accounts as (
  select cast(c_custkey as varchar) cc_num, split_part(c_name, '#', 1) "first",
         split_part(c_name, '#', 2) "last",
         case when c_custkey % 13 = 0 then '' when c_custkey % 17 = 0 then null
              else {EMAIL} end email
  from customer)"""

MERCHANTS = """merchants as (
  select concat(case when s_suppkey % 7 = 0 then 'fraud_fraud_' when s_suppkey % 5 = 0 then ''
                     else 'fraud_' end, 'Shop ', cast(s_suppkey % 40 as varchar)) merchant,
         s_name street, cast(s_nationkey as varchar) state, 10000 + s_nationkey zip,
         cast(30.0 + s_nationkey * 0.5 as double) merch_lat
  from supplier)"""

SPEND = """
  select "first", "last", cast(sum(cast(amt as decimal(18, 4))) as double) total,
         cast(sum(cast(amt as decimal(18, 4))) as double) / count(amt) avg_txn_amt,
         count(*) ntxn, cast(sum(cast(is_fraud as int)) as bigint) ftxn"""

LATEST = f"""with {RAW}
  select cc_num, trans_date_trans_time, trans_num, amt from raw
  qualify row_number() over (
    partition by cc_num order by trans_date_trans_time desc, trans_num desc) = 1"""

WITHIN = """
  with status as (
    select cast(event_id as varchar) txn_num, ts + (event_id % 90) * interval 1 second status_ts,
           case when value > 250 then 'REJECTED' else 'AUTHORIZED' end txn_status
    from events where event_id % 5 <> 0)
  select cast(event_id as varchar) trans_num, ts, status_ts, txn_status,
         case when txn_num is null then 'Failed' end status,
         case when txn_num is null then 'timeout' end reason
  from events left join status
    on txn_num = cast(event_id as varchar)
   and status_ts between ts and ts + interval 60 second"""

RUNS = """runs as (
  select concat(name, '-', cast(cast(ts as date) as varchar)) run_id, name,
         cast(cast(ts as date) as timestamp) start_time, 100 n_estimators,
         round((sum(case when y = 1 and p = 1 then 1.0 else 0 end)::double / nullif(sum(y), 0)
              + sum(case when y = 0 and p = 0 then 1.0 else 0 end)::double / nullif(sum(1 - y), 0)) / 2, 6) auc
  from (select ts, name, cast(event_type = 'error' and value > 100 as int) y,
               cast(value / 500 > threshold as int) p
        from events join customer on c_custkey = user_id,
             (values ('strict', 0.3), ('loose', 0.2)) t(name, threshold))
  group by cast(ts as date), name)"""


def _report(threshold: float) -> str:
    return f"""with {SCORED},
  pairs as (select is_fraud y, cast(score > {threshold} as int) p, count(*) n from scored group by all),
  classes as (
    select label, sum(support)::double support, sum(predicted)::double predicted, sum(hits)::double hits
    from (select y label, n support, 0 predicted, case when y = p then n else 0 end hits from pairs
          union all select p, 0, n, 0 from pairs) group by label),
  per as (
    select label, support, hits,
           coalesce(hits / nullif(predicted, 0), 0) "precision", coalesce(hits / nullif(support, 0), 0) recall,
           coalesce(2 * hits / nullif(support + predicted, 0), 0) f1_score from classes)
  select cast(label as varchar) label, round("precision", 6) "precision", round(recall, 6) recall,
         round(f1_score, 6) f1_score, cast(support as bigint) support from per
  union all
  select 'accuracy', null, null, round(sum(hits) / sum(support), 6), cast(sum(support) as bigint) from per
  union all
  select 'macro avg', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1_score), 6),
         cast(sum(support) as bigint) from per
  union all
  select 'weighted avg', round(sum("precision" * support) / sum(support), 6),
         round(sum(recall * support) / sum(support), 6),
         round(sum(f1_score * support) / sum(support), 6), cast(sum(support) as bigint) from per"""


_FEATURES = f'with {ENCODED} select * rename (trans_num as _id) from encoded'
_STREAM_FEATURES = f"with {ENCODED} select * from encoded"
_TRAINING = f"""with {ENCODED} select is_fraud, amt, cat_id, city_pop, "day", "hour", lat, "long",
  merch_lat, merch_long, "month", zip from encoded"""
_KNOWN = f"""with {RAW},
  known as (select category, row_number() over (order by category) - 1 cat_id
            from (select distinct category from raw where is_fraud = '1'))"""
_VERDICTS = f"""with {LIMITS}
  select trans_num txn_num,
         case when greatest("case", cast(score > 0.3 as int)) = 1
              then 'REJECTED' else 'AUTHORIZED' end txn_status from cascade"""

DIRTY = """dirty as (
  select cast(event_id as varchar) trans_num, event_id, user_id, event_type category,
         case event_id % 7 when 1 then null when 2 then null when 0 then date_trunc('millisecond', ts)
              else date_trunc('second', ts) end t,
         case when event_id % 10 < 3 then null else value end amt,
         case user_id % 9 when 0 then '0' when 1 then concat('93000000000000', lpad(cast(user_id as varchar), 5, '0'))
              else concat(' 00', cast(user_id as varchar)) end cc_num,
         case user_id % 9 when 0 then '0' when 1 then concat('93000000000000', lpad(cast(user_id as varchar), 5, '0'))
              else cast(user_id as varchar) end card,
         case when user_id % 5 < 2 then null else 1981 end born,
         cast(case when event_type = 'error' and value > 100 then 1 else 0 end as int) is_fraud,
         c_nationkey
  from events join customer on c_custkey = user_id)"""

ORACLE = {
    "dirty_typed_txn": f"""with {DIRTY}
        select trans_num, cc_num, category, amt,
               cast(case event_id % 4 when 0 then null else 777 end as int) zip,
               cast(30.0 + c_nationkey * 0.5 as double) lat, cast(-100.0 + user_id % 40 as double) "long",
               cast(1000 + user_id * 37 as int) city_pop,
               cast(30.0 + event_id % 20 * 0.5 as double) merch_lat, cast(-100.0 + event_id % 30 as double) merch_long,
               cast(date_part('year', t) - born as int) age, cast(date_part('hour', t) as int) "hour",
               cast(date_part('day', t) as int) "day", cast(date_part('month', t) as int) "month", is_fraud,
               cast(cast(floor((epoch_ms(t) + 500) / 1000) as bigint) as varchar) unix_time
        from dirty""",
    "dirty_rule_cascade": f"""with {DIRTY},
        limits as (
          select case c_custkey % 9 when 0 then '0' when 1 then concat('93000000000000', lpad(cast(c_custkey as varchar), 5, '0'))
                      else cast(c_custkey as varchar) end card,
                 case when c_custkey % 6 = 0 then null else 150.0 end cash, 50.0 * (c_custkey % 10) credit
          from customer, (values (0), (1)) v(copy)
          where copy <= case when c_custkey % 8 = 0 then 1 else 0 end and (c_custkey % 9 <> 0 or copy = 1))
        select trans_num, card cc_num, first_rule, cast(first_rule is not null as int) "case",
               cast(first_rule is not null or coalesce(amt / 500 > 0.3, false) as int) prediction
        from (select trans_num, dirty.card, amt,
                     case when amt > cash then 'cash' when amt > credit then 'credit' end first_rule
              from dirty left join limits on limits.card = dirty.card)""",
    "user_spend": f"""with {RAW} {SPEND} from raw group by "first", "last" """,
    "user_spend_orders": f"""
        with paid as (
          select split_part(c_name, '#', 1) "first", split_part(c_name, '#', 2) "last",
                 o_totalprice amt, cast(o_orderstatus = 'F' as int) is_fraud
          from orders join customer on c_custkey = o_custkey)
        {SPEND} from paid group by "first", "last" """,
    "user_count": f'with {RAW} select count(*) n from (select distinct "first", "last" from raw)',
    "typed_txn": f"with {RAW}, {TYPED} select * from typed",
    "calendar_features": f"""with {RAW}
        select trans_num, t trans_date_trans_time, strftime(b, '%Y-%m-%d') dob,
               cast(date_part('hour', t) as int) "hour", cast(date_part('day', t) as int) "day",
               cast(date_part('month', t) as int) "month",
               cast(date_part('year', t) - date_part('year', b) as int) age,
               cast(cast(cc_num as bigint) as varchar) cc_num, trans_date_trans_time clock,
               cast(cast(epoch(t) as bigint) as varchar) unix_time
        from (select *, strptime(trans_date_trans_time, '%Y-%m-%d %H:%M:%S') t,
                     strptime(dob, '%Y-%m-%d') b from raw)""",
    "contact_quality": rf"""with {ACCOUNTS}
        select *, case when coalesce(email, '') = '' then 'Email can''t be empty.'
                       when not regexp_matches(email, '\S+@\S+\.\S+')
                       then 'Ooops! We need a valid email address.' else '' end email_error,
               case when trim(concat_ws(' ', "first", "last")) = ''
                    then 'Name can''t be empty.' else '' end name_error
        from accounts""",
    "account_names": f"""with {ACCOUNTS} select cc_num, "first" || ' ' || "last" full_name from accounts""",
    "merchant_names": f"""with {MERCHANTS}
        select street, merchant, regexp_replace(merchant, 'fraud_', '') display_name from merchants""",
    "distinct_categories": f"with {RAW} select distinct category from raw",
    "gender_dictionary": f"with {RAW}, {DICTIONARIES} select * from genders",
    "category_dictionary": f"with {RAW}, {DICTIONARIES} select * from cats",
    "merchant_dictionary": f"""with {MERCHANTS}
        select street, row_number() over (order by street) - 1 street_id
        from (select distinct street from merchants)""",
    "dictionary_extend": f"""{_KNOWN}
        select * from known
        union all
        select category, (select count(*) from known) - 1 + row_number() over (order by category)
        from (select distinct category from raw where category not in (select category from known))""",
    "featurized_txn": _FEATURES,
    "featurized_unseen": f"""{_KNOWN}
        select trans_num, category, coalesce(cat_id, -1) cat_id from raw left join known using (category)""",
    "feature_table": f"select * exclude (is_fraud) from ({_FEATURES})",
    "training_set": _TRAINING,
    "training_set_bucketed": _FEATURES,
    "key_violations": "select o_custkey, count(*) n from orders group by 1 having count(*) > 1 or o_custkey is null",
    "fraud_only": f"with {RAW}, {TYPED} select * from typed where is_fraud = 1",
    "fraud_preview": f"with {RAW}, {TYPED} select * from typed where is_fraud = 1 order by trans_num limit 10",
    "merchant_streets": f"""with {MERCHANTS}
        select merchant, string_agg(distinct street, '|' order by street) streets from merchants group by merchant""",
    "merchant_match": f"""with {MERCHANTS}
        select l_orderkey, l_linenumber, merchant, street, state, zip, merch_lat
        from lineitem join supplier on s_suppkey = l_suppkey join merchants on street = s_name""",
    "bounded_find": f"with {MERCHANTS} select * from merchants order by merchant, street limit 100",
    "account_by_email": f"""with {ACCOUNTS}
        select * from accounts
        where email in (select {EMAIL} from customer where c_custkey % 7 <> 0)
        qualify row_number() over (partition by email order by cc_num) = 1""",
    "account_find_one": f"""with {ACCOUNTS}
        select * from accounts where email = 'machinery@mail.example' order by cc_num limit 1""",
    "change_feed_unwrap": f"with {RAW} select * from raw where category <> 'signup'",
    "watched_changes": """
        select cast(event_id as varchar) txn_num, ts + (event_id % 90) * interval 1 second status_ts,
               case when value > 250 then 'REJECTED' else 'AUTHORIZED' end txn_status
        from events where event_id % 5 <> 0 and value > 100""",
    "message_roundtrip": f"with {RAW} select * from raw",
    "rules_attached": f"""with {LIMITS}
        select * exclude (score) replace (cast(cc_num as varchar) as cc_num) from limits""",
    "rule_cascade": f"""with {LIMITS}
        select trans_num, "case", first_rule, 'limits-1' rule_version from cascade""",
    "rule_and_vector": f"""with {LIMITS}
        select trans_num, case0, case1, case2, case0 * case1 * case2 prediction
        from (select trans_num, cast(coalesce(amt < ACCT_AVL_CASH_BEFORE_AMT, false) as int) case0,
                     cast(coalesce(amt < ACCT_CL_AMT, false) as int) case1,
                     cast(coalesce(amt > AVG_DLY_AUTHZN_AMT, false) as int) case2 from limits)""",
    "rule_or_model": f"""with {LIMITS}
        select trans_num, greatest("case", cast(score > 0.3 as int)) prediction from cascade""",
    "rule_model_review": f"""with {LIMITS}
        select trans_num, case when "case" = 0 or coalesce(amt > AVG_DLY_AUTHZN_AMT, false)
                               then cast(score > 0.3 as int) else "case" end prediction from cascade""",
    "user_rules": f"""with {LIMITS}
        select trans_num, cast(first_rule is not null as int) "case", first_rule, 'own-2' rule_version
        from (select trans_num, case when amt > 200 then 'large'
                                     when amt > 3 * AVG_DLY_AUTHZN_AMT then 'burst'
                                     when amt > ACCT_CL_AMT then 'credit' end first_rule from limits)""",
    "txn_verdict": _VERDICTS,
    "verdict_within_60s": WITHIN,
    "verdict_within_60s_keyed": WITHIN,
    "train_test_split": f"""with {RAW}
        select trans_num, case when cast(('0x' || substr(md5(trans_num), 1, 8)) as bigint) % 100 < 80
                               then 'train' else 'test' end side from raw""",
    "auc_scores": f"""with {SCORED},
        ranked as (select is_fraud, rank() over (order by score)
                          + (count(*) over (partition by score) - 1) / 2.0::double r from scored)
        select round((sum(r) filter (where is_fraud = 1) - p * (p + 1) / 2.0::double) / (p * n), 6) auc
        from ranked, (select sum(is_fraud)::double p, sum(1 - is_fraud)::double n from scored)
        group by p, n""",
    "auc_thresholded": f"""with {SCORED}
        select round((sum(case when is_fraud = 1 and score > 0.3 then 1.0 else 0 end)::double / sum(is_fraud)
                    + sum(case when is_fraud = 0 and score <= 0.3 then 1.0 else 0 end)::double
                      / sum(1 - is_fraud)) / 2, 6) auc from scored""",
    "classification_report_030": _report(0.3),
    "classification_report_050": _report(0.5),
    "promotion_gate": f"with {RUNS} select * from runs where auc > 0.91",
    "latest_run": f"""with {RUNS}
        select * from runs where name = 'loose' order by start_time desc, run_id desc limit 1""",
    "incremental_load": f"""with {RAW}
        select * from raw where not exists (
          select 1 from raw l where l.trans_date_trans_time < '2024-01-10 00:00:00'
                                and l.trans_num = raw.trans_num)""",
    "upsert_latest": LATEST,
    "merged_latest": LATEST,
    "incremental_index_load": f"with {RAW} select trans_num, cc_num, category, amt from raw",
    "messages_quarantined": """
        select case when event_id % 11 = 0 or event_id % 13 = 0 then 'unreadable' when event_id % 17 = 0 then 'no object'
                    when event_id % 19 = 0 or event_id % 23 = 0 then 'empty' else 'good' end side,
               cast(event_id as varchar) "key",
               case when event_id % 11 = 0 then concat('{"trans_num": "', cast(event_id as varchar), '", "am') when event_id % 13 = 0 then '{bad'
                    when event_id % 17 = 0 then '[1, 2]' when event_id % 19 = 0 then ' ' when event_id % 23 = 0 then null
                    else cast(user_id as varchar) end "content"
        from events""",
    "auc_of_days": """
        with binned as (
          select least(cast(floor(greatest(0.0, least(1.0, value / 500)) * 4096) as int), 4095) bin,
                 sum(case when event_type = 'error' and value > 100 then 1 else 0 end)::double pos,
                 sum(case when event_type = 'error' and value > 100 then 0 else 1 end)::double neg
          from events where value is not null group by 1),
        ranked as (
          select *, coalesce(sum(neg) over (order by bin rows between unbounded preceding and 1 preceding), 0) below from binned)
        select round(sum(pos * below + pos * neg / 2) / (sum(pos) * sum(neg)), 6) auc,
               round(sum(pos * neg / 2) / (sum(pos) * sum(neg)), 6) error
        from ranked""",
    "rules_in_force": """
        with txn as (
          select cast(event_id as varchar) trans_num, cast(user_id as varchar) cc_num, value amt, ts,
                 case when c_custkey % 7 = 0 then null
                      when c_custkey % 3 = 0 and ts >= timestamp '2024-01-10 12:00:00' then c_acctbal / 2 else c_acctbal end cash,
                 case when c_custkey % 7 <> 0 then 50.0 * (c_custkey % 10) end credit
          from events join customer on c_custkey = user_id),
        judged as (
          select *, case when ts < timestamp '2024-01-05' then null when ts < timestamp '2024-01-20' then 'limits-1' else 'limits-2' end rule_version,
                 case when ts < timestamp '2024-01-05' then null when ts >= timestamp '2024-01-20' and amt > 200 then 'large'
                      when amt > cash then 'cash' when amt > credit then 'credit' end first_rule
          from txn)
        select trans_num, cc_num, cash ACCT_AVL_CASH_BEFORE_AMT, first_rule, cast(first_rule is not null as int) "case", rule_version from judged""",
    "verdict_replayed": _VERDICTS,
    "change_feed_applied": """
        with feed as (
          select cast(user_id as varchar) || '-' || cast(event_id % 7 as varchar) "key", event_id "at", event_id % 10 kind,
                 event_id % 4 part, event_type category, value amt
          from events),
        begun as (select "key", max("at") "at" from feed where kind < 3 group by "key"),
        alive as (select "key", "at" from begun join feed using ("key", "at") where kind <> 0)
        select "key", arg_max({'v': f.category}, f."at") filter (where f.kind < 3 or f.part < 2).v category,
               arg_max({'v': f.amt}, f."at") filter (where f.kind < 3 or f.part > 0).v amt
        from alive join feed f using ("key") where f."at" >= alive."at" group by "key" """,
    "dictionary_queries_at_once": f"with {RAW} select trans_num, category, true is_dense from raw",
    "user_spend_stream": f"""with {RAW} {SPEND} from raw group by "first", "last" """,
    "verdict_first_stream": """
        with status as (
          select event_id, ts + (event_id % 90) * interval 1 second status_ts,
                 case when value > 250 then 'REJECTED' else 'AUTHORIZED' end txn_status
          from events where event_id % 5 <> 0),
        every_status as (
          select * from status
          union all select event_id, status_ts + interval 5 second, 'AGAIN' from status
          union all select event_id, ts + (event_id % 90) * interval 500 millisecond, 'EARLY' from events
                    where event_id % 5 <> 0 and event_id % 3 = 0)
        select cast(e.event_id as varchar) trans_num, ts, status_ts, txn_status,
               case when s.event_id is null then 'Failed' end status,
               case when s.event_id is null then 'timeout' end reason
        from events e left join every_status s
          on s.event_id = e.event_id and status_ts between ts and ts + interval 60 second
        qualify row_number() over (partition by e.event_id order by status_ts, txn_status) = 1""",
    "featurized_stream": _STREAM_FEATURES,
    "stream_dictionary_refresh": f"with {RAW} select trans_num, category, gender from raw",
    "upsert_stream_latest": LATEST,
    "continuous_copy": f"""with {RAW}
        select cc_num, trans_num, trans_date_trans_time, category, amt from raw
        qualify row_number() over (
          partition by cc_num order by trans_date_trans_time desc, trans_num desc) = 1""",
    "dictionary_two_queries": f"""with {RAW}
        select trans_num, category, cast(1 as bigint) values_of_id, cast(1 as bigint) ids_of_value from raw""",
    "verdict_changed": _VERDICTS,
    "watched_changes_stream": """
        select cast(event_id as varchar) txn_num, ts + (event_id % 90) * interval 1 second status_ts,
               case when value > 250 then 'REJECTED' else 'AUTHORIZED' end txn_status
        from events where event_id % 5 <> 0 and value > 100""",
    "gbt_reload_check": f"""with {RAW}
        select trans_num _id, true is_equal from raw
        where cast(('0x' || substr(md5(trans_num), 1, 8)) as bigint) % 100 >= 80""",
    "logged_runs": f"""with {RUNS}
        select run_id, name, n_estimators, auc, auc auc_thresholded from runs where auc is not null""",
    "promoted_model_used": f"with {RAW} select trans_num _id, true is_equal from raw",
    "incremental_files": f"with {RAW} select trans_num, category, amt from raw",
    "stream_verdicts": _VERDICTS,
    "verdict_within_60s_stream": WITHIN,
    "gbt_stream_matches_batch": f"""with {RAW}
        select trans_num, true is_probability, true is_equal from raw""",
    "custom_model_scores": f"""with {RAW}, {TYPED}
        select trans_num _id, round(1 / (1 + exp(-(amt / 100 - 1 + "hour" / 48))), 6) prediction from typed""",
}
