"""E: event-log shaping."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.columns import UNKNOWN, micros, monday_dow, rounded
from ..operators import shape, stats
from .base import (chat_log, item_log, lifecycle_log, orders_log, part, query, simple_log,
                   table)

CASE = 'partition by case_id order by "timestamp", event_order'
part("simple_next", f"""select *, lead(activity) over ({CASE}) as next_activity,
    row_number() over (partition by case_id, activity order by "timestamp", event_order)
    as visit from {{simple}}""")


@query("E1_event_order", """select case_id, o_orderkey, row_number() over (partition by case_id
    order by "timestamp", event_order) - 1 as event_order
    from (select *, event_order as o_orderkey from {olog})""")
def e1(spark, d):
    log = orders_log(spark, d).withColumn("o_orderkey", F.col("event_order"))
    return shape.number_events(log).select("case_id", "o_orderkey", "event_order")


@query("E2_one_per_occurrence", """select activity, lifecycle, count(*) as n,
    sum(event_order) as check_sum from (select event_order, activity, case when activity like '%3'
    and lifecycle = 'complete' then 'withdraw' else lifecycle end as lifecycle from {lc})
    as x where lifecycle = 'complete' or (lifecycle = 'start' and activity not in
    (select activity from {lc} where lifecycle = 'complete' and activity not like '%3'))
    group by all""".replace("sum(event_order) as check_sum", "cast(sum(event_order) as bigint) as check_sum"))
def e2(spark, d):
    log = lifecycle_log(spark, d)     # one activity is made to never complete
    log = log.withColumn("lifecycle", F.when(
        F.col("activity").endswith("3") & (F.col("lifecycle") == "complete"), "withdraw")
        .otherwise(F.col("lifecycle")))
    return shape.one_per_occurrence(log).groupBy("activity", "lifecycle").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_order").alias("check_sum"))


@query("E3_completed_only", """select activity, count(*) as n from {lc}
    where lifecycle = 'complete' group by 1""")
def e3(spark, d):
    return shape.completed_only(lifecycle_log(spark, d)).groupBy("activity").agg(
        F.count(F.lit(1)).alias("n"))


@query("E4_event_class", """select case when activity like 'W\\_%' escape '\\' then 'W'
    when activity like 'A\\_%' escape '\\' or activity like 'O\\_%' escape '\\' then 'AO'
    else 'other' end as class, count(*) as n from
    (select activity from {lc} union all select activity from {simple}) group by 1""")
def e4(spark, d):
    both = lifecycle_log(spark, d).select("activity").unionByName(
        simple_log(spark, d).select("activity"))
    return both.groupBy(shape.event_class().alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("E5_prefix_filter", """select activity, count(*) as n from {lc}
    where activity[1:2] in ('W_', 'O_') group by 1""")
def e5(spark, d):
    return shape.with_prefixes(lifecycle_log(spark, d), ["W_", "O_"]).groupBy("activity").agg(
        F.count(F.lit(1)).alias("n"))


@query("E6_next_activity", """select case_id, event_order, activity, next_activity
    from {simple_next} where next_activity is not null""")
def e6(spark, d):
    return shape.next_activity(simple_log(spark, d)).select(
        "case_id", "event_order", "activity", "next_activity")


@query("E7_previous_activity", f"""select case_id, event_order, coalesce(lag(activity)
    over ({CASE}), '__START__') as previous_activity from {{simple}}""")
def e7(spark, d):
    return shape.previous_activity(simple_log(spark, d)).select(
        "case_id", "event_order", "previous_activity")


@query("E8_visit_bucket", """select case_id, event_order, visit, case when visit < 3 then
    cast(visit as varchar) else '3+' end as visit_bucket from {simple_next}""")
def e8(spark, d):
    return shape.visit_numbers(simple_log(spark, d)).select(
        "case_id", "event_order", "visit", "visit_bucket")


part("shipdays", """select resource, count(distinct "date") as active_days from {ships}
    group by 1""")
part("shipspan", """select count(*) as n, count(*) filter (isodow(x) <= 5) as w from (select
    unnest(generate_series(min("date"), max("date"), interval 1 day)) as x from {ships})""")
part("roles", """select resource, active_days, active_days / n as coverage,
    case when active_days / n > w / n then 'system' else 'human' end as role
    from {shipdays}, {shipspan}""")


@query("E9_human_or_system", """select resource, active_days, round(coverage, 6) as coverage,
    role from {roles}""")
def e9(spark, d):
    from .base import ship_log
    return rounded(shape.resource_coverage(ship_log(spark, d)))


@query("E10_human_work", """select resource, count(*) as n from
    (select cast(user_id as varchar) as resource, cast(ts as date) as "date", event_type from events)
    where event_type = 'click' and resource in (select r from (select cast(user_id as varchar) as r,
    count(distinct cast(ts as date)) as a from events group by 1) where a / (select
    date_diff('day', min(cast(ts as date)), max(cast(ts as date))) + 1 from events) <=
    (select count(*) filter (isodow(x) <= 5) / count(*) from (select unnest(generate_series(
    min(cast(ts as date)), max(cast(ts as date)), interval 1 day)) as x from events)))
    group by 1""")
def e10(spark, d):
    ev = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("resource"), F.to_date("ts").alias("date"),
        F.col("event_type").alias("event_origin"))
    return shape.human_work(ev, origin="click").groupBy("resource").agg(
        F.count(F.lit(1)).alias("n"))


@query("E11_traces", """select case_id, string_agg(activity, ' → ' order by event_order) as trace
    from {chat} group by 1""")
def e11(spark, d):
    return shape.traces(chat_log(spark, d)).select(
        "case_id", F.array_join("trace", " → ").alias("trace"))


@query("E12_restrict_to_cases", """select activity, count(*) as n from {simple} where case_id in
    (select case_id from {simple} where activity = 'error' and value > 20) group by 1""")
def e12(spark, d):
    log = simple_log(spark, d)
    ids = log.filter("activity = 'error' and value > 20").select("case_id").distinct()
    return shape.restrict_to_cases(log, ids).groupBy("activity").agg(
        F.count(F.lit(1)).alias("n"))


WARM_START, WARM_END = datetime(1995, 1, 1), datetime(1999, 1, 1)
part("ofirst", """select case_id, min("timestamp") as arrival from {olog} group by 1""")


@query("E13_after_warmup", """select activity, count(*) as n, count(distinct case_id) as cases
    from {olog} where case_id in (select case_id from {ofirst}
    where arrival >= timestamp '1995-01-01' + interval 120 day) group by 1""")
def e13(spark, d):
    log = orders_log(spark, d)
    kept = shape.after_warmup(log, stats.case_arrivals(log), WARM_START, WARM_END, 120)
    return kept.groupBy("activity").agg(F.count(F.lit(1)).alias("n"),
                                        F.countDistinct("case_id").alias("cases"))


@query("E13_clip_intervals", """select resource, count(*) as n, round(sum(date_diff('microsecond',
    greatest(a, timestamp '2024-01-10'), least(b, timestamp '2024-01-20')) / 1e6), 3) as seconds
    from (select case_id as resource, min("timestamp") as a, max("timestamp") as b from {simple}
    group by case_id, cast("timestamp" as date)) where least(b, timestamp '2024-01-20')
    > greatest(a, timestamp '2024-01-10') group by 1""")
def e13b(spark, d):
    from ..functions.columns import seconds_between
    log = simple_log(spark, d)
    spans = log.groupBy(F.col("case_id").alias("resource"), F.to_date("timestamp").alias("day")) \
        .agg(F.min("timestamp").alias("avail_start"), F.max("timestamp").alias("avail_end"))
    c = shape.clip_intervals(spans, datetime(2024, 1, 10), datetime(2024, 1, 20))
    return rounded(c.groupBy("resource").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(seconds_between("avail_start", "avail_end")).alias("seconds")), 3)


@query("E14_usable_durations", """select count(*) as n, round(sum(v), 2) as total
    from (select cast(date_diff('day', o_orderdate, l_shipdate) as double) as v from lineitem
    join orders on l_orderkey = o_orderkey) where v > 0""")
def e14(spark, d):
    j = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(
        table(spark, d, "orders").select("o_orderkey", "o_orderdate"),
        F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.select(F.date_diff("l_shipdate", "o_orderdate").cast("double").alias("v"))
    return rounded(shape.usable_durations(j, "v").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), 2)


@query("E15_label_encoding", """with dict as (select label, row_number() over (order by label) - 1
    as code from (select distinct activity as label from {simple} where activity <> 'error'
    union select '__UNKNOWN__'))
    select activity, coalesce(code, (select code from dict where label = '__UNKNOWN__'))
    as code, count(*) as n from {simple} left join dict on activity = label group by 1, 2""")
def e15(spark, d):
    log = simple_log(spark, d)
    words = shape.label_dictionary(log.filter("activity <> 'error'"), "activity", [UNKNOWN])
    return shape.encode(log, "activity", words, UNKNOWN, "code").groupBy(
        "activity", "code").agg(F.count(F.lit(1)).alias("n"))


@query("E16_first_of_case", f"""select case_id, activity, event_order, requested_amount from
    (select *, row_number() over ({CASE}) as r from {{olog}}) where r = 1""")
def e16(spark, d):
    return shape.first_of_case(orders_log(spark, d)).select(
        "case_id", "activity", "event_order", "requested_amount")
