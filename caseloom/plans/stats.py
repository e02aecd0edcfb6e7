"""A: log statistics."""

from pyspark.sql import functions as F

from ..functions.columns import LOCAL_ZONE, micros, rounded
from ..operators import shape, stats
from .base import (chat_log, item_log, lifecycle_log, orders_log, part, query, secs,
                   simple_log, table)
from . import shape as _shape  # noqa: F401  shared CTEs

CASE = 'partition by case_id order by "timestamp", event_order'


@query("A1_basic_stats", """with c as (select case_id, count(*) as l,
    date_diff('microsecond', min("timestamp"), max("timestamp")) / 1e6 as s from {simple} group by 1)
    select count(*) as n_cases, cast(sum(l) as bigint) as n_events,
    round(avg(l), 4) as length_mean, round(stddev_samp(l), 4) as length_std,
    cast(min(l) as double) as length_min, cast(max(l) as double) as length_max,
    round(avg(s), 3) as duration_s_mean, round(stddev_samp(s), 3) as duration_s_std,
    round(min(s), 4) as duration_s_min, round(max(s), 4) as duration_s_max,
    (select count(distinct activity) from {simple}) as n_activities from c""")
def a1(spark, d):
    return rounded(stats.basic_stats(simple_log(spark, d)), 4,
                   duration_s_mean=3, duration_s_std=3)


@query("A2_activity_counts", "select activity, count(*) as n from {lc} group by 1")
def a2(spark, d):
    return stats.activity_counts(lifecycle_log(spark, d))


part("firsts", """select case_id, min("timestamp") as arrival from {simple} group by 1""")
# purchases give many arrivals: one per (user, day)
part("sub", """select case_id || '-' || cast(cast("timestamp" as date) as varchar) as case_id,
    activity, "timestamp", event_order, resource from {simple}""")
part("subfirst", """select case_id, min("timestamp") as arrival from {sub} group by 1""")
part("gaps", """select date_diff('microsecond', p, arrival) / 1e6 as gap_s from
    (select arrival, lag(arrival) over (order by arrival) as p from {subfirst})
    where p is not null and arrival > p""")


def day_cases(spark, d):
    """events with one case per user and day: many cases, many arrivals."""
    return simple_log(spark, d).withColumn("case_id", F.concat_ws(
        "-", "case_id", F.to_date("timestamp").cast("string")))


@query("A3_arrival_rate", """select count(*) as n_gaps, round(avg(gap_s), 4) as mean_s,
    round(stddev_pop(gap_s), 4) as std_s, round(86400 / avg(gap_s), 4) as arrivals_per_day
    from {gaps}""")
def a3(spark, d):
    return rounded(stats.arrival_rate(stats.case_arrivals(day_cases(spark, d))), 4)


@query("A4_daily_arrivals", """select round(avg(n), 6) as mean, round(stddev_samp(n), 6) as std,
    min(n) as "min", max(n) as "max" from (select cast(arrival as date), count(*) as n
    from (select min("timestamp") as arrival from {olog} group by case_id) group by 1)""")
def a4(spark, d):
    return rounded(stats.daily_arrival_stats(stats.case_arrivals(orders_log(spark, d))))


part("profile", """select p.profile, p.slot, count(f.case_id) as n, count(f.case_id) /
    sum(count(f.case_id)) over (partition by p.profile) as share from
    (select 'hod' as profile, cast(unnest(range(24)) as int) as slot union all
     select 'dow', cast(unnest(range(7)) as int)) p left join {subfirst} f
    on (p.profile = 'hod' and hour(arrival) = slot)
    or (p.profile = 'dow' and isodow(arrival) - 1 = slot) group by 1, 2""")


@query("A5_arrival_profile", "select profile, slot, n, round(share, 6) as share from {profile}")
def a5(spark, d):
    return rounded(stats.arrival_profile(stats.case_arrivals(day_cases(spark, d))))


part("chatv", """select trace, count(*) as frequency, min(case_id) as example_case from
    (select case_id, string_agg(activity, ' → ' order by event_order) as trace from {chat}
    group by 1) group by 1""")


@query("A6_variants", """select cast(row_number() over (order by frequency desc, example_case)
    as int) as rank, frequency, round(frequency * 100.0 / (select sum(frequency) from {chatv}), 6)
    as pct, trace, (select count(*) from {chatv}) as total_variants from {chatv}
    order by frequency desc, example_case limit 20""")
def a6(spark, d):
    return rounded(stats.variants(chat_log(spark, d)))


part("branch", """select activity, next_activity, count(*) as n, count(*) / sum(count(*)) over
    (partition by activity) as p from {simple_next} where next_activity is not null group by 1, 2""")
part("branchv", """select activity, visit_bucket, next_activity, n, p from (select activity,
    visit_bucket, next_activity, count(*) as n, sum(count(*)) over (partition by activity,
    visit_bucket) as t, count(*) / sum(count(*)) over (partition by activity, visit_bucket) as p
    from (select *, case when visit < 3 then cast(visit as varchar) else '3+' end as visit_bucket
    from {simple_next}) where next_activity is not null group by 1, 2, 3) where t >= 30""")


@query("A7_branching", "select activity, next_activity, n, round(p, 6) as p from {branch}")
def a7(spark, d):
    return rounded(stats.branching(simple_log(spark, d)))


@query("A8_branching_by_visit", """select activity, visit_bucket, next_activity, n,
    round(p, 6) as p from {branchv}""")
def a8(spark, d):
    return rounded(stats.branching_by_visit(simple_log(spark, d)))


@query("A9_predict_next", """with g as (select activity, next_activity, p from {branch} qualify
    row_number() over (partition by activity order by p desc, next_activity) = 1),
    v as (select activity, visit_bucket, next_activity, p from {branchv} qualify row_number() over
    (partition by activity, visit_bucket order by p desc, next_activity) = 1)
    select s.activity, s.visit, case when s.activity <> 'signup' then
    coalesce(v.next_activity, g.next_activity) end as predicted, round(case when s.activity <>
    'signup' then coalesce(v.p, g.p) end, 6) as probability, count(*) as n
    from {simple_next} s left join g on g.activity = s.activity left join v on
    v.activity = s.activity and v.visit_bucket = case when s.visit < 3 then
    cast(s.visit as varchar) else '3+' end group by all""")
def a9(spark, d):
    log = simple_log(spark, d)
    out = stats.predict_next(shape.visit_numbers(log), stats.branching_by_visit(log),
                             stats.branching(log), terminal=["signup"])
    return rounded(out.groupBy("activity", "visit", "predicted", "probability").agg(
        F.count(F.lit(1)).alias("n")))


@query("A10_directly_follows", f"""select 'edge' as kind, activity as source, next_activity as target,
    count(*) as n from {{simple_next}} where next_activity is not null group by all
    union all select 'end', activity, null, count(*) from {{simple_next}}
    where next_activity is null group by all
    union all select 'start', null, activity, count(*) from (select *, row_number() over
    ({CASE}) as r from {{simple}}) where r = 1 group by all""")
def a10(spark, d):
    return stats.directly_follows(simple_log(spark, d))


@query("A11_legal_candidates", """with adj as (select activity, next_activity from {branch}
    where p >= 0.2 and activity <> 'view'), k as (select b.*, row_number() over (partition by
    b.activity order by p desc, b.next_activity) as r, a.activity as ok from {branch} b left join
    adj a on a.activity = b.activity and a.next_activity = b.next_activity)
    select activity, next_activity, n, round(p / sum(p) over (partition by activity), 6) as p
    from k where ok is not null or r = 1 or activity not in (select activity from adj)""")
def a11(spark, d):
    b = stats.branching(simple_log(spark, d))
    adjacency = b.filter("p >= 0.2 and activity <> 'view'").select("activity", "next_activity")
    return rounded(stats.legal_candidates(b, adjacency))


part("ocase", f"""select * from (select *, row_number() over ({CASE}) as r from {{olog}})
    where r = 1""")


@query("A12_category_shares", """select null as application_type, application_type as value,
    count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from {ocase} group by 2
    union all select application_type, loan_goal, count(*), round(count(*) / sum(count(*)) over
    (partition by application_type), 6) from {ocase} group by 1, 2""")
def a12(spark, d):
    log = orders_log(spark, d)
    a = stats.category_shares(log, "application_type").select(
        F.lit(None).cast("string").alias("application_type"),
        F.col("application_type").alias("value"), "n", "share")
    b = stats.category_shares(log, "loan_goal", "application_type").withColumnRenamed(
        "loan_goal", "value")
    return rounded(a.unionByName(b))


@query("A14_resource_profile", """with c as (select resource, count(*) as n_events,
    string_agg(distinct activity, ',' order by activity) as activities from {lc} group by 1)
    select resource, n_events, activities, row_number() over (order by n_events desc, resource)
    <= 5 as in_top from c""")
def a14(spark, d):
    p = stats.resource_profile(lifecycle_log(spark, d), top=5)
    return p.withColumn("activities", F.array_join("activities", ","))


@query("A15_time_range", """select epoch_us(min("timestamp")) as start_us,
    epoch_us(max("timestamp")) as end_us, round(date_diff('microsecond', min("timestamp"),
    max("timestamp")) / 1e6 / 86400, 6) as span_days from {simple}""")
def a15(spark, d):
    r = stats.time_range(simple_log(spark, d))
    return rounded(r.select(micros("start").alias("start_us"), micros("end").alias("end_us"),
                            "span_days"))


@query("A16_arrival_features", """with a as (select distinct arrival, timezone('Europe/Amsterdam',
    timezone('UTC', arrival)) as l from {subfirst}), g as (select arrival, lag(arrival) over
    (order by arrival) as p, lag(l) over (order by arrival) as c from a)
    select epoch_us(arrival) as arrival_us,
    round(sin(2 * pi() * (hour(c) + minute(c) / 60.0) / 24), 6) as hod_sin,
    round(cos(2 * pi() * (hour(c) + minute(c) / 60.0) / 24), 6) as hod_cos,
    round(sin(2 * pi() * (isodow(c) - 1) / 7), 6) as dow_sin,
    round(cos(2 * pi() * (isodow(c) - 1) / 7), 6) as dow_cos,
    round(sin(2 * pi() * dayofyear(c) / 365), 6) as doy_sin,
    round(cos(2 * pi() * dayofyear(c) / 365), 6) as doy_cos,
    case when isodow(c) > 5 then 1.0::double else 0.0::double end as weekend,
    round(ln(date_diff('microsecond', p, arrival) / 6e7), 6) as log_gap_min
    from g where p is not null""".replace("round(sin(", "0.0 + round(sin(")
       .replace("round(cos(", "0.0 + round(cos("))
def a16(spark, d):
    f = stats.arrival_features(stats.case_arrivals(day_cases(spark, d)))
    return rounded(f.withColumn("arrival_us", micros("arrival")).drop("arrival"))


@query("A17_open_cases", """with c as (select min("timestamp") as a, max("timestamp") as b
    from {olog} group by case_id) select day, (select count(*) from c where a < timestamp
    '1992-01-01' + to_days(cast(day as int) + 1)) - (select count(*) from c where b < timestamp '1992-01-01'
    + to_days(cast(day as int) + 1)) as open_cases from (select unnest(range(2600)) as day)""")
def a17(spark, d):
    c = stats.case_spans(orders_log(spark, d))
    return stats.open_cases_per_day(c.select(F.col("first").alias("arrival")),
                                    c.select(F.col("last").alias("completion")),
                                    "1992-01-01 00:00:00", 2600)


@query("A18_back_to_back", """select count(*) as pairs from (select *, lag(resource) over
    (order by "timestamp", event_order) as r, lag(activity) over (order by "timestamp",
    event_order) as a from {lc}) where lifecycle = 'complete' and r = resource and a = activity""")
def a18(spark, d):
    return stats.back_to_back(lifecycle_log(spark, d))


part("spans", f"""select case_id, {secs('min("timestamp")', 'max("timestamp")')} as duration_s
    from {{sub}} group by 1""")


@query("A19_mean_span", "select round(avg(duration_s / 3600), 6) as mean_hours from {spans}")
def a19(spark, d):
    return rounded(stats.mean_span_hours(day_cases(spark, d)))


@query("A20_duration_bands", """select band, count(*) as n, round(median(duration_s), 4) as median,
    round(avg(duration_s), 4) as mean, round(max(duration_s), 4) as "max" from (select *,
    case when duration_s > 0 and duration_s <= 3600 then '(0, 3600]'
    when duration_s > 3600 and duration_s <= 21600 then '(3600, 21600]'
    when duration_s > 21600 and duration_s <= 86400 then '(21600, 86400]' end as band from {spans})
    where band is not null group by 1""")
def a20(spark, d):
    return rounded(stats.bands(stats.case_spans(day_cases(spark, d)), "duration_s",
                               [0, 3600, 21600, 86400]), 4)


@query("A21_branch_weights", """with x as (select *, case when activity in ('click', 'view') then
    'browse' else 'act' end as dp_key from {simple_next}), dv as (select *, row_number() over
    (partition by case_id, dp_key order by "timestamp", event_order) as dp_visit from x),
    dd as (select *, case when dp_visit < 5 then cast(dp_visit as varchar) else '5+' end as bucket
    from dv where next_activity is not null),
    dc as (select dp_key, bucket, next_activity as label, count(*) as n from dd group by all
    union all select dp_key, 'all', next_activity, count(*) from dd group by all),
    dt as (select *, n / sum(n) over (partition by dp_key, bucket) as p from dc
    where label <> 'purchase' and not (dp_key = 'act' and bucket in ('1', 'all'))),
    o as (select event_order as row, dp_key, case when dp_visit < 5 then cast(dp_visit as varchar)
    else '5+' end as b, activity, case when visit < 3 then cast(visit as varchar) else '3+' end as v,
    unnest(['click', 'view', 'purchase']) as label from dv),
    j as (select o.*, dt.p as p1, da.p as p2, bv.p as p3, bg.p as p4,
    exists (select 1 from dt t where t.dp_key = o.dp_key and t.bucket = o.b) as h1,
    exists (select 1 from dt t where t.dp_key = o.dp_key and t.bucket = 'all') as h2,
    exists (select 1 from {branchv} t where t.activity = o.activity and t.visit_bucket = o.v) as h3
    from o left join dt on dt.dp_key = o.dp_key and dt.bucket = o.b and dt.label = o.label
    left join dt da on da.dp_key = o.dp_key and da.bucket = 'all' and da.label = o.label
    left join {branchv} bv on bv.activity = o.activity and bv.visit_bucket = o.v and
    bv.next_activity = o.label left join {branch} bg on bg.activity = o.activity and
    bg.next_activity = o.label), w as (select *, case when h1 then 'decision' when h2 then
    'decision_all' when h3 then 'visit' else 'global' end as source, coalesce(case when h1 then p1
    when h2 then p2 when h3 then p3 else p4 end, 0.01) as w from j), n as (select *, w / sum(w) over
    (partition by row) as p from w)
    select source, label, count(*) as n, round(avg(p), 6) as p from n group by 1, 2""")
def a21(spark, d):
    from ..functions.ordered import along, nth
    log = shape.visit_numbers(shape.next_activity(simple_log(spark, d), keep_last=True))
    log = log.withColumn("dp_key", F.when(F.col("activity").isin("click", "view"), "browse")
                         .otherwise("act"))
    log = along(log, ["case_id", "dp_key"], shape.ORDER, {"dp_visit": nth()}) \
        .withColumn("dp_visit", F.col("dp_visit") + 1)
    seen = log.filter("next_activity is not null").select(
        "dp_key", F.explode(F.array(shape.bucket("dp_visit", 5), F.lit("all"))).alias("bucket"),
        F.col("next_activity").alias("label"))
    counts = seen.groupBy("dp_key", "bucket", "label").agg(F.count(F.lit(1)).alias("n")).filter(
        "label <> 'purchase' and not (dp_key = 'act' and bucket in ('1', 'all'))")
    from pyspark.sql import Window
    table_ = counts.withColumn("p", F.col("n") / F.sum("n").over(
        Window.partitionBy("dp_key", "bucket")))
    options = log.select(F.col("event_order").alias("row"), "dp_key", "dp_visit", "activity", "visit",
                         F.explode(F.array(*[F.lit(x) for x in ("click", "view", "purchase")]))
                         .alias("label"))
    plain = simple_log(spark, d)
    out = stats.branch_weights(options, table_, stats.branching_by_visit(plain),
                               stats.branching(plain))
    return rounded(out.groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("p")))


@query("A22_arrivals_in_horizon", """select cast(cast(arrival as date) as varchar) as "date",
    count(*) as n from (select timezone('Europe/Amsterdam', timezone('UTC', arrival)) as arrival
    from {subfirst}) where arrival >= timestamp '2024-01-05' and arrival < timestamp '2024-01-15'
    group by 1""")
def a22(spark, d):
    a = stats.arrivals_in_horizon(day_cases(spark, d), "2024-01-05 00:00:00", 10, LOCAL_ZONE)
    return a.groupBy(F.to_date("arrival").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("n"))
