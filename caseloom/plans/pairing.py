"""J: joins and pairing."""

from pyspark.sql import functions as F

from ..functions.columns import micros, rounded
from ..operators import pairing
from .base import item_log, lifecycle_log, part, query, secs, simple_log

CA = 'partition by case_id, activity order by "timestamp", event_order'
CASE = 'partition by case_id order by "timestamp", event_order'


def ranked(log, opens):
    return f"""select s.case_id, s.activity, s.seq, s."timestamp" as start,
    c."timestamp" as complete, s.event_order, s.resource as start_resource,
    c.resource as complete_resource, {secs('s."timestamp"', 'c."timestamp"')} as duration_s from
    (select *, row_number() over ({CA}) - 1 as seq from {log} where lifecycle in ({opens})) s join
    (select *, row_number() over ({CA}) - 1 as seq from {log} where lifecycle = 'complete') c
    on s.case_id = c.case_id and s.activity = c.activity and s.seq = c.seq"""


part("pairs", ranked("{lc}", "'start', 'assign'"))


@query("J1_pair_by_rank", """select case_id, activity, seq, round(duration_s, 6) as duration_s
    from {pairs} where duration_s >= 0""")
def j1(spark, d):
    p = pairing.processing_times(lifecycle_log(spark, d))
    return rounded(p.select("case_id", "activity", "seq", "duration_s"))


part("feats", """select case_id, activity, start_resource as resource, start as "timestamp", event_order,
    duration_s, row_number() over w - 1 as case_position,
    coalesce(lag(activity) over w, '__START__') as previous_activity,
    date_diff('microsecond', min(start) over (partition by case_id), start) / 1e6 as case_age_seconds,
    cast(isodow(start) - 1 as int) as day_of_week, cast(hour(start) as int) as hour_of_day
    from {pairs} where duration_s > 0 and duration_s <= 31536000
    window w as (partition by case_id order by start, event_order)""")


@query("J2_instance_features", """select case_id, activity, resource, event_order,
    round(duration_s, 6) as duration_s, case_position, previous_activity,
    round(case_age_seconds, 6) as case_age_seconds, day_of_week, hour_of_day from {feats}""")
def j2(spark, d):
    return rounded(pairing.instance_features(lifecycle_log(spark, d)).drop(
        "timestamp", "n_previous_activities"))


@query("J3_gaps_to_next", f"""select activity, count(*) as n, round(avg(g), 3) as mean_s from
    (select activity, {secs('"timestamp"', 'nx')} as g from (select *, lead("timestamp") over
    ({CASE}) as nx from {{simple}})) where g >= 0 group by 1""")
def j3(spark, d):
    g = pairing.processing_times(simple_log(spark, d))
    return rounded(g.groupBy("activity").agg(
        F.count(F.lit(1)).alias("n"), F.avg("duration_s").alias("mean_s")), 3)


part("fifo_rows", f"""select * from (select *, coalesce(min(bal) over ({CA} rows between unbounded
    preceding and 1 preceding), 0) as low from (select *, sum(case lifecycle when 'start' then 1
    else -1 end) over ({CA} rows unbounded preceding) as bal from {{lc}}
    where lifecycle in ('start', 'complete')))
    where lifecycle = 'start' or not (bal < 0 and bal < low)""")


@query("J4_fifo_pairs", f"""select case_id, activity, epoch_us(start) as start_us,
    round(duration_s, 6) as duration_s from ({ranked('{fifo_rows}', "'start'")})""")
def j4(spark, d):
    p = pairing.fifo_pairs(lifecycle_log(spark, d))
    return rounded(p.select("case_id", "activity", micros("start").alias("start_us"),
                            "duration_s"))


IT = 'partition by work_item_id order by "timestamp", event_order'
part("isess", f"""select * from (select work_item_id, lag(case_id) over w as case_id,
    lag(activity) over w as activity, lag(resource) over w as resource,
    lag("timestamp") over w as start, "timestamp" as complete, lag(lifecycle) over w as pl, lifecycle,
    lag(event_order) over w as event_order
    from {{items}} where lifecycle in ('start', 'resume', 'suspend', 'complete')
    window w as ({IT})) where pl in ('start', 'resume') and lifecycle in ('suspend', 'complete')""")


@query("J5_item_sessions", f"""select work_item_id, resource, epoch_us(start) as start_us,
    round({secs('start', 'complete')}, 6) as seconds from {{isess}}""")
def j5(spark, d):
    from ..functions.columns import seconds_between
    s = pairing.item_sessions(item_log(spark, d))
    return rounded(s.select("work_item_id", "resource", micros("start").alias("start_us"),
                            seconds_between("start", "complete").alias("seconds")))


part("inst", f"""select case_id, activity, coalesce(complete_resource, start_resource) as resource,
    start, complete, event_order from ({ranked('{lc}', "'start'")})""")


@query("J6_paired_instances", """select resource, activity, count(*) as n, epoch_us(min(start)) as first_us,
    epoch_us(max(complete)) as last_us from {inst} group by 1, 2""")
def j6(spark, d):
    p = pairing.paired_instances(lifecycle_log(spark, d))
    return p.groupBy("resource", "activity").agg(
        F.count(F.lit(1)).alias("n"), F.min(micros("start")).alias("first_us"),
        F.max(micros("complete")).alias("last_us"))


# availability used by the overlap and KPI queries: the hull of a resource's events per day
part("hull", """select resource, cast("timestamp" as date) as day, min("timestamp") as avail_start,
    max("timestamp") as avail_end from {lc} group by 1, 2 having max("timestamp") > min("timestamp")""")
W0, W1 = "2024-01-06 00:00:00", "2024-01-26 12:00:00"


def hull(spark, d):
    return (lifecycle_log(spark, d).groupBy("resource", F.to_date("timestamp").alias("day"))
            .agg(F.min("timestamp").alias("avail_start"), F.max("timestamp").alias("avail_end"))
            .filter("avail_end > avail_start").drop("day"))


part("busy", f"""select s.*, {secs(f"greatest(start, avail_start, timestamp '{W0}')",
                                   f"least(complete, avail_end, timestamp '{W1}')")} as seconds
    from {{isess}} s join {{hull}} h on s.resource = h.resource and start < avail_end
    and complete > avail_start where least(complete, avail_end, timestamp '{W1}') >
    greatest(start, avail_start, timestamp '{W0}')""")


@query("J7_busy_overlap", """select resource, count(distinct event_order) as sessions,
    round(sum(seconds), 3) as seconds from {busy} group by 1""")
def j7(spark, d):
    p = pairing.busy_pieces(pairing.item_sessions(item_log(spark, d)), hull(spark, d), (W0, W1))
    return rounded(p.groupBy("resource").agg(
        F.countDistinct("event_order").alias("sessions"), F.sum("seconds").alias("seconds")), 3)
