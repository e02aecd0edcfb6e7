"""V: log against reference tables (and N7)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.staging import staged
from ..operators import shape, stats
from ..operators import validate as val
from .base import chat_log, item_log, lifecycle_log, part, query, simple_log
from .stats import day_cases
from . import kpi as _k, lifecycle as _l  # noqa: F401  shared CTEs

# reference: the branching of the first half of the month
part("early", """select * from {simple} where "timestamp" < timestamp '2024-01-16'""")
part("refb", """select activity, next_activity, count(*) / sum(count(*)) over (partition by activity) as p
    from (select activity, lead(activity) over (partition by case_id order by "timestamp", event_order)
    as next_activity from {early}) where next_activity is not null group by 1, 2
    union all select 'ghost', 'click', 1.0""")
part("late", """select * from {simple} where "timestamp" >= timestamp '2024-01-16'""")
part("simq", """select activity, next_activity, count(*) / sum(count(*)) over (partition by activity) as q
    from (select activity, lead(activity) over (partition by case_id order by "timestamp", event_order)
    as next_activity from {late}) where next_activity is not null group by 1, 2""")


def early(spark, d):
    return simple_log(spark, d).filter("timestamp < timestamp_ntz'2024-01-16'")


def late(spark, d):
    return simple_log(spark, d).filter("timestamp >= timestamp_ntz'2024-01-16'")


def reference(spark, d):
    b = stats.branching(early(spark, d)).select("activity", "next_activity", "p")
    ghost = spark.range(1).select(F.lit("ghost").alias("activity"),
                                  F.lit("click").alias("next_activity"), F.lit(1.0).alias("p"))
    return b.unionByName(ghost)


part("div", """select r.activity, case when r.activity = 'ghost' then null else t end as tvd, case when
    r.activity = 'error' then 'not_in_model' when r.activity = 'ghost' then 'absent' else 'compared' end
    as status, x as excluded_mass from (select activity, sum(case when next_activity = 'error' then p else
    0 end) as x from {refb} group by 1) r left join (select activity, 0.5 * sum(abs(coalesce(p, 0) -
    coalesce(q, 0))) as t from (select activity, next_activity, p / sum(p) over (partition by activity) as p
    from {refb} where next_activity <> 'error') full join {simq} using (activity, next_activity) group by 1)
    using (activity)""")


@query("V1_branching_divergence", """select activity, round(case when status = 'compared' then tvd end, 6)
    as tvd, status, round(case when status = 'compared' then excluded_mass else 0 end, 6) as excluded_mass
    from {div}""")
def v1(spark, d):
    model = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (
        "click", "view", "purchase", "signup", "ghost")])).alias("activity"))
    return rounded(val.branching_divergence(late(spark, d), reference(spark, d), model))


@query("V1_mean_divergence", """select round(avg(round(t, 4)), 6) as mean_tvd from (select activity,
    0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))) as t from (select * from {refb} where activity <> 'ghost')
    full join {simq} using (activity, next_activity) group by 1)""")
def v1b(spark, d):
    return rounded(val.mean_divergence(val.branching_divergence(late(spark, d), reference(spark, d))))


@query("V2_processing_time_errors", """with r as (select activity, avg(x) as ref_mean_s, stddev_samp(x) as
    ref_std_s from (select activity, date_diff('microsecond', start, complete) / 1e6 as x from {inst}) group by 1),
    s as (select activity, avg(x) as m, stddev_samp(x) as sd from (select activity, date_diff('microsecond',
    start, complete) / 1e6 as x from {isess}) group by 1)
    select activity, round(ref_mean_s, 2) as ref_mean_s, round(ref_std_s, 2) as ref_std_s, round(m, 2) as
    sim_mean_s, round(sd, 2) as sim_std_s, round(abs(m - ref_mean_s) / ref_mean_s, 6) as rel_err_mean
    from r left join s using (activity)""")
def v2(spark, d):
    from ..functions.columns import seconds_between
    from ..operators.pairing import paired_instances
    p = paired_instances(lifecycle_log(spark, d)).withColumn("x", seconds_between("start", "complete"))
    ref = p.groupBy("activity").agg(F.avg("x").alias("mean_s"), F.stddev_samp("x").alias("std_s"))
    return rounded(val.processing_time_errors(item_log(spark, d), ref), 2, rel_err_mean=6)


@query("V3_arrival_rate_error", """with a as (select cast(arrival as date) as d, count(*) as n from {subfirst}
    group by 1), m as (select avg(n) as n from a where d > (select min(d) from a) and d < (select max(d)
    from a)), g as (select avg(gap_s) as g from {gaps})
    select round(g, 4) as sim_mean_interarrival_s, round(n, 6) as sim_daily_arrivals_mean,
    round(abs(g - 600) / 600, 6) as rel_err, round(abs(n - 100) / 100, 6) as daily_arrivals_rel_err
    from g, m""")
def v3(spark, d):
    return rounded(val.arrival_rate_error(day_cases(spark, d), 600.0, 100.0), 6,
                   sim_mean_interarrival_s=4)


@query("V4_arrival_profile_error", """select profile, round(avg(abs(share - case when profile = 'hod' then
    1 / 24 else 1 / 7 end)), 6) as mae from {profile} group by 1""")
def v4(spark, d):
    flat = stats.arrival_profile(stats.case_arrivals(day_cases(spark, d))).select(
        "profile", "slot", F.when(F.col("profile") == "hod", 1 / 24).otherwise(1 / 7).alias("share"))
    return rounded(val.arrival_profile_error(day_cases(spark, d), flat))


# the log: conversations with an even id and no "system" turns; the reference: all conversations
part("half", "select * from {chat} where cast(case_id as int) % 2 = 0 and activity <> 'system'")
part("halft", """select distinct string_agg(activity, ' → ' order by event_order) as trace from {half}
    group by case_id""")
part("over", """select v.trace, frequency * 100.0 / (select sum(frequency) from {chatv}) as pct,
    v.trace in (select trace from {halft}) as found, (select count(*) from (select unnest(string_split(
    v.trace, ' → ')) as s) where s not in (select activity from {half})) as n_ignored,
    (select string_agg(s, ' → ' order by i) from (select unnest(string_split(v.trace, ' → ')) as s,
    generate_subscripts(string_split(v.trace, ' → '), 1) as i) where s in (select activity from {half}))
    in (select trace from {halft}) as loose from {chatv} v order by frequency desc, example_case limit 20""")


def overlap(spark, d):
    log = chat_log(spark, d)
    half = log.filter("cast(case_id as int) % 2 = 0 and activity <> 'system'")
    return val.variant_overlap(half, stats.variants(log))


@query("V5_variant_overlap", """select trace, round(pct, 6) as pct, found, n_ignored, found or (n_ignored > 0
    and coalesce(loose, false)) as found_ignoring_absent from {over}""")
def v5(spark, d):
    return rounded(overlap(spark, d))


@query("V5_variant_coverage", """select count(*) filter (found) as n_found, round(coalesce(sum(pct) filter
    (found), 0), 6) as pct_found, count(*) filter (found or (n_ignored > 0 and loose)) as
    n_found_ignoring_absent, round(coalesce(sum(pct) filter (found or (n_ignored > 0 and loose)), 0), 6)
    as pct_found_ignoring_absent from {over}""")
def v5b(spark, d):
    return rounded(val.variant_coverage(overlap(spark, d)))


CS = """select round(l, 6) as sim_case_length_mean, round(s, 3) as sim_case_duration_mean_s,
    round(abs(l - 60) / 60, 6) as case_length_rel_err, round(abs(s - 2000000) / 2000000, 6)
    as case_duration_rel_err from (select avg(n) as l, avg(s) as s from (select count(*) as n,
    date_diff('microsecond', min("timestamp"), max("timestamp")) / 1e6 as s from %s group by case_id))"""


@query("V6_case_stat_errors", CS % "{simple}")
def v6(spark, d):
    return rounded(val.case_stat_errors(simple_log(spark, d), 60, 2_000_000), 6,
                   sim_case_duration_mean_s=3)


def mined(log):
    """The reference tables and numbers of a log."""
    done = shape.completed_only(log)
    from ..functions.columns import seconds_between
    from ..operators.pairing import paired_instances
    p = paired_instances(log).withColumn("x", seconds_between("start", "complete"))
    a = stats.case_arrivals(log)
    basic = stats.basic_stats(done).first()
    return {
        "branching": stats.branching(done).select("activity", "next_activity", "p"),
        "processing_times": p.groupBy("activity").agg(
            F.avg("x").alias("mean_s"), F.stddev_samp("x").alias("std_s")),
        "variants": stats.variants(done), "profile": stats.arrival_profile(a),
        "suspends": _suspends(log),
        "mean_gap_s": stats.arrival_rate(a).first()["mean_s"],
        "daily_mean": stats.daily_arrival_stats(a).first()["mean"],
        "case_length": basic["length_mean"], "case_duration_s": basic["duration_s_mean"]}


def _suspends(log):
    return log.filter("activity like 'W%'").groupBy("activity", "work_item_id").agg(
        F.sum((F.col("lifecycle") == "suspend").cast("int")).alias("s")).groupBy("activity").agg(
        F.avg("s").alias("mean"))


@query("V8_artefact_gate", """select round(abs(s - 2000000) / 2000000, 6) as case_duration_rel_err,
    0.995::double as completion_share, abs(s - 2000000) / 2000000 <= 0.2 as accepted from (select avg(s) as s
    from (select date_diff('microsecond', min("timestamp"), max("timestamp")) / 1e6 as s from {simple}
    group by case_id))""")
def v8(spark, d):
    m = val._cells(val.case_stat_errors(simple_log(spark, d), 60, 2_000_000), "case_stats", None,
                   ["case_duration_rel_err"])
    return rounded(val.artefact_gate(m, 0.995))


@query("V9_prefix_agreement", """with p as (select *, row_number() over (partition by case_id order by
    "timestamp", event_order) as i from {simple}), q as (select *, row_number() over (partition by case_id
    order by "timestamp", event_order) as i from {simple} where not (activity = 'error' and event_order % 50 = 0
    and "timestamp" > timestamp '2024-01-08'))
    select case_id, count(*) as compared, bool_and(p.activity = q.activity) as agree from p join q
    using (case_id, i) group by 1""")
def v9(spark, d):
    a = simple_log(spark, d)
    b = a.filter("not (activity = 'error' and event_order % 50 = 0 "
                 "and timestamp > timestamp_ntz'2024-01-08')")
    return val.prefix_agreement(a, b)


def held(tables):
    """The reference with every table written once."""
    return {k: staged(v) if isinstance(v, DataFrame) else v for k, v in tables.items()}


# every row of the report, between two different logs; tested by brute force, no SQL
@query("V7_evaluate")
@query("V7_full_evaluate")
def v7_all(spark, d):
    log = staged(item_log(spark, d))
    return rounded(val.evaluate(log, held(mined(log.filter("timestamp < timestamp_ntz'2024-01-16'")))))


@query("V10_self_evaluation")
@query("V10_full_evaluation")
def v10_all(spark, d):
    log = staged(item_log(spark, d))
    return rounded(val.evaluate(log.filter("timestamp >= timestamp_ntz'2024-01-16'"),
                                held(mined(log.filter("timestamp < timestamp_ntz'2024-01-16'")))))


@query("N7_adjacency_conformance", """select cast(sum(n) as bigint) as n_steps, cast(sum(n) filter (p >= 0.2)
    as bigint) as n_allowed, round(sum(n) filter (p >= 0.2) / sum(n), 6) as conformance from {branch}""")
def n7(spark, d):
    log = simple_log(spark, d)
    return rounded(val.adjacency_conformance(log, stats.branching(log).filter("p >= 0.2")))
