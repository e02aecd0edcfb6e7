"""K: performance KPIs."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.staging import staged
from ..operators import kpi, pairing
from ..operators.shape import restrict_to_cases
from ..operators.stats import case_arrivals
from .base import item_log, lifecycle_log, part, query, secs
from .pairing import W0, W1, hull

part("hullsec", f"""select resource, sum({secs('avail_start', 'avail_end')}) as seconds from {{hull}}
    group by 1 union all select 'R99', 0 union all select 'R98', 3600""")


def available(spark, d):
    h = hull(spark, d).groupBy("resource").agg(
        F.sum(F.timestamp_diff("MICROSECOND", "avail_start", "avail_end") / 1e6).alias("seconds"))
    extra = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit("R99").alias("resource"), F.lit(0.0).alias("seconds")),
        F.struct(F.lit("R98").alias("resource"), F.lit(3600.0).alias("seconds")))).alias("c"))
    return h.unionByName(extra.select("c.*"))      # one absent and one idle resource


def sessions(spark, d):
    return pairing.paired_instances(item_log(spark, d))


part("lcarr", """select case_id, min("timestamp") as arrival from {lc} group by 1""")
part("cyc", f"""select case_id, {secs('a', 'b')} as s from (select l.case_id, min(l."timestamp") -
    interval 1 hour as a, max(l."timestamp") filter (lifecycle = 'complete') as b from {{lc}} l group by 1)
    where b is not null""")


def _times(spark, d):
    log = lifecycle_log(spark, d)
    arr = case_arrivals(log).withColumn("arrival", F.col("arrival") - F.expr("interval 1 hour"))
    done = log.filter("lifecycle = 'complete'").groupBy("case_id").agg(
        F.max("timestamp").alias("completion"))
    return log, arr, done


@query("K1_cycle_time", """select round(avg(s), 3) as avg_cycle_time_s, round(quantile_cont(s, 0.95), 3)
    as p95_cycle_time_s, count(*) as n_cases from {cyc}""")
def k1(spark, d):
    return rounded(kpi.cycle_time(*_times(spark, d)), 3)


@query("K2_busy_seconds", """select resource, round(sum(seconds), 3) as busy_s from {busy}
    where activity[1:2] = 'W_' group by 1""")
def k2(spark, d):
    return rounded(kpi.busy_seconds(sessions(spark, d), hull(spark, d), ["W_"], (W0, W1)), 3)


RAW = secs(f"greatest(start, timestamp '{W0}')", f"least(complete, timestamp '{W1}')")
part("occr", f"""select a.resource, a.seconds as available_s, coalesce(b.s, 0) as busy_s,
    case when a.seconds > 0 then coalesce(b.s, 0) / a.seconds end as occupation, case when a.seconds > 0
    then greatest(0, coalesce(r.s, 0) - coalesce(b.s, 0)) end as overtime_s from {{hullsec}} a left join
    (select resource, sum(seconds) as s from {{busy}} group by 1) b using (resource) left join (select
    resource, sum({RAW}) as s from {{isess}} where least(complete, timestamp '{W1}') > greatest(start,
    timestamp '{W0}') group by 1) r using (resource)""")


def occ(spark, d):
    return kpi.occupation(sessions(spark, d), available(spark, d), hull(spark, d), None, (W0, W1))


@query("K3_occupation", """select resource, round(available_s, 3) as available_s, round(busy_s, 3) as busy_s,
    round(occupation, 6) as occupation, round(overtime_s, 3) as overtime_s from {occr}""")
def k3(spark, d):
    return rounded(occ(spark, d), 3, occupation=6)


@query("K3_occupation_summary", """select round(avg(occupation), 6) as avg_resource_occupation,
    round(sum(overtime_s), 2) as busy_seconds_outside_availability, count(occupation)
    as n_resources_evaluated, count(*) filter (available_s <= 0) as n_resources_zero_availability
    from {occr}""")
def k3b(spark, d):
    return rounded(kpi.occupation_summary(occ(spark, d)), 6, busy_seconds_outside_availability=2)


part("fair", """select round(occupation, 4) as o, available_s as w from {occr}
    where occupation is not null""")


@query("K4_fairness", """select round((select avg(abs(o - (select avg(o) from {fair}))) from {fair}), 6)
    as resource_fairness, round((select sum(abs(o - (select sum(o * w) / sum(w) from {fair})) * w) / sum(w)
    from {fair}), 6) as weighted_resource_fairness""")
def k4(spark, d):
    w = available(spark, d).withColumnRenamed("seconds", "weight")
    return rounded(kpi.fairness(occ(spark, d), w))


part("mile", f"""select case_id, {secs('a', 'hit')} as s from (select case_id, min("timestamp") as a,
    min("timestamp") filter (activity in ('O_click', 'O_purchase') and lifecycle = 'complete') as hit
    from {{lc}} group by 1) where hit is not null""")


@query("K5_time_to_milestone", """select round(avg(s), 3) as mean_s, round(quantile_cont(s, 0.95), 3)
    as p95_s, count(*) as n_cases_reaching_it, (select count(distinct case_id) from {lc}) as n_cases_total
    from {mile}""")
def k5(spark, d):
    return rounded(kpi.time_to_milestone(lifecycle_log(spark, d), ["O_click", "O_purchase"]), 3)


part("hand", """select resource, lag(resource) over (partition by case_id order by start, event_order) as p
    from {isess}""")


@query("K6_handover", """select round(avg(case when p <> resource then 1.0 else 0.0 end), 6)
    as handover_rate, count(*) as n_consecutive_steps from {hand} where p is not null""")
def k6(spark, d):
    return rounded(kpi.handover(sessions(spark, d)))


part("swit", f"""select activity, lag(activity) over (partition by resource order by start, complete,
    event_order) as p from {{isess}} where complete > timestamp '{W0}' and start < timestamp '{W1}'""")


@query("K7_activity_switches", """select round(avg(case when p <> activity then 1.0 else 0.0 end), 6)
    as activity_switch_rate, count(*) as n_resource_transitions, count(*) filter (p <> activity)
    as n_activity_switches from {swit} where p is not null""")
def k7(spark, d):
    return rounded(kpi.activity_switches(sessions(spark, d), window=(W0, W1)))


part("bal", f"""select w, stddev_pop(o) as sd from (select w, r.resource, coalesce(sum({RAW}) filter (s.start is not null), 0) / 86400 as o
    from (select distinct date_trunc('day', greatest(start, timestamp '{W0}')) as w from {{isess}}
    where complete > timestamp '{W0}' and start < timestamp '{W1}') cross join (select resource from
    {{hullsec}}) r left join {{isess}} s on s.resource = r.resource and date_trunc('day', greatest(start,
    timestamp '{W0}')) = w and complete > timestamp '{W0}' and start < timestamp '{W1}' group by 1, 2)
    group by 1""")


@query("K8_workload_balance", """select round(avg(sd), 6) as mean_window_std, round(max(sd), 6)
    as max_window_std, count(*) as n_windows from {bal}""")
def k8(spark, d):
    return rounded(kpi.workload_balance(sessions(spark, d), subset=available(spark, d),
                                        window=(W0, W1)))


part("expo", """select e.*, s.*, b.* from (select count(*) as event_rows, count(*) filter
    (activity[1:2] = 'W_') as w_event_rows from {lc}) e, (select count(*) as paired_sessions,
    count(*) filter (activity[1:2] = 'W_') as w_paired_sessions from {inst}) s, (select sum(x)
    as busy_seconds, coalesce(sum(x) filter (activity[1:2] = 'W_'), 0) as w_busy_seconds from (select
    activity, date_diff('microsecond', start, complete) / 1e6 as x from {inst})) b""")


@query("K9_exposure", "select event_rows, w_event_rows, paired_sessions, w_paired_sessions, "
       "round(busy_seconds, 2) as busy_seconds, round(w_busy_seconds, 2) as w_busy_seconds, " + ", ".join(
           f"{r.format(f'({t} - w_{t})')} as ao_{t}, round(w_{t} / {t}, 6) as w_{s}_share, "
           f"round(({t} - w_{t}) / {t}, 6) as ao_{s}_share"
           for t, s, r in (("event_rows", "event", "{}"), ("paired_sessions", "session", "{}"),
                           ("busy_seconds", "busy", "round({}, 2)"))) + " from {expo}")
def k9(spark, d):
    log = lifecycle_log(spark, d)
    return rounded(kpi.exposure(log, pairing.paired_instances(log)), 6, busy_seconds=2,
                   w_busy_seconds=2, ao_busy_seconds=2)


part("done", """select distinct case_id from {lc} where lifecycle = 'complete' and activity = 'O_click'""")
part("dcyc", f"""select {secs('min("timestamp")', 'max("timestamp")')} as s from {{items}} where case_id in
    (select case_id from {{done}}) group by case_id""")
part("dhand", """select resource, lag(resource) over (partition by case_id order by start, event_order) as p
    from {isess}""")


# every metric of the report and its SQL
STEPS = {"mean_s": "avg(s)", "p95_s": "quantile_cont(s, 0.95)", "n_cases_reaching_it": "count(*)",
         "n_cases_total": "(select count(distinct case_id) from {lc}) + 0 * count(*)"}
METRICS = [
    ("cycle_time", "{dcyc}", {"avg_cycle_time_s": "avg(s)", "p95_cycle_time_s": "quantile_cont(s, 0.95)",
                              "n_cases": "count(*)"}),
    ("occupation", "{occr}", {
        "avg_resource_occupation": "avg(occupation)",
        "busy_seconds_outside_availability": "coalesce(sum(overtime_s), 0)",
        "n_resources_evaluated": "count(occupation)",
        "n_resources_zero_availability": "count(*) filter (available_s <= 0)"}),
    ("fairness", "{fair}", {
        "resource_fairness": "avg(abs(o - (select avg(o) from {fair})))",
        "weighted_resource_fairness":
            "sum(abs(o - (select sum(o * w) / sum(w) from {fair})) * w) / sum(w)"}),
    ("time_to_first_offer", "{clicked}", STEPS),
    ("time_to_decision", "{mile}", STEPS),
    ("handover", "{dhand} where p is not null", {
        "handover_rate": "avg(case when p <> resource then 1.0 else 0.0 end)",
        "n_consecutive_steps": "count(*)"}),
    ("switches", "{swit} where p is not null", {
        "activity_switch_rate": "avg(case when p <> activity then 1.0 else 0.0 end)",
        "n_resource_transitions": "count(*)", "n_activity_switches": "count(*) filter (p <> activity)"}),
    ("balance", "{bal}", {"mean_window_std": "avg(sd)", "max_window_std": "max(sd)",
                          "n_windows": "count(*)"}),
    ("cases", "{lc}", {"in_log": "count(distinct case_id)",
                       "completed": "count(distinct case_id) filter (case_id in (select case_id from {done}))"})]
part("clicked", f"""select case_id, {secs('a', 'hit')} as s from (select case_id, min("timestamp") as a,
    min("timestamp") filter (activity = 'O_click' and lifecycle = 'complete') as hit
    from {{lc}} group by 1) where hit is not null""")


REPORT = " union all ".join(
    f"select '{name}.{c}' as metric, round(cast({e} as double), 3) as value from {rows}"
    for name, rows, cells in METRICS for c, e in cells.items())


@query("K10_report", REPORT)
@query("K10_full_report", REPORT)
def k10_all(spark, d):
    log = staged(item_log(spark, d))
    done = log.filter("lifecycle = 'complete' and activity = 'O_click'").select("case_id").distinct()
    a, h = staged(available(spark, d)), staged(hull(spark, d))
    return rounded(kpi.report(
        log, available=a, intervals=h, weights=a.withColumnRenamed("seconds", "weight"),
        completed=done, window=(W0, W1), subset=a, first_offer=["O_click"],
        decision=["O_click", "O_purchase"]), 3)


@query("K11_run_guards", """select count(*) filter (lifecycle in ('start', 'resume') and activity[1:2] = 'W_'
    and resource = '') as missing_resource_starts, count(*) filter (lifecycle in ('start', 'resume') and
    activity[1:2] <> 'W_' and resource <> '') as assigned_atomic_starts, count(*) filter (lifecycle in
    ('start', 'resume') and activity[1:2] <> 'W_') as atomic_starts, round((select max(occupation) from
    {occr}), 6) as max_resource_occupation, false as passes from (select activity, case when activity[1:1] =
    'A' then 'start' else lifecycle end as lifecycle, case when resource in ('R2', 'R5') then '' else resource
    end as resource from {lc})""")
def k11(spark, d):
    log = lifecycle_log(spark, d)
    log = log.withColumn("lifecycle", F.when(F.col("activity").startswith("A"), "start")
                         .otherwise(F.col("lifecycle"))) \
        .withColumn("resource", F.when(F.col("resource").isin("R2", "R5"), "")
                    .otherwise(F.col("resource")))
    return rounded(kpi.run_guards(log, occ(spark, d)))


@query("K12_throughput_share", f"""select resource, count(*) as n, round(count(*) / sum(count(*)) over (), 6)
    as share from {{lc}} where lifecycle = 'complete' and "timestamp" >= timestamp '{W0}' and
    "timestamp" < timestamp '{W1}' group by 1""")
def k12(spark, d):
    return rounded(kpi.throughput_share(lifecycle_log(spark, d), W0, W1))


@query("K13_completion_summary", f"""select count(*) as n_arrived, count(completion) as n_completed,
    count(*) filter (completion < timestamp '{W1}') as n_completed_in_window, round(count(completion) /
    count(*), 6) as completion_share, round(count(offer) / count(*), 6) as reached_offer, round(count(hold) /
    count(*), 6) as reached_hold from (select case_id, max("timestamp") filter (activity = 'O_signup') as
    completion, min("timestamp") filter (activity = 'O_click') as offer, min("timestamp") filter (activity =
    'W_2' and lifecycle = 'ate_abort') as hold from {{lc}} group by 1)""")
def k13(spark, d):
    def when(c, t):
        return F.when(F.expr(c), F.col("timestamp"))
    c = lifecycle_log(spark, d).groupBy("case_id").agg(
        F.min("timestamp").alias("arrival"),
        F.max(when("activity = 'O_signup'", 0)).alias("completion"),
        F.min(when("activity = 'O_click'", 0)).alias("offer_ts"),
        F.min(when("activity = 'W_2' and lifecycle = 'ate_abort'", 0)).alias("hold_ts"))
    return rounded(kpi.completion_summary(c, W1, {"offer": "offer_ts", "hold": "hold_ts"}))
