"""L: work-item lifecycle."""

from pyspark.sql import functions as F

from ..functions.columns import micros, rounded
from ..functions.staging import staged
from ..operators import lifecycle as lc
from ..operators.calendars import fit_weekly, presence
from .base import item_log, lifecycle_log, part, query, secs
from .fit import DELAY, _delay_shown, fit_parts
from . import pairing as _p  # noqa: F401  shared CTEs

TERM = "('complete', 'ate_abort', 'withdraw')"
CA = 'partition by case_id, activity order by "timestamp", event_order'
CAI = 'partition by case_id, activity, inst order by "timestamp", event_order'
PREV = "rows between unbounded preceding and 1 preceding"

part("seg0", f"""select *, coalesce(sum(case when lifecycle in {TERM} then 1 else 0 end) over
    ({CA} {PREV}), 0) as inst from {{lc}} where activity[1:2] = 'W_'""")
part("seg1", f"""select *, case when coalesce(sum(case when lifecycle = 'start' then 1 else 0 end) over
    ({CAI} {PREV}), 0) = 0 then 'N' when last_value(case when lifecycle in ('start', 'suspend',
    'resume') then lifecycle end ignore nulls) over ({CAI} {PREV}) = 'suspend' then 'S' else 'R' end
    as state from {{seg0}}""")
part("seg", f"""select *, last_value(case when opens then "timestamp" end ignore nulls) over ({CAI} {PREV})
    as running_since, last_value(case when stops then "timestamp" end ignore nulls) over ({CAI} {PREV})
    as suspended_at, first_value(case when lifecycle in ('schedule', 'start') then "timestamp" end
    ignore nulls) over ({CAI} rows unbounded preceding) as created_at, first_value(case when
    lifecycle in ('schedule', 'start') then lifecycle end ignore nulls) over ({CAI} rows unbounded
    preceding) as created_by, lifecycle in {TERM} as terminal
    from (select *, lifecycle = 'start' or (lifecycle = 'resume' and state = 'S') as opens,
    lifecycle = 'suspend' and state = 'R' as stops from {{seg1}})""")
part("act", f"""select *, {secs('running_since', '"timestamp"')} as seconds, case lifecycle when
    'ate_abort' then 'abort' else lifecycle end as outcome from {{seg}}
    where state = 'R' and lifecycle in ('suspend', 'complete', 'ate_abort')""")
part("rgaps", f"""select case_id, activity, event_order, resource, suspended_at, "timestamp" as resumed_at,
    {secs('suspended_at', '"timestamp"')} as gap_s from {{seg}}
    where lifecycle = 'resume' and state = 'S'""")
part("waits", f"""select case_id, activity, event_order, {secs('created_at', '"timestamp"')} as wait_s
    from {{seg}} where lifecycle = 'withdraw' and created_by = 'schedule' and state <> 'R'""")
part("tok", """select case_id, event_order, "timestamp" as ready_ts, "timestamp" as end_ts, activity,
    null as outcome from {lc} where activity[1:2] <> 'W_' and lifecycle = 'complete' union all
    select case_id, event_order, coalesce(created_at, "timestamp"), "timestamp", activity, lifecycle
    from {seg} where terminal""")
part("link", """select *, lead(activity) over (partition by case_id order by end_ts, event_order)
    as next_activity, lead(ready_ts) over (partition by case_id order by end_ts, event_order)
    as next_ready from {tok}""")
part("delays", f"""select case_id, activity, next_activity, greatest(0.0::double,
    {secs('end_ts', 'next_ready')}) as delay_s from {{link}} where next_activity is not null""")


def seg(spark, d):
    return lc.segment(lifecycle_log(spark, d))


@query("L1_segment", """select case_id, activity, event_order, inst as instance, state,
    epoch_us(running_since) as running_us, epoch_us(suspended_at) as suspended_us,
    epoch_us(created_at) as created_us, created_by, opens, stops, terminal
    from (select * replace (case when state = 'R' then running_since end as running_since,
    case when state = 'S' then suspended_at end as suspended_at) from {seg})""")
def l1(spark, d):
    s = seg(spark, d)
    return s.select(
        "case_id", "activity", "event_order", F.col("instance").cast("bigint").alias("instance"),
        "state", F.when(F.col("state") == "R", micros("running_since")).alias("running_us"),
        F.when(F.col("state") == "S", micros("suspended_at")).alias("suspended_us"),
        micros("created_at").alias("created_us"), "created_by", "opens", "stops", "terminal")


@query("L2_active_sessions", """select case_id, activity, event_order, outcome,
    round(seconds, 6) as seconds from {act}""")
def l2(spark, d):
    return rounded(lc.active_sessions(seg(spark, d)).select(
        "case_id", "activity", "event_order", "outcome", "seconds"))


part("seh", """select activity, count(*) filter (outcome = 'complete') as n_complete,
    count(*) filter (outcome = 'suspend') as n_suspend, count(*) filter (outcome = 'abort') as n_abort,
    coalesce(count(*) filter (outcome = 'complete') / nullif(count(*) filter (outcome <> 'abort'), 0),
    0) as p_complete from {act} group by 1""")
part("sueh", """select activity, count(*) filter (lifecycle = 'resume') as n_resume, count(*) filter
    (lifecycle = 'ate_abort') as n_abort, count(*) filter (lifecycle = 'resume') / count(*) as p_resume
    from {seg} where state = 'S' and lifecycle in ('resume', 'ate_abort') group by 1""")


@query("L3_session_end", """select activity, n_complete, n_suspend, n_abort,
    round(p_complete, 6) as p_complete from {seh}""")
def l3(spark, d):
    return rounded(lc.session_end_hazard(seg(spark, d)))


@query("L4_suspend_end", "select activity, n_resume, n_abort, round(p_resume, 6) as p_resume from {sueh}")
def l4(spark, d):
    return rounded(lc.suspend_end_hazard(seg(spark, d)))


@query("L5_resume_gaps", """select case_id, activity, event_order, resource,
    round(gap_s, 6) as gap_s from {rgaps}""")
def l5(spark, d):
    return rounded(lc.resume_gaps(seg(spark, d)).select(
        "case_id", "activity", "event_order", "resource", "gap_s"))


HOUR = """(hour({t}) + minute({t}) / 60.0::double + floor(second({t})) / 3600.0::double)"""
part("lcpres", f"""select case when resource in ('R5', 'R6') then 'former ' || resource else resource end
    as resource, cast("timestamp" as date) as day, cast(isodow("timestamp") - 1 as int)
    as dow, min({HOUR.format(t='"timestamp"')}) as h0, max({HOUR.format(t='"timestamp"')}) as h1
    from {{lc}} group by 1, 2, 3""")
part("lcwin", """select resource, dow, quantile_cont(h0, 0.1) as open_h, quantile_cont(h1, 0.9) as close_h
    from {lcpres} group by 1, 2 having quantile_cont(h1, 0.9) > quantile_cont(h0, 0.1)""")
part("lchol", "select date '2024-01-01' as day union all select date '2024-01-15'")
part("tails", f"""select g.*, case when gap_s <= 0 or resource is null or resource = 'R7' or resource
    not in (select resource from {{lcwin}}) then 0.0 when exists (select 1 from {{lcwin}} w where
    w.resource = g.resource and w.dow = isodow(resumed_at) - 1 and cast(resumed_at as date) not in
    (select day from {{lchol}}) and w.open_h <= {HOUR.format(t='resumed_at')} and
    {HOUR.format(t='resumed_at')} < w.close_h) then 0.0 else coalesce((select min(least(greatest(
    {secs('close', 'resumed_at')}, 0.0), gap_s)) from (select cast(cast(resumed_at as date) - cast(b as int)
    as timestamp) + to_microseconds(cast(round_even(w.close_h * 3600, 0) as bigint) * 1000000) as close
    from range(15) t(b) join {{lcwin}} w on w.resource = g.resource and w.dow =
    isodow(cast(resumed_at as date) - cast(b as int)) - 1 where cast(resumed_at as date) - cast(b as int)
    not in (select day from {{lchol}})) where close <= resumed_at), gap_s) end as tail_s
    from {{rgaps}} g""")
fit_parts("resid", "(select *, greatest(0, gap_s - tail_s) as residual_s from {tails})",
          ["activity"], "residual_s")


def lc_calendar(spark, d):
    # two resources leave their traces under other names and so have no windows
    log = lifecycle_log(spark, d).withColumn("resource", F.expr(
        "if(resource in ('R5', 'R6'), concat('former ', resource), resource)"))
    p = staged(presence(log))       # read for days, weekdays and both ends of the windows
    windows = fit_weekly(p, min_active_days=1)
    hol = spark.range(1).select(F.explode(F.expr(
        "array(date'2024-01-01', date'2024-01-15')")).alias("date"))
    return windows, hol, spark.range(1).select(F.lit("R7").alias("resource"))


def tails(spark, d):
    return lc.off_shift_tail(lc.resume_gaps(seg(spark, d)), *lc_calendar(spark, d))


@query("L6_off_shift_tail", """select case_id, event_order, round(gap_s, 6) as gap_s,
    round(tail_s, 4) as tail_s from {tails}""")
def l6(spark, d):
    return rounded(tails(spark, d).select("case_id", "event_order", "gap_s", "tail_s"), 6, tail_s=4)


@query("L7_resume_gap_fit", DELAY.format(k="activity", u="activity", v="residual_s", name="resid",
       src="(select *, greatest(0, gap_s - tail_s) as residual_s from {tails})"))
def l7(spark, d):
    return _delay_shown(lc.resume_gap_fits(lc.residual_gaps(tails(spark, d))))


@query("L8_withdraw_wait", """select case_id, activity, event_order, round(wait_s, 6) as wait_s
    from {waits} where wait_s >= 0""")
def l8(spark, d):
    return rounded(lc.withdraw_waits(seg(spark, d)))


@query("L9_tokens", """select case_id, event_order, epoch_us(ready_ts) as ready_us, epoch_us(end_ts)
    as end_us, activity, outcome from {tok}""")
def l9(spark, d):
    t = lc.tokens(lifecycle_log(spark, d), seg(spark, d))
    return t.select("case_id", "event_order", micros("ready_ts").alias("ready_us"),
                    micros("end_ts").alias("end_us"), "activity", "outcome")


def tok(spark, d):
    return lc.tokens(lifecycle_log(spark, d), seg(spark, d))


@query("L10_inter_activity_delays", """select case_id, activity, next_activity,
    round(delay_s, 6) as delay_s from {delays}""")
def l10(spark, d):
    return rounded(lc.inter_activity_delays(tok(spark, d)))


part("delays2", """select activity, next_activity, delay_s from {delays} union all
    select '', '', delay_s from {delays}""")
fit_parts("dfit", "{delays2}", ["activity", "next_activity"], "delay_s")


@query("L10_delay_fits", "select * replace (nullif(activity, '') as activity, nullif(next_activity, '') "
       "as next_activity) from (" + DELAY.format(
           k="activity, next_activity", u="activity, next_activity", v="delay_s", name="dfit",
           src="{delays2}") + ")")
def l10b(spark, d):
    return _delay_shown(lc.delay_fits(lc.inter_activity_delays(tok(spark, d))))


@query("L11_terminal_continuation", """select activity, outcome, coalesce(next_activity, '__CASE_END__')
    as next_activity, count(*) as n, round(count(*) / sum(count(*)) over
    (partition by activity, outcome), 6) as p from {link} where outcome is not null group by 1, 2, 3""")
def l11(spark, d):
    return rounded(lc.terminal_continuation(tok(spark, d)))


@query("J8_next_token", """select case_id, event_order, coalesce(next_activity, '__CASE_END__')
    as next_activity from {link} where outcome is not null""")
def j8(spark, d):
    t = lc._linked(tok(spark, d)).filter("outcome is not null")
    return t.select("case_id", "event_order",
                    F.coalesce("__n.activity", F.lit("__CASE_END__")).alias("next_activity"))


@query("L12_suspends_per_instance", """select activity, round(avg(s), 6) as mean,
    cast(max(s) as bigint) as "max", round(avg(case when s > 0 then 1.0 else 0.0 end), 6)
    as share_suspended, count(*) as n_instances, round(median(s), 6) as median,
    round(quantile_cont(s, 0.9), 6) as p90 from (select activity, sum(case when stops then 1 else 0 end)
    ::double as s from {seg} group by case_id, activity, inst having bool_or(terminal)) group by 1""")
def l12(spark, d):
    return rounded(lc.suspends_per_instance(seg(spark, d)))


part("lcspan", f"""select 0 as g0, {secs('min("timestamp")', 'max("timestamp")')} as duration_s
    from {{lc}} group by case_id""")
fit_parts("env", "{lcspan}", ["g0"], "duration_s")


@query("L13_case_envelope", "select * exclude (g0), 0.724763::double as runtime_scale from (" + DELAY.format(
    k="g0", u="g0", v="duration_s", src="{lcspan}", name="env") + ")")
def l13(spark, d):
    out = lc.case_duration_envelope(lifecycle_log(spark, d))
    return rounded(_delay_shown(out.drop("runtime_scale")).withColumn(
        "runtime_scale", F.lit(0.724763)))


part("tr0", f"""select *, sum(case when lifecycle in ('schedule', 'start') then 1 else 0 end) over
    ({CAI} rows unbounded preceding) > 0 as live from {{seg0}}""")
part("tr1", f"""select *, last_value(case when op or lifecycle = 'suspend' then op end ignore nulls) over
    ({CAI} {PREV}) as lop, last_value(case when op or lifecycle = 'suspend' then "timestamp" end
    ignore nulls) over ({CAI} {PREV}) as lts from (select *, lifecycle = 'start' or (lifecycle = 'resume'
    and live) as op from {{tr0}})""")
part("trs", f"""select *, {secs('lts', '"timestamp"')} as duration_s from {{tr1}} where lop and lifecycle in
    ('suspend', 'complete', 'ate_abort') and "timestamp" > lts""")
part("tri", """select case_id, activity, inst, min(case when lifecycle = 'start' then "timestamp" end) as fs,
    arg_min(resource, "timestamp") filter (lifecycle = 'start') as resource,
    arg_min(event_order, "timestamp") filter (lifecycle = 'start') as eo
    from {tr0} group by 1, 2, 3 having min(case when lifecycle = 'start' then "timestamp" end) is not null""")
part("trl", """select *, row_number() over (partition by case_id order by ts, kind, eo) - 1
    as case_position, coalesce(lag(activity) over (partition by case_id order by ts, kind, eo),
    '__START__') as previous_activity from (select case_id, activity, "timestamp" as ts, 0 as kind,
    event_order as eo, null as inst, null as resource from {lc} where activity[1:2] <> 'W_'
    and lifecycle = 'complete' union all select case_id, activity, fs, 1, eo, inst, resource from {tri} i
    where exists (select 1 from {trs} s where s.case_id = i.case_id and s.activity = i.activity and
    s.inst = i.inst))""")
part("training", f"""select s.case_id, s.activity, s.inst, s.event_order as session_order, duration_s,
    l.resource, case_position, previous_activity, {secs('b', 'ts')} as case_age_seconds,
    cast(isodow(ts) - 1 as int) as day_of_week, cast(hour(ts) as int) as hour_of_day, ts
    from {{trs}} s join {{trl}} l on l.kind = 1 and l.case_id = s.case_id and l.activity = s.activity
    and l.inst = s.inst join (select case_id, min("timestamp") as b from {{lc}} group by 1) f
    on f.case_id = s.case_id where duration_s <= 604800""")


@query("L14_training_sessions", """select case_id, activity, session_order, round(duration_s, 6)
    as duration_s, resource, case_position, previous_activity, round(case_age_seconds, 6)
    as case_age_seconds, day_of_week, hour_of_day from {training}""")
def l14(spark, d):
    t = lc.training_sessions(lifecycle_log(spark, d))
    return rounded(t.drop("instance", "timestamp", "n_previous_activities"))


IT = 'partition by work_item_id order by "timestamp", event_order'
part("it0", f"""select *, last_value(case when lifecycle in ('start', 'resume', 'suspend', 'complete')
    then lifecycle end ignore nulls) over ({IT} {PREV}) as pl, last_value(case when lifecycle in
    ('start', 'resume', 'suspend', 'complete') then "timestamp" end ignore nulls) over ({IT} {PREV}) as pt
    from {{items}} where activity[1:2] = 'W_'""")
part("it1", f"""select work_item_id, min(activity) as activity, arg_max(lifecycle, "timestamp") filter
    (lifecycle in {TERM}) as terminal, arg_max("timestamp", "timestamp") filter (lifecycle in {TERM}) as te,
    max("timestamp") filter (lifecycle = 'schedule') as sched, min("timestamp") filter
    (lifecycle in ('start', 'resume')) as first, coalesce(sum({secs('pt', '"timestamp"')}) filter
    (pl in ('start', 'resume') and lifecycle in ('suspend', 'complete')), 0) as active_s,
    count(*) filter (lifecycle in ('start', 'resume')) as sessions, count(*) filter
    (pl in ('start', 'resume') and lifecycle = 'suspend') as suspends from {{it0}} group by 1""")
part("ritems", f"""select work_item_id, activity, terminal, elapsed_s, active_s, elapsed_s - active_s as
    non_active_s, sessions, suspends from (select *, case when terminal = 'withdraw' then
    case when sched is not null then greatest(0, {secs('sched', 'te')}) end when first is not null then
    greatest(0, {secs('first', 'te')}) end as elapsed_s from {{it1}} where terminal is not null)""")


@query("L15_items", """select work_item_id, activity, terminal, round(elapsed_s, 6) as elapsed_s,
    round(active_s, 6) as active_s, round(non_active_s, 6) as non_active_s, sessions, suspends
    from {ritems}""")
def l15(spark, d):
    return rounded(lc.recomposed_items(item_log(spark, d)), 6)


@query("L15_item_summary", """with u as (unpivot (select activity, terminal, elapsed_s, active_s,
    non_active_s, suspends::double as suspends from {ritems}) on elapsed_s, active_s, non_active_s,
    suspends into name measure value v)
    select case when grouping(activity) = 0 then activity end as activity, terminal, measure,
    count(*) as n, round(avg(v), 3) as mean, round(median(v), 4) as median,
    round(quantile_cont(v, 0.9), 3) as p90 from u
    group by grouping sets ((activity, terminal, measure), (terminal, measure))""")
def l15b(spark, d):
    return rounded(lc.item_summary(lc.recomposed_items(item_log(spark, d))), 3, median=4)


@query("L16_resume_ownership", f"""with r as (select activity, lifecycle, resource, lag(resource) over ({IT})
    as pr from {{items}} where activity[1:2] = 'W_' and lifecycle in ('start', 'resume'))
    select case when grouping(activity) = 0 then activity end as activity, count(*) filter
    (resource = pr) as same_resource, count(*) as total_resumes,
    round(count(*) filter (resource = pr) / count(*), 6) as same_resource_rate
    from r where lifecycle = 'resume' group by grouping sets ((activity), ())""")
def l16(spark, d):
    return rounded(lc.resume_ownership(item_log(spark, d)))


@query("L17_transition_counts", "select lifecycle, count(*) as n from {lc} group by 1")
def l17(spark, d):
    return lc.transition_counts(lifecycle_log(spark, d))


part("churn0", """select work_item_id, count(*) filter (lifecycle in ('start', 'resume')) as sessions,
    count(*) filter (lifecycle = 'withdraw') as withdrawals from {items} where activity[1:2] = 'W_'
    group by 1""")


@query("L18_churn", """select count(*) as work_items, max(sessions) as max_sessions, count(*) filter
    (sessions >= 3) as at_guard, cast(sum(withdrawals) as bigint) as withdrawals,
    round(median(sessions) filter (sessions > 0), 6) as median_sessions from {churn0}""")
def l18(spark, d):
    return rounded(lc.churn(item_log(spark, d), max_sessions=3))


@query("L18_churn_by_activity", """select activity, count(distinct work_item_id) as work_items,
    count(*) filter (lifecycle = 'withdraw') as withdrawals from {items} where activity[1:2] = 'W_'
    group by 1 union all select 'W_9', 0, 0""")
def l18b(spark, d):
    return lc.churn_by_activity(item_log(spark, d), rare=["W_9", "W_2"])


@query("L19_suspend_count_errors", """with s as (select activity, work_item_id, count(*) filter
    (lifecycle = 'suspend') as s from {items} where activity[1:2] = 'W_' group by 1, 2)
    select activity, round(avg(s), 6) as sim_mean, 0.5::double as ref_mean,
    round(abs(avg(s) - 0.5), 6) as abs_error, count(*) as n_work_items from s group by 1""")
def l19(spark, d):
    log = item_log(spark, d)
    ref = log.filter("activity like 'W%'").select("activity").distinct().withColumn(
        "mean", F.lit(0.5))
    return rounded(lc.suspend_count_errors(log, ref))


part("tpairs", f"""select lifecycle, nl as next_lifecycle, {secs('"timestamp"', 'nt')} / 60 as gap_min,
    resource = nr as same from (select *, lead(lifecycle) over ({CA}) as nl, lead("timestamp") over ({CA})
    as nt, lead(resource) over ({CA}) as nr from {{lc}}) where nt is not null""")


@query("L20_regime_audit", """select lifecycle, next_lifecycle, count(*) as n, round(avg(gap_min), 4)
    as mean_gap_min, round(avg(case when same then 1.0 else 0.0 end), 6) as same_resource_share
    from {tpairs} group by 1, 2""")
def l20(spark, d):
    return rounded(lc.regime_audit(lifecycle_log(spark, d)), 4, same_resource_share=6)


@query("L20_schedule_start_bins", """select case when gap_min < 1/60 then '<1 s' when gap_min < 1 then
    '<1 min' when gap_min < 60 then '1–60 min' when gap_min < 720 then '1–12 h' else '>12 h' end as bin,
    count(*) as n, round(avg(case when same then 1.0 else 0.0 end), 6) as same_resource_share,
    round(count(*) / sum(count(*)) over (), 6) as share from {tpairs}
    where lifecycle = 'schedule' and next_lifecycle = 'start' group by 1""")
def l20b(spark, d):
    return rounded(lc.schedule_start_bins(lifecycle_log(spark, d)))


@query("L21_batch_fingerprint", """with p as (select "timestamp" as t, count(*) as n,
    count(distinct case_id) as c from {lc} where lifecycle = 'suspend' group by 1)
    select cast(sum(n) as bigint) as n_events, max(c) as max_cases_per_instant, count(*) filter (c >= 10)
    as crowded_instants, round(coalesce(sum(n) filter (hour(t) = 22), 0) / sum(n), 6) as share_at_hour,
    round(coalesce(sum(n) filter (second(t) = 0), 0) / sum(n), 6) as share_on_minute from p""")
def l21(spark, d):
    return rounded(lc.batch_fingerprint(lifecycle_log(spark, d)))


@query("L22_origin_crosstab", "select activity[1:2] as event_origin, " + ", ".join(
    f"count(*) filter (lifecycle = '{t}') as {t}" for t in lc.TRANSITIONS)
    + " from {lc} group by 1")
def l22(spark, d):
    log = lifecycle_log(spark, d).withColumn("event_origin", F.substring("activity", 1, 2))
    return lc.origin_crosstab(log)


@query("L23_hazard_inventory", """select activity, round(p_complete, 6) as p_complete, round(p_resume, 6)
    as p_resume, n_gaps, n_withdraws, coalesce(p_complete in (0, 1) or p_resume in (0, 1), false)
    as boundary from {seh} full join {sueh} using (activity) full join (select activity, count(*) as n_gaps
    from {rgaps} group by 1) using (activity) full join (select activity, count(*) as n_withdraws from
    {waits} group by 1) using (activity)""")
def l23(spark, d):
    return rounded(lc.hazard_inventory(seg(spark, d)))


@query("L23_median_hazards", """select 'p_complete' as hazard, round(median(p_complete), 6) as median
    from {seh} union all select 'p_resume', round(median(p_resume), 6) from {sueh}""")
def l23b(spark, d):
    return rounded(lc.median_hazards(lc.hazard_inventory(seg(spark, d))))


@query("L24_hours_by_run", """select cast(split_part(work_item_id, '-', 3) as varchar) as run_id, terminal,
    count(*) as n, round(avg(active_s) / 3600, 5) as active_h, round(avg(non_active_s) / 3600, 5)
    as non_active_h from {ritems} group by 1, 2""")
def l24(spark, d):
    log = item_log(spark, d).withColumn("run_id", F.split_part("work_item_id", F.lit("-"), F.lit(3)))
    return rounded(lc.hours_by_run(lc.recomposed_items(log)), 5)
