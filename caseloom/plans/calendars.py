"""R: presence, weekly windows, holidays, leave, rosters (and J12)."""

from pyspark.sql import functions as F

from ..functions.columns import micros, monday_dow, rounded
from ..functions.staging import staged
from ..operators import calendars as cal
from .base import lifecycle_log, part, presence_log, query, secs, ship_log, simple_log

H = """(hour({t}) + minute({t}) / 60.0::double + floor(second({t})) / 3600.0::double)"""
HT = H.format(t='"timestamp"')
MIN_DAYS = 8        # the given presence table is short: about 11 active days per resource

part("pres", f"""select resource, cast("timestamp" as date) as "date", min({HT}) as "first",
    max({HT}) as "last", count(*) as n_events, cast(isodow(any_value("timestamp")) - 1 as int) as dow,
    max({HT}) - min({HT}) as span from {{seen}} group by 1, 2""")
part("occ", """select cast(isodow(x) - 1 as int) as dow, count(*) as n from (select unnest(generate_series(
    min("date"), max("date"), interval 1 day)) as x from {pres}) group by 1""")
part("cnt", """select resource, count(*) as days from {pres} group by 1""")
part("worked", """select resource, dow, count(*) as w from {pres} group by 1, 2""")


def tier_a(lo, hi):
    return f"""select resource, dow, open_h, close_h, w / n as p_work, 'A' as tier from (select resource,
    dow, quantile_cont("first", {lo}) as open_h, quantile_cont("last", {hi}) as close_h from {{pres}}
    join {{cnt}} using (resource) where days >= {MIN_DAYS} group by 1, 2) join {{worked}}
    using (resource, dow) join {{occ}} using (dow) where close_h > open_h"""


part("wina", tier_a(0.1, 0.9))
part("winb", f"""select resource, dow, open_h, close_h, w / n as p_work, 'B' as tier from (select resource,
    case when c > o then o else lo end as open_h, case when c > o then c else hi end as close_h from
    (select resource, quantile_cont("first", 0.1) as o, quantile_cont("last", 0.9) as c,
    min("first") as lo, max("last") as hi from {{pres}} join {{cnt}} using (resource)
    where days < {MIN_DAYS} group by 1)) join {{worked}} using (resource) join {{occ}} using (dow)
    where close_h > open_h""")
part("win", "select * from {wina} union all select * from {winb}")


def pres(spark, d):
    return cal.presence(presence_log(spark, d))


def windows(spark, d, sparse=1):
    return cal.fit_weekly(pres(spark, d), MIN_DAYS, sparse_floor=sparse)


@query("R1_presence", """select resource, cast("date" as varchar) as "date", round("first", 6) as "first",
    round("last", 6) as "last", n_events, dow, round(span, 6) as span from {pres}""")
def r1(spark, d):
    return rounded(pres(spark, d).withColumn("date", F.col("date").cast("string")))


WCOLS = """resource, dow, round(open_h, 6) as open_h, round(close_h, 6) as close_h,
    round(p_work, 6) as p_work, tier"""


@query("R2_weekly_windows", f"select {WCOLS} from {{wina}}")
def r2(spark, d):
    return rounded(cal.fit_weekly(pres(spark, d), MIN_DAYS))


@query("R3_sparse_windows", f"select {WCOLS} from {{win}}")
def r3(spark, d):
    return rounded(windows(spark, d))


@query("J12_window_lookup", f"""select resource, event_order, open_h <= h and h <= close_h as inside
    from (select resource, event_order, cast(isodow("timestamp") - 1 as int) as dow, {HT} as h
    from {{seen}}) join {{win}} using (resource, dow)""")
def j12(spark, d):
    return cal.window_hits(presence_log(spark, d), windows(spark, d)).select(
        "resource", "event_order", "inside")


def evaluate(win):
    return f"""select (select avg(case when open_h <= h and h <= close_h then 1.0 else 0.0 end) from
    (select resource, cast(isodow("timestamp") - 1 as int) as dow, {HT} as h from {{seen}})
    join ({win}) using (resource, dow)) as coverage, (select sum(s) / sum((close_h - open_h) * n) from
    ({win}) join (select resource, dow, count(*) as n, sum(span) as s from {{pres}} group by 1, 2)
    using (resource, dow)) as window_utilisation"""


@query("R4_window_quality", f"""select round(coverage, 6) as coverage, round(window_utilisation, 6)
    as window_utilisation, (select count(distinct resource) from {{win}}) as resources_modelled
    from ({evaluate('select * from {win}')})""")
def r4(spark, d):
    return rounded(cal.evaluate_weekly(windows(spark, d), presence_log(spark, d), pres(spark, d)))


SWEEP = " union all ".join(f"""select '{n}' as "window", * from ({evaluate(tier_a(lo, hi))})"""
                           for n, lo, hi in cal.SWEEP)
SWEEP += f""" union all select 'global 9-17', * from ({evaluate(
    "select * replace (9.0 as open_h, 17.0 as close_h) from {wina}")})"""


@query("R5_window_sweep", f"""select "window", round(coverage, 6) as coverage,
    round(window_utilisation, 6) as window_utilisation from ({SWEEP})""")
def r5(spark, d):
    return rounded(cal.window_sweep(presence_log(spark, d), pres(spark, d), MIN_DAYS))


part("head", """select x::date as "date", count(distinct resource) as headcount from (select
    unnest(generate_series(min("date"), max("date"), interval 1 day)) as x from {ships}) s
    left join {ships} p on p."date" = s.x where isodow(x) <= 5 group by 1""")


@query("R6_headcount", """select cast("date" as varchar) as "date", headcount from {head}""")
def r6(spark, d):
    return cal.weekday_headcount(ship_log(spark, d)).withColumn("date", F.col("date").cast("string"))


@query("R7_stable_window", """with m as (select date_trunc('month', "date") as m, avg(headcount) as a
    from {head} group by 1) select cast(cast(min(m) as date) as varchar) as start,
    cast(last_day(max(m)) as varchar) as "end" from m where a >= 0.9 * (select max(a) from m)""")
def r7(spark, d):
    w = cal.stable_window(ship_log(spark, d), 0.9)
    return w.select(F.col("start").cast("string").alias("start"),
                    F.col("end").cast("string").alias("end"))


part("hols", """select "date", headcount from (select *, case when count(*) over w >= 5 then
    median(headcount) over w end as local from {head} window w as (order by "date" rows between
    10 preceding and 10 following)) where headcount < 0.7 * local""")


@query("R8_holidays", """select cast("date" as varchar) as "date", headcount from {hols}""")
def r8(spark, d):
    h = cal.discover_holidays(ship_log(spark, d), 0.7)
    return h.select(F.col("date").cast("string").alias("date"), "headcount")


@query("R9_chance_threshold", """select resource, days, cast(case when p <= 0 or p >= 1 then 5 else
    greatest(5, ceil(ln(0.5 / greatest(days * 20 * p, 1e-9)) / ln(1 - p))) end as int) as threshold
    from (select resource, days, days / 40.0::double as p from {cnt})""")
def r9(spark, d):
    c = pres(spark, d).groupBy("resource").agg(F.count(F.lit(1)).alias("days"))
    p = F.col("days") / 40.0
    return c.select("resource", "days", cal.chance_threshold(F.col("days") * 20, p).alias("threshold"))


# presence of the shipping table: every supplier, made sparser so that runs exist
part("sp", """select resource, "date", cast(isodow("date") - 1 as int) as dow, 9.0::double as "first",
    17.0::double as "last", 8.0::double as span, count(*) as n_events from {ships} group by 1, 2, 3""")
part("spocc", """select cast(isodow(x) - 1 as int) as dow, count(*) as n from (select unnest(
    generate_series(min("date"), max("date"), interval 1 day)) as x from {sp}) group by 1""")
part("spw", """select resource, dow, count(*) / any_value(n) as p_work, 9.0 as open_h, 17.0 as close_h
    from {sp} join {spocc} using (dow) group by 1, 2""")
part("spdays", """select x::date as "date", row_number() over (order by x) as i from (select unnest(
    generate_series(min("date"), max("date"), interval 1 day)) as x from {sp}) where isodow(x) <= 5
    and x::date not in (select "date" from {hols})""")
part("spten", """select resource, min("date") as lo, max("date") as hi from {sp} group by 1""")
part("spq", """select resource, sum(case when dow < 5 then p_work else 0 end) / 5 as rate from {spw}
    group by 1""")
part("sprun", """select resource, length, tenure, rate from (select t.resource, count(*) as length from
    (select *, i - row_number() over (partition by resource order by i) as island from
    (select t.resource, d.i from {spten} t join {spdays} d on d."date" between t.lo and t.hi
    where not exists (select 1 from {sp} p where p.resource = t.resource and p."date" = d."date"))) t
    group by t.resource, island) join (select resource, count(*) as tenure from {spten} t join {spdays} d
    on d."date" between t.lo and t.hi group by 1) using (resource) join {spq} using (resource)
    where tenure >= 40 and rate >= 0.05 and length >= case when rate >= 1 then 5 else greatest(5,
    ceil(ln(0.5 / greatest(tenure * rate, 1e-9)) / ln(1 - rate))) end""")


def ship_presence(spark, d):
    s = ship_log(spark, d).groupBy("resource", "date").agg(F.count(F.lit(1)).alias("n_events"))
    return staged(s.withColumns({"dow": monday_dow("date"), "first": F.lit(9.0),
                                 "last": F.lit(17.0), "span": F.lit(8.0)}))


@query("R10_absence_runs", """select resource, length, tenure, round(rate, 6) as rate from {sprun}""")
def r10(spark, d):
    p = ship_presence(spark, d)
    runs = cal.absence_runs(p, staged(cal.discover_holidays(p, 0.7)), staged(cal.fit_weekly(p, 20)),
                            min_rate=0.05)
    return rounded(runs.drop("near"))


@query("R10_leave_profiles", """select t.resource, cast(tenure as int) as tenure, round(rate, 6) as rate,
    coalesce(n, 0) as n_blocks, round(coalesce(n, 0) / greatest(covered / 365.25, 1e-9), 6) as per_year,
    round(coalesce(m, 0), 6) as mean_length from (select t.resource, count(*) as tenure,
    date_diff('day', min(d."date"), max(d."date")) as covered from {spten} t join {spdays} d on d."date"
    between t.lo and t.hi group by 1) t join {spq} using (resource) left join (select resource,
    count(*) as n, avg(length) as m from {sprun} group by 1) r using (resource)
    where tenure >= 40 and rate >= 0.05""")
def r10b(spark, d):
    p = ship_presence(spark, d)
    return rounded(cal.leave_profiles(p, staged(cal.discover_holidays(p, 0.7)),
                                      staged(cal.fit_weekly(p, 20)), min_rate=0.05))


def roster(r, day, p):
    h = f"""(cast(('0x' || substr(md5('7|' || {r} || '|' || cast({day} as varchar)), 1, 15)) as bigint)
    / 1152921504606846976.0::double)"""
    return f"(case when coalesce({p}, 0) <= 0 then false when {p} >= 1 then true else {h} < {p} end)"


@query("R11_rostered", f"""select resource, cast("date" as varchar) as "date", {roster('resource', '"date"',
    'p_work')} as rostered from {{sp}} join {{spw}} using (resource, dow)""")
def r11(spark, d):
    p = ship_presence(spark, d)
    w = cal.fit_weekly(p, 20).select("resource", "dow", "p_work")
    j = p.join(w, ["resource", "dow"])
    return j.select("resource", F.col("date").cast("string").alias("date"),
                    cal.rostered(7).alias("rostered"))


HOLS = "(date '2024-01-01', date '2024-01-15')"


def small_calendar(spark, d):
    """Holidays, leave on each resource's first day, two system accounts; the windows of two
    resources stand under other names, so that these have none."""
    log = presence_log(spark, d)
    hol = spark.range(1).select(F.explode(F.expr(
        "array(date'2024-01-01', date'2024-01-15')")).alias("date"))
    vac = log.groupBy("resource").agg(F.min(F.to_date("timestamp")).alias("date"))
    sys = spark.range(1).select(F.explode(F.array(F.lit("1-view"), F.lit("2-view"))).alias("resource"))
    w = staged(windows(spark, d, sparse=None).withColumn("resource", F.expr(
        "if(resource in ('1-view', '3-view'), concat('once-', resource), resource)")))
    return w, hol, vac, sys


part("vac", """select resource, min(cast("timestamp" as date)) as "date" from {seen} group by 1""")
part("cwin", """select * replace (case when resource in ('1-view', '3-view') then 'once-' || resource
    else resource end as resource) from {wina}""")


@query("R12_on_duty", f"""select resource, event_order, case when resource not in (select resource from
    {{cwin}}) then resource in ('1-view', '2-view') else coalesce(open_h <= h and h <= close_h, false) and
    day not in {HOLS} and (resource, day) not in (select resource, "date" from {{vac}}) and
    {roster('resource', 'day', 'p_work')} end as on_duty from (select resource, event_order,
    cast("timestamp" as date) as day, cast(isodow("timestamp") - 1 as int) as dow, {HT} as h from {{seen}})
    left join {{cwin}} using (resource, dow)""")
def r12(spark, d):
    w, hol, vac, sys = small_calendar(spark, d)
    out = cal.on_duty(presence_log(spark, d), w, hol, vac, sys, seed=7)
    return out.select("resource", "event_order", "on_duty")


S0 = "timestamp '2024-01-04 10:00:00'"
part("avail", f"""select * from (select resource, greatest(a, {S0}) as avail_start,
    least(b, {S0} + interval 14 day) as avail_end from (select resource, case when fit then day +
    to_microseconds(cast(round(open_h * 3600000000) as bigint)) else cast(day as timestamp) end as a,
    case when fit then day + to_microseconds(cast(round(close_h * 3600000000) as bigint)) else
    day + interval 1 day end as b from (select r.resource, x::date as day, open_h, close_h, p_work,
    r.resource in (select resource from {{cwin}}) as fit from (select distinct resource from {{seen}}) r
    cross join (select unnest(generate_series(date '2024-01-04', date '2024-01-18', interval 1 day)) as x)
    left join {{cwin}} w on w.resource = r.resource and w.dow = isodow(x) - 1) where
    (not fit and resource in ('1-view', '2-view')) or (fit and open_h is not null and day not in {HOLS} and
    (resource, day) not in (select resource, "date" from {{vac}}) and {roster('resource', 'day', 'p_work')})))
    where avail_end > avail_start""")


def horizon(spark, d):
    log = presence_log(spark, d)
    return cal.availability(log, *small_calendar(spark, d), "2024-01-04 10:00:00", 14, seed=7)


@query("R13_availability", """select resource, epoch_us(avail_start) as start_us, epoch_us(avail_end)
    as end_us from {avail}""")
def r13(spark, d):
    return horizon(spark, d).select("resource", micros("avail_start").alias("start_us"),
                                    micros("avail_end").alias("end_us"))


@query("R14_availability_seconds", f"""select resource, round(coalesce(sum({secs('avail_start',
    'avail_end')}), 0), 3) as seconds from (select distinct resource from {{seen}}) left join {{avail}}
    using (resource) group by 1""")
def r14(spark, d):
    return rounded(cal.availability_seconds(presence_log(spark, d), horizon(spark, d)), 3)


@query("R15_dst_probe", """with r as (select 'UTC' as read_as, ts as t from shifted union all
    select 'local', timezone('Europe/Amsterdam', timezone('UTC', ts)) from shifted), q as (select read_as,
    quantile_cont(h, 0.05) filter (m in (11, 12, 1, 2)) as winter, quantile_cont(h, 0.05) filter
    (m in (5, 6, 7, 8)) as summer from (select read_as, month(t) as m, hour(t) + minute(t) / 60.0::double
    as h from r) group by 1), shifted as (select "timestamp" + to_days(cast(event_order % 365 as int)) as ts
    from {seen}) select read_as, round(winter, 6) as winter, round(summer, 6) as summer,
    round(abs(winter - summer), 6) as shift from q""".replace(
        "with r as", "with shifted as (select \"timestamp\" + to_days(cast(event_order % 365 as int)) as ts "
        "from {seen}), r as").replace(""", shifted as (select "timestamp" + to_days(cast(event_order % 365 as int)) as ts
    from {seen}) select""", " select"))
def r15(spark, d):
    log = presence_log(spark, d).withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(
        days=(F.col("event_order") % 365).cast("int")))       # spread over a year
    return rounded(cal.dst_probe(log))


@query("R16_parity_test", """with c as (select resource, dow, f, 'week' as split, week("date") % 2 as side
    from sp2 union all select resource, dow, f, 'null', cast('0x' || substr(md5('0|' || resource || '|' ||
    cast("date" as varchar)), 1, 8) as bigint) % 2 from sp2), m as (select split, resource, dow, side,
    median(f) as m, count(*) as n from c group by all), p as (select split, resource, dow,
    max(m) - min(m) as shift from m where n >= 5 group by all having count(*) = 2)
    select split, count(*) as n_cells, round(avg(case when shift > 1 then 1.0 else 0.0 end), 6)
    as share_over_1h, round(median(shift), 6) as median_shift from p group by 1""".replace(
        "with c as", """with sp2 as (select *, (n_events * 7 + day("date")) % 24 + 0.5::double as f from {sp}
    where resource in (select resource from {sp} group by 1 having count(*) >= 40)), c as"""))
def r16(spark, d):
    p = ship_presence(spark, d).withColumn(
        "first", ((F.col("n_events") * 7 + F.dayofmonth("date")) % 24) + 0.5)
    return rounded(cal.parity_test(p))


@query("R17_roster_headcount", f"""with c as (select "date", cast(isodow("date") - 1 as int) as dow
    from {{spdays}}), s as (select c."date", count(w.resource) as n from c left join {{spw}} w on
    w.dow = c.dow and {roster('w.resource', 'c."date"', 'w.p_work')} group by 1), r as (select
    avg(headcount) as real_mean, stddev_samp(headcount) as real_sd from {{head}} where headcount > 0)
    select round(real_mean, 6) as real_mean, round(real_sd, 6) as real_sd, round((select avg(n) from s), 6)
    as model_mean, round((select stddev_samp(n) from s), 6) as model_sd, round(abs((select avg(n) from s)
    - real_mean) / real_mean, 6) as relative_error from r""")
def r17(spark, d):
    p = ship_presence(spark, d)
    return rounded(cal.roster_headcount_error(p, cal.fit_weekly(p, 20),
                                              cal.discover_holidays(p, 0.7), seed=7))


@query("R18_extra_presence", """select distinct case_id as resource, cast(cast("timestamp" as date)
    as varchar) as "date" from {lc} where lifecycle = 'schedule' except select case_id,
    cast(cast("timestamp" as date) as varchar) from {lc} where lifecycle <> 'schedule'""")
def r18(spark, d):
    log = lifecycle_log(spark, d).withColumn("resource", F.col("case_id"))
    return cal.extra_presence(log).withColumn("date", F.col("date").cast("string"))


part("mem", "select resource, cast(cast(split_part(resource, '-', 1) as int) % 7 as int) as grp from {cnt}")


def members(p):
    return p.select("resource").distinct().withColumn(
        "grp", (F.split_part("resource", F.lit("-"), F.lit(1)).cast("int") % 7).cast("int"))


part("tiers", f"""select grp, m.resource, active_days, events, span_days, events / active_days as per_day,
    case when m.resource in ('1-view', '2-view') then 'C' when active_days >= {MIN_DAYS + 3} then 'A' else 'B' end as tier
    from {{mem}} m left join (select resource, count(distinct "date") as active_days,
    cast(sum(n_events) as bigint) as events, date_diff('day', min("date"), max("date")) + 1 as span_days
    from {{pres}} group by 1) using (resource)""")


def tiers(spark, d):
    p = pres(spark, d)
    sys = spark.range(1).select(F.explode(F.array(F.lit("1-view"), F.lit("2-view"))).alias("resource"))
    return cal.tier_membership(p, members(p), sys, MIN_DAYS + 3)


@query("R19_tier_membership", """select grp, resource, active_days, events, span_days,
    round(per_day, 6) as per_day, tier from {tiers}""")
def r19(spark, d):
    return rounded(tiers(spark, d).withColumn("span_days", F.col("span_days").cast("bigint")))


@query("R19_tiers_by_group", """select grp, count(*) filter (tier = 'A') as "A", count(*) filter (tier = 'B')
    as "B", count(*) filter (tier = 'C') as "C" from {tiers} group by 1""")
def r19b(spark, d):
    return cal.tiers_by_group(tiers(spark, d))


@query("R19_group_clocks", """select grp, round(median("first"), 6) as opens, round(median("last"), 6) as closes
    from {pres} join {mem} using (resource) group by 1""")
def r19c(spark, d):
    p = pres(spark, d)
    return rounded(cal.group_clocks(p, members(p)))
