"""F: distribution fitting, with the same likelihood equations written out in SQL."""

import math

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import fit, pairing, stats
from .base import lifecycle_log, orders_log, part, query, simple_log, table
from .stats import day_cases


def _digamma(x):
    y = f"({x} + 8)"
    t = (f"ln({y}) - 0.5/{y} - 1/(12*{y}**2) + 1/(120*{y}**4) - 1/(252*{y}**6) "
         f"+ 1/(240*{y}**8) - 1/(132*{y}**10)")
    return "(" + t + "".join(f" - 1/({x} + {i})" for i in range(8)) + ")"


def _trigamma(x):
    y = f"({x} + 8)"
    t = (f"1/{y} + 0.5/{y}**2 + 1/(6*{y}**3) - 1/(30*{y}**5) + 1/(42*{y}**7) "
         f"- 1/(30*{y}**9) + 5/(66*{y}**11)")
    return "(" + t + "".join(f" + 1/({x} + {i})**2" for i in range(8)) + ")"


def fit_parts(name: str, source: str, keys: list[str], value: str):
    """Register CTEs ``{name}_sums`` and ``{name}_best`` for the positive values of a source."""
    k = ", ".join(keys) if keys else "0"
    kk = (k + ", ") if keys else "0 as g0, "
    using = f"using ({', '.join(keys) if keys else 'g0'})"
    group = f"group by {k}" if keys else ""
    part(f"{name}_v", f"""select {kk}cast({value} as double) as x from {source}
        where {value} > 0""")
    ks = (k + ", ") if keys else "g0, "
    part(f"{name}_sums", f"""select {ks}count(*) as n, avg(x) as mean_s, stddev_pop(x) as std_s,
        avg(x * x) as m2, avg(ln(x)) as l, stddev_pop(ln(x)) as sl from {{{name}_v}}
        group by {ks.rstrip(', ')}""")
    part(f"{name}_g0", f"""select *, (3 - g + sqrt((g - 3) ** 2 + 24 * g)) / (12 * g) as a from
        (select *, case when ln(mean_s) - l > 1e-12 then ln(mean_s) - l end as g
        from {{{name}_sums}})""")
    for i in range(8):
        part(f"{name}_g{i + 1}", f"""select * exclude (a), 1 / (1 / a + (ln(a) - {_digamma('a')} - g)
            / (a * a * (1 / a - {_trigamma('a')}))) as a from {{{name}_g{i}}}""")
    part(f"{name}_c0", f"""select *, case when sl > 1e-12 then {math.pi / math.sqrt(6)!r} / sl end as c
        from {{{name}_g8}}""")
    body = f"""select {ks}max(c) as oc, sum(exp(c * (ln(x) - l))) as w0, sum(exp(c * (ln(x) - l))
        * (ln(x) - l)) as w1, sum(exp(c * (ln(x) - l)) * (ln(x) - l) ** 2) as w2 from
        {{{name}_v}} join {{{name}_c%d}} {using} group by {ks.rstrip(', ')}"""
    for i in range(6):
        part(f"{name}_c{i + 1}", f"""select p.* exclude (c), oc - (w1 / w0 - 1 / oc) / (w2 / w0 -
            (w1 / w0) ** 2 + 1 / oc ** 2) as c from {{{name}_c{i}}} p join ({body % i}) {using}""")
    part(f"{name}_aic", f"""select p.*, 4 + 2 * (n * ln(mean_s) + n) as a1,
        4 + n * (ln(2 * pi() * m2) + 1) as a2,
        case when sl > 1e-12 then 6 + 2 * n * l + n * (ln(2 * pi() * sl * sl) + 1) end as a3,
        6 - 2 * ((a - 1) * n * l - n * a - n * a * ln(mean_s / a) - n * lgamma(a)) as a4,
        6 - 2 * (n * ln(c) - n * c * ln(sc) + (c - 1) * n * l - n) as a5
        from (select p.*, exp(l) * (w0 / n) ** (1 / c) as sc from {{{name}_c6}} p join
        ({body % 6}) {using}) p""")
    part(f"{name}_best", f"""select {ks}n, mean_s, std_s, distribution,
        case distribution when 'lognorm' then sl when 'gamma' then a when 'weibull_min' then c end
        as shape, case distribution when 'expon' then mean_s when 'norm' then sqrt(m2)
        when 'lognorm' then exp(l) when 'gamma' then mean_s / a else sc end as scale
        from (select *, case when n < 5 then 'expon'
        when a1 <= least(a1, a2, a3, a4, a5) then 'expon' when a2 <= least(a1, a2, a3, a4, a5)
        then 'norm' when a3 <= least(a1, a2, a3, a4, a5) then 'lognorm'
        when a4 <= least(a1, a2, a3, a4, a5) then 'gamma' else 'weibull_min' end as distribution
        from {{{name}_aic}})""")


BEST = """select {k}, n, distribution, round(shape, 4) as shape, round(scale, 3) as scale,
    round(mean_s, 3) as mean_s, round(std_s, 3) as std_s from {{{name}_best}}"""


def shown(fits, extra=()):
    """Fits with shape and scale as plain columns."""
    shape = F.when(F.size("params") > 2, F.col("params")[0])
    keep = [c for c in fits.columns if c != "params"]
    return rounded(fits.select(*keep, shape.alias("shape"),
                               F.try_element_at("params", F.lit(-1)).alias("scale")), 3, shape=4)


fit_parts("ptimes", "{pairs}", ["activity"], "duration_s")
fit_parts("prices", "{olog}", ["application_type"], "requested_amount")


@query("F1_closed_form_fits", """select application_type, n, round(mean_s, 3) as expon_scale,
    round(sqrt(m2), 3) as norm_scale, round(sl, 6) as lognorm_shape, round(exp(l), 3) as lognorm_scale,
    round(a1, 2) as expon_aic, round(a2, 2) as norm_aic, round(a3, 2) as lognorm_aic
    from {prices_aic}""")
def f1a(spark, d):
    s = fit.closed_forms(fit.sums(orders_log(spark, d), ["application_type"], "requested_amount"))
    return rounded(s.select(
        "application_type", "n", F.col("mean_s").alias("expon_scale"), "norm_scale",
        "lognorm_shape", "lognorm_scale", "expon_aic", "norm_aic", "lognorm_aic"),
        3, lognorm_shape=6, expon_aic=2, norm_aic=2, lognorm_aic=2)


@query("F1_best_fit", BEST.format(k="activity", name="ptimes"))
def f1b(spark, d):
    p = pairing.processing_times(lifecycle_log(spark, d))
    return shown(fit.best_fit(p, ["activity"], "duration_s"))


@query("F1_best_fit_prices", BEST.format(k="application_type", name="prices"))
def f1c(spark, d):
    return shown(fit.best_fit(orders_log(spark, d), ["application_type"], "requested_amount"))


part("shipdelay", """select l_returnflag as activity, greatest(0, date_diff('day', o_orderdate,
    l_shipdate)) * 86400.0::double as delay_s from lineitem join orders on l_orderkey = o_orderkey""")
fit_parts("sdelay", "{shipdelay}", ["activity"], "delay_s")


def ship_delays(spark, d):
    """Order-to-ship delay in seconds, negative ones clamped to 0."""
    j = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag").join(
        table(spark, d, "orders").select("o_orderkey", "o_orderdate"),
        F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.greatest(F.lit(0), F.date_diff("l_shipdate", "o_orderdate"))
    return j.select(F.col("l_returnflag").alias("activity"), (days * 86400.0).alias("delay_s"))


DELAY = """select {k}, count(*) as n_delays, round(avg(case when {v} = 0 then 1.0 else 0.0 end), 6)
    as zero_prob, round(avg({v}), 3) as overall_mean_s, round(quantile_cont({v}, 0.99), 3) as p99_s,
    coalesce(any_value(b.n), 0) as n, coalesce(any_value(b.distribution), 'expon') as distribution,
    round(any_value(b.shape), 4) as shape, round(coalesce(any_value(b.scale), 0), 3) as scale,
    round(coalesce(any_value(b.mean_s), 0), 3) as mean_s,
    round(coalesce(any_value(b.std_s), 0), 3) as std_s
    from {src} left join {{{name}_best}} b using ({u}) where {v} >= 0 group by {k}"""


@query("F2_delay_fit", DELAY.format(k="activity", u="activity", v="delay_s", src="{shipdelay}",
                                    name="sdelay"))
def f2(spark, d):
    return _delay_shown(fit.delay_fit(ship_delays(spark, d), ["activity"], "delay_s"))


def _delay_shown(fits):
    shape = F.when(F.size("params") > 2, F.col("params")[0])
    keep = [c for c in fits.columns if c != "params"]
    return rounded(fits.select(*keep, shape.alias("shape"),
                               F.try_element_at("params", F.lit(-1)).alias("scale")),
                   3, shape=4, zero_prob=6)


MEANS = """select activity, distribution, round(case distribution when 'lognorm' then
    greatest(1, scale * exp(0.5 * shape * shape)) when 'gamma' then greatest(1, scale * shape)
    when 'weibull_min' then greatest(1, scale * gamma(1 + 1 / shape)) else 600.0 end, 2) as expected_s
    from {ptimes_best}"""


@query("F3_analytic_mean", MEANS)
def f3(spark, d):
    p = pairing.processing_times(lifecycle_log(spark, d))
    m = fit.analytic_mean(fit.best_fit(p, ["activity"], "duration_s"))
    return rounded(m.select("activity", "distribution", "expected_s"), 2)


@query("F4_analytic_p99", """select activity, distribution, round(case distribution
    when 'expon' then scale * -ln(0.01) when 'lognorm' then scale * exp(shape * 2.326347874)
    when 'weibull_min' then scale * (-ln(0.01)) ** (1 / shape) when 'norm' then scale * 2.326347874
    else 0.0 end, 1) as fit_p99_s from {ptimes_best}""")
def f4(spark, d):
    p = pairing.processing_times(lifecycle_log(spark, d))
    m = fit.analytic_p99(fit.best_fit(p, ["activity"], "duration_s"))
    return rounded(m.select("activity", "distribution", "fit_p99_s"), 1)


part("iat_a", """select date_diff('microsecond', p, t) / 1e6 as gap_s from (select t, lag(t) over
    (order by t) as p from (select distinct "timestamp" as t from {simple} where activity not in ('purchase', 'view')))
    where p is not null""")
part("iat_b", """select date_diff('microsecond', p, t) / 1e6 as gap_s from (select t, lag(t) over
    (order by t) as p from (select distinct "timestamp" as t from {simple} where
    activity in ('purchase', 'view'))) where p is not null""")


@query("F6_two_sample_ks", """with u as (select gap_s as v, 1 as a, 0 as b from {iat_a} union all
    select gap_s, 0, 1 from {iat_b}), c as (select v, sum(a) as a, sum(b) as b from u group by v),
    r as (select sum(a) over (order by v) as ca, sum(b) over (order by v) as cb from c),
    n as (select (select count(*) from {iat_a}) as na, (select count(*) from {iat_b}) as nb),
    s as (select max(abs(ca / na - cb / nb)) as statistic, any_value(na) as n_a, any_value(nb) as n_b
    from r, n)
    select round(statistic, 6) as statistic, n_a, n_b, round(least(1.0, greatest(0.0, 2 * (select
    sum((case when k % 2 = 1 then 1.0 else -1.0 end) * exp(-2.0 * k * k * (n_a * n_b / (n_a + n_b))
    * statistic ** 2)) from range(1, 61) t(k)))), 6) as p_value from s""")
def f6(spark, d):
    log = simple_log(spark, d)
    a = log.filter("activity not in ('purchase', 'view')").select(F.col("timestamp").alias("arrival"))
    b = log.filter("activity in ('purchase', 'view')").select(F.col("timestamp").alias("arrival"))
    return rounded(fit.two_sample_ks(stats.arrival_gaps(a), stats.arrival_gaps(b), "gap_s", "asymptotic")
                   .drop("method"))


@query("F6_exact_ks")
def f6b(spark, d):
    """The same two samples; the p-value is exact up to 10,000 values each, see ``method``."""
    log = simple_log(spark, d)
    a = log.filter("activity not in ('purchase', 'view')").select(F.col("timestamp").alias("arrival"))
    b = log.filter("activity in ('purchase', 'view')").select(F.col("timestamp").alias("arrival"))
    return rounded(fit.two_sample_ks(stats.arrival_gaps(a), stats.arrival_gaps(b), "gap_s"), 12)


fit_parts("gapfit", "{gaps}", [], "gap_s")
fit_parts("waitfit", "{waits}", ["activity"], "wait_s")
FITTED = """n, distribution, round(shape, 4) as shape, round(scale, 3) as scale, round(mean_s, 3) as mean_s,
    round(std_s, 3) as std_s"""


@query("A3_arrival_fit", f"select {FITTED} from {{gapfit_best}}")
def a3_fit(spark, d):
    """The best of five families for the gaps between arrivals."""
    return shown(fit.best_fit(stats.arrival_gaps(stats.case_arrivals(day_cases(spark, d))), [], "gap_s"))


@query("L8_withdraw_wait_fit", f"select activity, {FITTED} from {{waitfit_best}}")
def l8_fit(spark, d):
    """The best of five families for the waits before a withdrawal, by activity."""
    from ..operators import lifecycle
    from .lifecycle import seg
    return shown(fit.best_fit(lifecycle.withdraw_waits(seg(spark, d)), ["activity"], "wait_s"))


@query("F7_profile_mae", """with o as (select min("timestamp") as arrival from {simple}
    group by case_id, cast("timestamp" as date), activity = 'view'), q as
    (select p.profile, p.slot, count(o.arrival) / sum(count(o.arrival)) over (partition by p.profile)
    as y from (select distinct profile, slot from {profile}) p left join o on
    (p.profile = 'hod' and hour(arrival) = slot) or (p.profile = 'dow' and isodow(arrival) - 1 = slot)
    group by 1, 2)
    select profile, round(avg(abs(share - y)), 6) as mae from {profile} join q using (profile, slot)
    group by 1""")
def f7(spark, d):
    a = stats.case_arrivals(day_cases(spark, d))
    b = stats.case_arrivals(day_cases(spark, d).withColumn("case_id", F.concat(
        "case_id", (F.col("activity") == "view").cast("string"))))
    return rounded(fit.profile_mae(a, b))


part("disc", """select l_returnflag as activity, l_discount * 100 as v from lineitem""")
fit_parts("discf", "{disc}", ["activity"], "v")


@query("A13_zero_mass_fit", """select activity, round(avg(case when v = 0 then 1.0 else 0.0 end), 6)
    as zero_prob, any_value(b.n) as n, any_value(b.distribution) as distribution,
    round(any_value(b.shape), 4) as shape, round(any_value(b.scale), 3) as scale,
    round(any_value(b.mean_s), 3) as mean_s, round(any_value(b.std_s), 3) as std_s
    from {disc} join {discf_best} b using (activity) group by 1""")
def a13(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("activity"),
                                           (F.col("l_discount") * 100).alias("v"))
    return _delay_shown(fit.zero_mass_fit(v, ["activity"], "v"))
