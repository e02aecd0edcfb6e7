"""X: statistics over result tables (and J11)."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import experiments as ex
from .base import part, query, scratch, table

# three "policies" and ten "seeds" from the order lines
NAMES = "case l_returnflag when 'A' then 'random' when 'N' then 'kbatch5' else 'piled' end"
part("runs", f"""select {NAMES} as policy, cast(l_suppkey % 10 as int) as seed, 'normal' as scenario,
    avg(l_extendedprice) as cycle, avg(l_discount) as share, count(*)::double as done from lineitem group by all""")
M = ["cycle", "share", "done"]
part("long", "unpivot (select policy, seed, cycle, share, done from {runs}) on cycle, share, done "
             "into name metric value v")
T9 = 2.2621571627409915     # Student quantile, 9 degrees of freedom


def all_runs(spark, d, scenario=None):
    """A row per policy, seed and scenario; ``scenario`` names one that all lines count for."""
    li = table(spark, d, "lineitem")
    p = F.when(F.col("l_returnflag") == "A", "random").when(
        F.col("l_returnflag") == "N", "kbatch5").otherwise("piled")
    return li.groupBy(p.alias("policy"), (F.col("l_suppkey") % 10).cast("int").alias("seed"),
                      F.lit(scenario).alias("scenario") if scenario else
                      F.when(F.col("l_linestatus") == "F", "normal").otherwise("peak").alias("scenario")).agg(
        F.avg("l_extendedprice").alias("cycle"), F.avg("l_discount").alias("share"),
        F.count(F.lit(1)).cast("double").alias("done"))


def runs(spark, d):
    return all_runs(spark, d, "normal")


@query("X1_flatten", """select policy, seed, round(cycle, 4) as metrics_time_cycle, round(share, 6) as metrics_share,
    '["a","b"]' as config_list from {runs}""")
def x1(spark, d):
    nested = runs(spark, d).select(
        "policy", "seed", F.struct(F.struct("cycle").alias("time"), "share").alias("metrics"),
        F.struct(F.array(F.lit("a"), F.lit("b")).alias("list")).alias("config"))
    return rounded(ex.flatten(nested), 6, metrics_time_cycle=4)


@query("X2_mean_interval", f"""select policy, metric, count(*) as n, round(avg(v), 4) as mean, round(stddev_samp(v), 4)
    as sd, round(stddev_samp(v) / sqrt(count(*)) * {T9}, 4) as half_width, round(stddev_samp(v) / sqrt(count(*))
    * {T9} / abs(avg(v)), 6) as rel_width, stddev_samp(v) / sqrt(count(*)) * {T9} / abs(avg(v)) > 0.05 as loose
    from {{long}} group by 1, 2""")
def x2(spark, d):
    return rounded(ex.mean_interval(runs(spark, d), ["policy"], M), 4, rel_width=6)


part("paired", """select a.policy, a.seed, a.metric, b.v as base, a.v as value, a.v - b.v as d from {long} a
    join {long} b on a.seed = b.seed and a.metric = b.metric and b.policy = 'random'
    where a.policy <> 'random'""")


@query("J11_paired_by_seed", """select policy, seed, metric, round(base, 4) as base, round(value, 4) as value
    from {paired}""")
def j11(spark, d):
    return rounded(ex.paired_by_seed(runs(spark, d), M, "random"), 4)


# p-value for 9 degrees of freedom: the finite series for odd degrees
P9 = """(1 - 2 / pi() * (atan(abs(t) / 3) + sin(atan(abs(t) / 3)) * (cos(atan(abs(t) / 3)) + 2 / 3 * cos(atan(abs(t) / 3))
    ** 3 + 8 / 15 * cos(atan(abs(t) / 3)) ** 5 + 48 / 105 * cos(atan(abs(t) / 3)) ** 7)))"""


@query("X3_paired_tests", f"""select policy, metric, n as n_paired_seeds, round(m, 4) as mean_delta, round(t, 4) as t_stat,
    round({P9}, 6) as p_value from (select policy, metric, count(*) as n, avg(d) as m, avg(d) / (stddev_samp(d) /
    sqrt(count(*))) as t from {{paired}} group by 1, 2)""")
def x3(spark, d):
    return rounded(ex.paired_tests(runs(spark, d), M), 4, p_value=6)


@query("X4_paired_deltas", f"""select policy, metric, count(*) as n_pairs, round(avg(d), 4) as delta, round(stddev_samp(d)
    / sqrt(count(*)) * {T9}, 4) as half_width from {{paired}} group by 1, 2""")
def x4(spark, d):
    return rounded(ex.paired_deltas(runs(spark, d), M), 4)


@query("X5_summarize", f"""select seed % 2 as grp, metric, count(*) as n_replications, round(avg(v), 4) as mean,
    round(stddev_samp(v) / sqrt(count(*)) * 2.1447866879169273, 4) as half_width from {{long}} group by 1, 2""")
def x5(spark, d):
    return rounded(ex.summarize(runs(spark, d).withColumn("grp", F.col("seed") % 2), "grp", M), 4)


@query("X6_relative_impact", """select a.policy, a.metric, round((a.m / b.m - 1) * 100, 4) as impact_pct from (select policy,
    metric, avg(v) as m from {long} group by 1, 2) a join (select metric, avg(v) as m from {long} where policy = 'random'
    group by 1) b using (metric) where policy <> 'random'""")
def x6(spark, d):
    s = runs(spark, d).groupBy("policy").agg(*[F.avg(m).alias(m) for m in M])
    return rounded(ex.relative_impact(s, "policy", "random", M), 4)


@query("X7_policy_order", """select policy, cast(row_number() over (order by case policy when 'random' then 0 when 'piled' then 1
    when 'kbatch5' then 2 when 'kbatch10' then 3 when 'kbatch20' then 4 else 5 end, policy) as int) as place from (select distinct
    case l_suppkey % 6 when 0 then 'random' when 1 then 'piled' when 2 then 'kbatch20' when 3 then 'kbatch5' when 4
    then 'kbatch10' else 'drl' end as policy from lineitem)""")
def x7(spark, d):
    names = F.array(*[F.lit(x) for x in ("random", "piled", "kbatch20", "kbatch5", "kbatch10", "drl")])
    p = table(spark, d, "lineitem").select(names[(F.col("l_suppkey") % 6).cast("int")].alias("policy"))
    return ex.ordered_policies(p)


@query("X7_scenario_means", f"""with r as (select {NAMES} as policy, l_suppkey % 10 as seed, case when l_linestatus = 'F'
    then 'normal' else 'peak' end as scenario, avg(l_extendedprice) as cycle from lineitem group by all)
    select policy, round(coalesce(avg(cycle) filter (scenario = 'normal'), 0), 4) as normal, round(coalesce(avg(cycle)
    filter (scenario = 'peak'), 0), 4) as peak, 0.0::double as crisis from r group by 1""")
def x7b(spark, d):
    return rounded(ex.scenario_means(all_runs(spark, d), "cycle", ["normal", "peak", "crisis"]), 4)


@query("X8_inconsistent_seeds", """select cast(l_suppkey % 10 as int) as seed, 'priority' as "column", count(distinct
    o_orderpriority) as n_values from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def x8(spark, d):
    j = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 10).cast("int").alias("seed")).join(
        table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority")),
        F.col("l_orderkey") == F.col("o_orderkey"))
    return ex.inconsistent_seeds(j.withColumn("roster", F.col("seed") + 1), ["priority", "roster"])


@query("X9_ranking", """select policy, 'all' as pool, cast(row_number() over (order by avg(cycle), sum(done) desc) as int)
    as place from {runs} group by 1 union all select policy, 'verified', cast(row_number() over (order by avg(cycle),
    sum(done) desc) as int) from {runs} where policy <> 'kbatch5' group by 1""")
def x9(spark, d):
    s = runs(spark, d).groupBy("policy").agg(F.avg("cycle").alias("cycle"), F.sum("done").alias("done"))
    a = ex.ranking(s, "cycle", "done").withColumn("pool", F.lit("all"))
    b = ex.ranking(s, "cycle", "done", ["kbatch5"]).withColumn("pool", F.lit("verified"))
    return a.unionByName(b).select("policy", "pool", "place")


@query("X10_failing_rows", """select policy, seed, broken from (select policy, seed, unnest([case when done <= 250 then
    'enough_done' end, case when not (share between 0 and 0.05) then 'share_range' end, 'queue_known']) as broken from {runs})
    where broken is not null union all select policy, seed, unnest(['enough_done', 'share_range']) from {runs}""")
def x10(spark, d):
    a = runs(spark, d).select("policy", "seed", "share", "done")
    b = runs(spark, d).select("policy", "seed", F.lit(1).alias("queued"))
    u = ex.union_results(a, b)
    return ex.failing_rows(u, {"enough_done": "done > 250", "share_range": "share between 0 and 0.05",
                               "queue_known": "queued >= 0"}).select("policy", "seed", "broken")


@query("X11_mode_table", """with m as (select policy as mode, cast(sum(done) as bigint) as completed_cases, avg(share) as e
    from {runs} group by 1) select mode, completed_cases, 0.995::double as completion_share, round(e, 6) as
    processing_time_error, round(e / 2, 6) as suspend_count_mae, round(e * 2, 6) as same_resource_rate, round(e * 3, 6)
    as case_duration_error, round(e / 4, 6) as branching_mean_tvd, e = (select min(e) from m) as best from m""")
def x11(spark, d):
    e = F.col("e")
    m = runs(spark, d).groupBy(F.col("policy").alias("mode")).agg(
        F.sum("done").cast("bigint").alias("n"), F.avg("share").alias("e"))
    doc = m.select("mode", F.struct(F.col("n").alias("completed_cases"), F.lit(0.995).alias("completion_share"))
                   .alias("configuration"), F.struct(
        F.struct(e.alias("mean_rel_err")).alias("processing_times"),
        F.struct((e * 3).alias("case_duration_rel_err")).alias("case_stats"),
        F.struct((e / 4).alias("mean_tvd")).alias("branching"),
        F.struct(F.struct((e / 2).alias("mean_abs_error")).alias("suspend_counts")).alias("lifecycle"))
        .alias("general_metrics"),
        F.struct(F.struct((e * 2).alias("same_resource_rate")).alias("resume_ownership")).alias("lifecycle"))
    path = scratch(spark) + ".json"
    doc.write.json(path)
    return rounded(ex.mode_table(spark, path))
