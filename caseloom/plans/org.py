"""O: permissions and organisation mining (and J9, J10, J13)."""

import re

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.staging import staged
from ..operators import org
from .base import part as _part, query as _query, simple_log


def _quoted(sql):
    """``at`` is a reserved word in DuckDB."""
    return sql and re.sub(r'(?<![\w"])at(?![\w"])', '"at"', sql)


def part(name, sql):
    _part(name, _quoted(sql))


def query(name, sql=None):
    return _query(name, _quoted(sql))


ACTS = ("click", "error", "purchase", "signup", "view")


def el(spark, d):
    """The event log with a loan goal per case; some work goes to the next resource, so that
    some resources never do it."""
    log = simple_log(spark, d).withColumn("goal", F.concat(
        F.lit("g"), (F.col("case_id").cast("int") % 3).cast("string")))
    r = F.substring("resource", 2, 2).cast("int")
    passed = (F.length("activity") % 4 == r % 4) & (F.col("case_id") != "5")
    return log.withColumn("resource", F.concat(F.lit("R"), ((r + passed.cast("int")) % 20).cast("string")))


part("el", """select * replace ('R' || r as resource) from (select *, 'g' || (cast(case_id as int) % 3) as goal,
    (cast(resource[2:] as int) + case when length(activity) % 4 = cast(resource[2:] as int) % 4 and
    case_id <> '5' then 1 else 0 end) % 20 as r from {simple})""")
# groups: resource number mod 4, and an overlapping group 9 of the first five
part("members", """select cast(r % 4 as int) as grp, 'R' || r as resource from range(20) t(r)
    union all select 9, 'R' || r from range(5) t(r)""")
part("dmembers", "select * from {members} where grp < 9")


def members(spark, d, overlap=True):
    r = staged(simple_log(spark, d).select("resource").distinct())
    n = F.substring("resource", 2, 2).cast("int")
    m = r.select((n % 4).alias("grp"), "resource")
    if overlap:
        m = m.unionByName(r.filter(n < 5).select(F.lit(9).alias("grp"), "resource"))
    return m


part("pc", "select resource, activity, count(*) as n from {el} group by 1, 2")
part("rl", """select 'CT.' || goal as ct, 'AT.' || activity as at, 'TT.' || dayname("timestamp") as tt,
    resource, case_id from {el}""")


def rlog(spark, d):
    return org.resource_log(el(spark, d), "attribute", "goal")


part("cc", "select ct, at, tt, resource, count(*) as n from {rl} group by 1, 2, 3, 4")
part("recall", "select distinct grp, ct, at, tt from {cc} join {members} using (resource)")


@query("O1_permission_matrix", "select resource, " + ", ".join(
    f"count(*) filter (activity = '{a}') > 0 as {a}" for a in ACTS) + " from {el} group by 1")
def o1(spark, d):
    return org.permission_matrix(el(spark, d), ACTS)


@query("O2_matrix_density", """select count(distinct resource) as n_resources, count(distinct activity)
    as n_activities, count(*) as granted, round(avg(case when n <= 1 then 1.0 else 0 end), 6) as share_at_most_1,
    round(avg(case when n <= 5 then 1.0 else 0 end), 6) as share_at_most_5, round(avg(case when n <= 10 then
    1.0 else 0 end), 6) as share_at_most_10, round(count(*) / (count(distinct resource) * count(distinct
    activity)), 6) as density from {pc}""")
def o2(spark, d):
    return rounded(org.matrix_density(el(spark, d)))


part("cut", """select quantile_cont(epoch_us("timestamp")::double, 0.7) as c from {el}""")
part("held", """select resource, activity, count(*) filter (epoch_us("timestamp") <= c) as early,
    count(*) filter (epoch_us("timestamp") > c) as later from {el}, {cut} group by 1, 2""")


@query("O3_holdout_gap", """select cast(sum(later) as bigint) as test_events, cast(coalesce(sum(later) filter
    (early = 0), 0) as bigint) as forbidden_events, count(*) filter (early = 0) as forbidden_pairs,
    round(coalesce(sum(later) filter (early = 0), 0) / sum(later), 6) as forbidden_rate from {held} where later > 0
    and resource in (select resource from {held} group by 1 having sum(early) > 0)""")
def o3(spark, d):
    return rounded(org.holdout_gap(el(spark, d)))


@query("J13_holdout_pairs", """select resource, activity, later from {held} where later > 0 and early = 0
    and resource in (select resource from {held} group by 1 having sum(early) > 0)""")
def j13(spark, d):
    from ..functions.quantiles import quantiles
    e = el(spark, d).withColumn("t", F.unix_micros(F.col("timestamp").cast("timestamp")).cast("double"))
    cut = quantiles(e, [], "t", {"q": 0.7}).scalar()
    e = e.withColumn("late", F.col("t") > cut)
    train, test = e.filter("not late"), e.filter("late")
    known = test.join(train.select("resource").distinct(), "resource", "left_semi")
    unseen = known.groupBy("resource", "activity").agg(F.count(F.lit(1)).alias("later")).join(
        train.select("resource", "activity").distinct(), ["resource", "activity"], "left_anti")
    return unseen


@query("O4_resource_log", """select ct as case_type, at as activity_type, tt as time_type, resource,
    count(*) as n from {rl} group by 1, 2, 3, 4 union all select '', at, '', resource, count(*)
    from {rl} group by 2, 4""")
def o4(spark, d):
    both = rlog(spark, d).unionByName(org.resource_log(el(spark, d), "activity"))
    return org.context_counts(both)


@query("O5_case_profiles", """with n as (select count(distinct case_id) as n from {simple}), t as (select case_id,
    activity, count(*) as tf from {simple} group by 1, 2), i as (select activity, ln((n + 1) / (count(*) + 1))
    + 1 as idf from t, n group by activity, n), w as (select case_id, activity, tf * idf as w from t join i
    using (activity)) select case_id, activity, round(w / sqrt(sum(w * w) over (partition by case_id)), 6)
    as weight from w""")
def o5(spark, d):
    return rounded(org.case_profiles(simple_log(spark, d)))


@query("O5_trace_clusters")
def o5b(spark, d):
    c = org.trace_clusters(simple_log(spark, d), k=5)
    return c.groupBy("cluster").agg(F.count(F.lit(1)).alias("cases"))


@query("O5_profile_clusters")
def o5c(spark, d):
    """Cluster of every case by spherical k-means on its profile."""
    return org.profile_clusters(simple_log(spark, d), k=5)


@query("O6_resource_profiles", """select resource, ct || '|' || at || '|' || tt as context,
    round(ln(1 + n), 6) as weight from {cc}""")
def o6(spark, d):
    return rounded(org.resource_profiles(rlog(spark, d)))


@query("O7_discover_groups")
def o7(spark, d):
    g = org.discover_groups(rlog(spark, d), n_groups=4)
    return g.groupBy("grp").agg(F.count(F.lit(1)).alias("resources"))


@query("O7_hierarchical_groups")
def o7b(spark, d):
    """Members of groups by agglomeration, complete linkage."""
    return org.hierarchical_groups(rlog(spark, d), 4)


@query("O7_overlapping_groups")
def o7c(spark, d):
    """Members of groups that may overlap, with their shares."""
    return rounded(org.overlapping_groups(rlog(spark, d), 4), 6)


@query("O8_overlapping_conformance")
def o8b(spark, d):
    """Conformance of the overlapping groups with full recall."""
    rl = rlog(spark, d)
    m = staged(org.overlapping_groups(rl, 4))
    return rounded(org.conformance(rl, m, org.full_recall(rl, m)))


def conformance_sql(caps, name):
    part(name + "_cand", f"select distinct ct, at, tt, resource from ({caps}) join {{members}} using (grp)")
    part(name + "_k", f"select ct, at, tt, count(*) as k from {{{name}_cand}} group by 1, 2, 3")
    return f"""select sum(n) filter (ok) / (select sum(n) from {{cc}}) as fitness, sum(case when ok then
        n * (na - k + 1) / na else 0 end) / sum(n) as "precision" from (select c.*, k, (select count(distinct
        resource) from {{{name}_cand}} semi join {{cc}} using (ct, at, tt)) as na, (ct, at, tt, resource) in
        (select (ct, at, tt, resource) from {{{name}_cand}}) as ok from {{cc}} c join {{{name}_k}}
        using (ct, at, tt))"""


F1 = """select round(fitness, 6) as fitness, round("precision", 6) as "precision",
    round(2 * fitness * "precision" / (fitness + "precision"), 6) as f1 from (%s)"""
part("somecaps", "select * from {recall} where (grp + length(at) + length(tt)) % 3 <> 0")


def some_caps(spark, d):
    return staged(org.full_recall(rlog(spark, d), members(spark, d)).filter(
        "(grp + length(at) + length(tt)) % 3 <> 0"))


@query("O8_conformance", F1 % conformance_sql("select * from {somecaps}", "some"))
def o8(spark, d):
    return rounded(org.conformance(rlog(spark, d), members(spark, d), some_caps(spark, d)))


part("stake", """select grp, ct, at, tt, sum(n) / any_value(w) as stake, count(*) / any_value(s) as coverage
    from {cc} join {members} using (resource) join (select ct, at, tt, sum(n) as w from {cc} group by 1, 2, 3)
    using (ct, at, tt) join (select grp, count(*) as s from {members} group by 1) using (grp)
    group by 1, 2, 3, 4""")


@query("O9_stake_and_coverage", """select grp, ct as case_type, at as activity_type, tt as time_type,
    round(stake, 6) as stake, round(coverage, 6) as coverage from {stake}""")
def o9(spark, d):
    return rounded(org.stake_and_coverage(rlog(spark, d), members(spark, d)))


part("grid", """select w / 10 as w1, l / 10 as lam, grp, ct, at, tt from {stake}, range(1, 10) a(w),
    range(1, 10) b(l) where w / 10 * stake + (1 - w / 10) * coverage >= l / 10""")
part("gcand", "select distinct w1, lam, ct, at, tt, resource from {grid} join {members} using (grp)")
part("gscore", """select w1, lam, coalesce(sum(n) filter (ok), 0) / (select sum(n) from {cc}) as fitness,
    sum(case when ok then n * (na - k + 1) / na else 0 end) / sum(n) as "precision" from (select k.w1, k.lam,
    c.n, k.k, na, g.resource is not null as ok from {cc} c join (select w1, lam, ct, at, tt, count(*) as k
    from {gcand} group by 1, 2, 3, 4, 5) k using (ct, at, tt) join (select w1, lam, count(distinct resource)
    as na from {gcand} group by 1, 2) using (w1, lam) left join {gcand} g on g.w1 = k.w1 and g.lam = k.lam
    and g.ct = c.ct and g.at = c.at and g.tt = c.tt and g.resource = c.resource) group by 1, 2""")


@query("O10_overall_score", """select w1, lam, round(fitness, 6) as fitness, round("precision", 6)
    as "precision", round(coalesce(2 * fitness * "precision" / nullif(fitness + "precision", 0), 0), 6) as f1
    from {gscore}""")
def o10(spark, d):
    return rounded(org.overall_score_grid(rlog(spark, d), members(spark, d))[0])


@query("O10_best_model", """with b as (select w1, lam from {gscore} order by 2 * fitness * "precision" /
    nullif(fitness + "precision", 0) desc nulls last, w1, lam limit 1) select grp, ct, at, tt from {grid}
    semi join b using (w1, lam)""")
def o10b(spark, d):
    return org.overall_score(rlog(spark, d), members(spark, d))[1]


@query("O11_full_recall", "select * from {recall}")
def o11(spark, d):
    return org.full_recall(rlog(spark, d), members(spark, d))


# capabilities with wildcards, and the contexts asked of them
part("wcaps", """select distinct grp, case when length(at) % 2 = 1 then '' else ct end as ct, at,
    case when grp = 9 then '' else tt end as tt from {somecaps} where tt <> 'TT.Sunday' and
    not (ct = 'CT.g2' and at = 'AT.error')""")
part("ask", """select distinct activity, case when activity = 'view' then null else 'CT.' || goal end as
    case_type, case when activity = 'signup' then null else 'TT.' || dayname("timestamp") end as time_type
    from {el}""")


def wild_caps(spark, d):
    c = some_caps(spark, d).filter("tt <> 'TT.Sunday' and not (ct = 'CT.g2' and at = 'AT.error')")
    return staged(c.select("grp", F.when(F.length("at") % 2 == 1, "").otherwise(F.col("ct")).alias("ct"), "at",
                    F.when(F.col("grp") == 9, "").otherwise(F.col("tt")).alias("tt")).distinct())


def asked(spark, d):
    return el(spark, d).select(
        "activity", F.when(F.col("activity") != "view", F.concat(F.lit("CT."), "goal")).alias("case_type"),
        F.when(F.col("activity") != "signup", org.time_type()).alias("time_type")).distinct()


def matched(ct):
    return f"""select distinct a.activity, a.case_type, a.time_type, c.grp from {{ask}} a join {{wcaps}} c
    on c.at = 'AT.' || a.activity and ({ct}) and (c.tt = '' or a.time_type is null or c.tt = a.time_type)"""


part("match1", matched("c.ct = '' or a.case_type is null or c.ct = a.case_type"))
part("match2", """select * from {match1} union select m.* from (""" + matched("true") + """) m where not exists
    (select 1 from {wcaps} c where c.at = 'AT.' || m.activity and (c.ct = '' or m.case_type is null or
    c.ct = m.case_type))""")


@query("J9_wildcard_match", "select activity, case_type, time_type, grp from {match1}")
def j9(spark, d):
    return org.match_contexts(asked(spark, d), wild_caps(spark, d))


@query("J10_back_off", "select activity, case_type, time_type, grp from {match2}")
def j10(spark, d):
    return org.backed_off_matches(asked(spark, d), wild_caps(spark, d))


part("cands", """select distinct activity, case_type, time_type, resource from {match2} join {members}
    using (grp)""")


@query("O12_candidates", "select * from {cands}")
def o12(spark, d):
    return org.candidates(asked(spark, d), members(spark, d), wild_caps(spark, d))


@query("O12_candidate_counts", """select activity, case_type, time_type, count(c.resource) as n, case when
    count(c.resource) = 1 then min(c.resource) end as sole from {ask} a left join {cands} c on
    c.activity = a.activity and c.case_type is not distinct from a.case_type and c.time_type is not distinct
    from a.time_type group by a.activity, a.case_type, a.time_type""".replace(
        "select activity, case_type, time_type,", "select a.activity, a.case_type, a.time_type,"))
def o12b(spark, d):
    return org.candidate_counts(asked(spark, d), members(spark, d), wild_caps(spark, d))


@query("O12_permits", """select resource, permitted, count(*) as n from (select e.resource, exists (select 1 from
    {cands} c where c.resource = e.resource and c.activity = e.activity and c.case_type = 'CT.' || goal and
    c.time_type = 'TT.' || dayname("timestamp")) as permitted from {el} e where activity not in
    ('view', 'signup')) group by 1, 2""")
def o12c(spark, d):
    a = el(spark, d).filter("activity not in ('view', 'signup')").select(
        "resource", "activity", F.concat(F.lit("CT."), "goal").alias("case_type"),
        org.time_type().alias("time_type"))
    return org.permits(a, members(spark, d), wild_caps(spark, d)).groupBy("resource", "permitted").agg(
        F.count(F.lit(1)).alias("n"))


@query("O12_static_permits", """select resource, activity, (resource, activity) in (select (resource, activity)
    from {el} where "timestamp" < timestamp '2024-01-03') as permitted from {pc}""")
def o12d(spark, d):
    log = el(spark, d)
    early = org.observed_permissions(log.filter("timestamp < timestamp_ntz'2024-01-03'"))
    return org.static_permits(org.observed_permissions(log), early)


@query("O12_groups_of", """select resource, string_agg(grp::varchar, ',' order by grp) as groups from {members}
    group by 1""")
def o12e(spark, d):
    g = org.groups_of(members(spark, d))
    return g.select("resource", F.array_join(F.col("groups").cast("array<string>"), ",").alias("groups"))


@query("O13_vocabulary", """select count(distinct tt) as n_time_types, count(distinct tt) filter (tt in
    ('TT.Monday', 'TT.Tuesday', 'TT.Wednesday', 'TT.Thursday', 'TT.Friday', 'TT.Saturday', 'TT.Sunday'))
    as n_recognised from {wcaps} where tt <> ''""")
def o13(spark, d):
    org.self_check(wild_caps(spark, d))
    return org.vocabulary_overlap(wild_caps(spark, d))


@query("O14_pool_comparison", """with m as (select distinct a.activity, resource from (select distinct activity
    from {el}) a join {wcaps} c on c.at = 'AT.' || a.activity and c.ct in ('', 'CT.g1') and c.tt in ('',
    'TT.Monday') join {members} using (grp)), o as (select distinct resource, activity from {el})
    select activity, count(o.resource) as observed, count(m.resource) as model, count(*) filter
    (o.resource is null) as novel, count(*) filter (m.resource is null) as withheld from o full join m
    using (activity, resource) group by 1""")
def o14(spark, d):
    return org.pool_comparison(el(spark, d), members(spark, d), wild_caps(spark, d), "CT.g1", "TT.Monday")


@query("O15_work_distance", """with a as (select resource, activity, count(*) / sum(count(*)) over () as x
    from {el} where "timestamp" < timestamp '2024-01-10' group by 1, 2), b as (select resource, activity,
    count(*) / sum(count(*)) over () as y from {el} where "timestamp" >= timestamp '2024-01-10' and value > 3
    group by 1, 2) select round(0.5 * sum(abs(coalesce(x, 0) - coalesce(y, 0))), 6) as tvd, count(x) as pairs_a,
    count(y) as pairs_b from a full join b using (resource, activity)""")
def o15(spark, d):
    log = el(spark, d)
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    return rounded(org.work_distance(log.filter(F.col("timestamp") < cut),
                                     log.filter((F.col("timestamp") >= cut) & (F.col("value") > 3))))


part("gw", """select grp, activity, sum(n) as n, sum(n) / sum(sum(n)) over (partition by activity) as oa,
    sum(n) / sum(sum(n)) over (partition by grp) as og from {pc} join {dmembers} using (resource)
    group by 1, 2""")


@query("O16_group_anatomy", """with r as (select *, row_number() over (partition by grp order by oa desc,
    activity) as r1, row_number() over (partition by grp order by n desc, activity) as r2 from {gw})
    select grp, cast(sum(n) as bigint) as n_events, 5 as n_members, coalesce(string_agg(activity, ', '
    order by r1) filter (oa >= 0.3 and r1 <= 4), string_agg(activity, ', ' order by r2) filter (r2 <= 3))
    as signature from r group by 1""")
def o16(spark, d):
    return org.group_anatomy(el(spark, d), members(spark, d, False), share=0.3)


@query("O17_group_distances", """select a.grp::varchar as grp, b.grp::varchar as peer, round(0.5 * sum(abs(coalesce(a.og, 0)
    - coalesce(b.og, 0))) * 100, 6) as score from (select g.grp, x.activity, og from (select distinct grp from
    {gw}) g cross join (select distinct activity from {gw}) x left join {gw} w on w.grp = g.grp and w.activity =
    x.activity) a join (select g.grp, x.activity, og from (select distinct grp from {gw}) g cross join (select
    distinct activity from {gw}) x left join {gw} w on w.grp = g.grp and w.activity = x.activity) b on
    a.activity = b.activity and a.grp < b.grp group by 1, 2""")
def o17(spark, d):
    return rounded(org.group_distances(el(spark, d), members(spark, d, False)))


@query("O18_group_handoffs", """select grp, next_grp, count(*) as n, round(count(*) * 100 / sum(count(*)) over
    (partition by grp), 6) as pct from (select grp, lead(grp) over (partition by case_id order by "timestamp",
    event_order) as next_grp from {el} join {dmembers} using (resource)) where next_grp is not null
    group by 1, 2""")
def o18(spark, d):
    return rounded(org.group_handoffs(el(spark, d), members(spark, d, False)))


@query("O19_similar_peers", """with w as (select resource, activity, ln(1 + n) as w from {pc}), n as (select resource,
    sqrt(sum(w * w)) as s from w group by 1), p as (select a.resource, b.resource as peer, round(sum(a.w * b.w) /
    any_value(na.s) / any_value(nb.s), 9) as score from w a join w b on a.activity = b.activity and
    a.resource <> b.resource join n na on na.resource = a.resource join n nb on nb.resource = b.resource
    group by 1, 2) select resource, peer, round(score, 6) as score, rank from (select *, row_number() over
    (partition by resource order by score desc, peer) as rank from p) where rank <= 5""")
def o19(spark, d):
    return rounded(org.similar_peers(el(spark, d)))


part("crit_ctx", """select a.activity, c.ct as case_type, t.tt as time_type from (select distinct at[4:] as activity from
    {wcaps}) a cross join (select distinct ct from {wcaps} where ct <> '') c cross join (select unnest(['TT.Monday',
    'TT.Tuesday', 'TT.Wednesday', 'TT.Thursday', 'TT.Friday', 'TT.Saturday', 'TT.Sunday']) as tt) t""")
part("crit_c", """select distinct x.activity, x.case_type, x.time_type, resource from {crit_ctx} x join {wcaps} w
    on w.at = 'AT.' || x.activity and (w.ct in ('', x.case_type) or not exists (select 1 from {wcaps} k where k.at =
    'AT.' || x.activity and k.ct in ('', x.case_type))) and w.tt in ('', x.time_type) join {members} m on
    m.grp = w.grp where resource <> 'R0'""")


@query("O20_criticality", """with s as (select one as resource, count(*) as s from (select min(resource) as one from {crit_c}
    group by activity, case_type, time_type having count(*) = 1) group by 1), b as (select resource,
    count(distinct at) as b from {members} join {wcaps} using (grp) group by 1), o as (select resource,
    sum(value) / 10000 as o, count(*) / (select count(*) from {el} where resource <> 'R0') as t from {el} group by 1),
    j as (select h.resource, o, t, coalesce(b, 0) as b, coalesce(s, 0) as s from (select distinct resource from {el}
    where resource <> 'R0') h left join b using (resource) left join s using (resource) left join o using (resource))
    select resource, round(o, 6) as occupation, round(t, 6) as throughput_share, b as permission_breadth, s as
    sole_candidate_contexts, round(0.4 * (o - min(o) over ()) / (max(o) over () - min(o) over ()) + 0.4 * (t -
    min(t) over ()) / (max(t) over () - min(t) over ()) + 0.2 * coalesce((b - min(b) over ()) /
    nullif(max(b) over () - min(b) over (), 0), 0), 6) as criticality_score from j""")
def o20(spark, d):
    # humans, occupation and throughput from one pass over the events
    work = staged(el(spark, d).groupBy("resource").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")))
    humans = work.filter("resource <> 'R0'")
    occ = work.select("resource", (F.col("value") / 10000).alias("occupation"))
    thr = work.select("resource", (F.col("n") / humans.agg(F.sum("n")).scalar()).alias("share"))
    return rounded(org.criticality(humans, members(spark, d), wild_caps(spark, d), occ, thr))


def rl0(ct, tt):
    return f"(select {ct} as ct, at, {tt} as tt, resource, n from {{cc}})"


@query("O21_model_sweep", """with a as (select 'activity' as contexts, 'given' as discovery, 'FullRecall' as profiling, (select count(distinct at)
    from {cc}) as n_contexts, f.* from (""" + F1 % """select sum(n) filter (ok) / sum(n) as fitness, sum(case when ok then n
    * (na - k + 1) / na else 0 end) / sum(n) as "precision" from (select c.*, (select count(distinct resource) from
    (select at, grp from {cc} join {members} using (resource)) x join {members} using (grp) where x.at = c.at) as k,
    (select count(distinct resource) from {members}) as na, true as ok from {cc} c)""" + """) f),
    b as (select 'attribute', 'given', 'FullRecall', (select count(*) from (select distinct ct, at, tt from {cc})), f.* from ("""
       + F1 % conformance_sql("select * from {recall}", "rec") + """) f), u as (select * from a union all select * from b)
    select * exclude (c), c as choice from ((select *, 'best' as c from u order by f1 desc, contexts limit 1) union all
    (select *, 'deployable' as c from u where contexts in ('activity') order by f1 desc, contexts limit 1))""")
def o21(spark, d):
    m = members(spark, d)
    a = org.sweep_row(org.resource_log(el(spark, d), "activity"), m, "activity", "given", "FullRecall")
    b = org.sweep_row(rlog(spark, d), m, "attribute", "given", "FullRecall")
    return rounded(org.best_models(a.unionByName(b), known=["activity"]).drop("n_groups"))


@query("O21_full_sweep")
def o21b(spark, d):
    """Three forms of contexts, two discoveries, two profilings: twelve models."""
    log = el(spark, d)
    forms = org.counted_forms(log, "goal", staged(org.profile_clusters(log, 10)))
    logs = {f: staged(rl) for f, rl in forms.items()}
    groups = {(f, how): staged(find(rl, 10)) for f, rl in logs.items() for how, find in (
        ("hierarchical", org.hierarchical_groups), ("overlapping", org.overlapping_groups))}
    return rounded(org.sweep(logs, groups))
