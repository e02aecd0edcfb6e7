"""N: control-flow replay. The log is the conversations, with some turns missing.

The net reads an optional "system" turn, then "user" and "assistant" by turns, and
may stop after any of them. After a repair its state depends on the last label
only, so every result can be written in SQL as well.
"""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import replay as rp
from .base import chat_log, part, query

NET = rp.PetriNet.build(
    [("t1", "system", {"src": 1}, {"mid": 1}), ("t2", None, {"src": 1}, {"mid": 1}),
     ("t3", "user", {"mid": 1}, {"turn": 1}), ("t4", "assistant", {"turn": 1}, {"mid": 1}),
     ("t5", None, {"mid": 1}, {"snk": 1}), ("t6", None, {"turn": 1}, {"snk": 1})],
    {"src": 1}, {"snk": 1})


def log(spark, d):
    """The conversations; some later turns are given to the user, as deviations."""
    return chat_log(spark, d).withColumn("activity", F.expr(
        "if(event_order >= 2 and (cast(case_id as int) * 3 + event_order) % 11 = 0, 'user', activity)"))


part("nlog", """select *, lag(activity) over (partition by case_id order by event_order) as prev,
    row_number() over (partition by case_id order by event_order) - 1 as position from
    (select * replace (case when event_order >= 2 and (cast(case_id as int) * 3 + event_order) % 11 = 0
    then 'user' else activity end as activity) from {chat})""")
part("nstep", """select *, case when prev is null then activity in ('system', 'user') when prev = 'user' then
    activity = 'assistant' else activity = 'user' end as legal, case when prev is null then 'system | user'
    when prev = 'user' then 'assistant' else 'user' end as dp_key from {nlog}""")
part("ntrace", """select case_id, count(*) as n, count(*) filter (not legal) as bad, count(*) + 1 + 1 +
    case when min_by(activity, position) = 'user' then 1 else 0 end as tokens, string_agg(activity, '|' order by
    position) as t from {nstep} group by 1""")


@query("N1_fitness", """select round(count(*) filter (bad = 0) * 100 / count(*), 6) as pct_fitting,
    round(avg(1 - bad / tokens), 6) as average_trace_fitness, round(1 - sum(bad) / sum(tokens), 6) as log_fitness
    from {ntrace}""")
def n1(spark, d):
    return rounded(rp.fitness(rp.replay(log(spark, d), NET)))


@query("N2_precision", """with p as (select *, string_agg(activity, '|') over (partition by case_id order by position rows
    between unbounded preceding and 1 preceding) as prefix, coalesce(bool_and(legal) over (partition by case_id order by
    position rows between unbounded preceding and 1 preceding), true) as ok from {nstep}), q as (select prefix, dp_key,
    count(*) as w, count(distinct activity) filter (legal) as used from p where ok group by 1, 2), r as (select *,
    case dp_key when 'system | user' then 2 else 1 end as n from q)
    select round(1 - sum((n - used) * w) / sum(n * w), 6) as "precision" from r""")
def n2(spark, d):
    return rounded(rp.precision(rp.replay(log(spark, d), NET)))


@query("N3_repairs", """select count(*) filter (bad = 0) as n_perfect, count(*) filter (bad > 0) as n_repaired, cast(sum(bad)
    as bigint) as n_repair_events, cast(sum(bad) as bigint) as n_missing_tokens, cast(0 as bigint) as n_unknown_events
    from {ntrace}""")
def n3(spark, d):
    return rp.replay_summary(rp.replay(log(spark, d), NET))


part("ndec", """select *, row_number() over (partition by case_id, dp_key order by position) as visit from (select case_id,
    position, dp_key, activity as label from {nstep} where legal union all select case_id, max(position) + 1,
    case when max_by(activity, position) = 'user' then 'assistant' else 'user' end, '__END__' from {nstep}
    group by 1)""")
part("ncount", """select dp_key, bucket, label, count(*) as n from (select dp_key, label, unnest([case when visit < 5
    then visit::varchar else '5+' end, 'all']) as bucket from {ndec}) group by all""")


@query("N4_decision_counts", "select dp_key, bucket, label, n from {ncount}")
def n4(spark, d):
    return rp.decision_counts(rp.decisions(rp.replay(log(spark, d), NET)))


part("nprior", """select sum(n) filter (label = '__END__') / sum(n) as r from {ncount} where bucket <> 'all'""")


@query("N5_end_rate", "select round(r, 6) as end_rate from {nprior}")
def n5(spark, d):
    return rounded(rp.end_rate(rp.decision_counts(rp.decisions(rp.replay(log(spark, d), NET)))))


@query("N5_decision_probabilities", """with t as (select dp_key, bucket, sum(n) as t, coalesce(sum(n) filter (label =
    '__END__'), 0) as e from {ncount} group by 1, 2 having bucket = 'all' or sum(n) >= 20), s as (select *, (e + 5 * r) /
    (t + 5) as pe from t, {nprior}) select dp_key, bucket, label, round((1 - pe) * n / (t - e), 6) as p from {ncount} join s
    using (dp_key, bucket) where label <> '__END__' union all select dp_key, bucket, '__END__', round(pe, 6) from s
    where pe > 0""")
def n5b(spark, d):
    c = rp.decision_counts(rp.decisions(rp.replay(log(spark, d), NET)))
    return rounded(rp.decision_probabilities(c, min_samples=20, end_weight=5.0))


def attributed(spark, d):
    """Turns with attributes: the source of a case and the text length as "offer" value."""
    from .base import table
    c = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("case_id"), F.col("role").alias("activity"),
        F.col("turn").alias("event_order"), F.length("text").cast("double").alias("amount"),
        F.concat(F.lit("g"), (F.col("conv_id") % 3).cast("string")).alias("goal"))
    return c.withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(
        days=F.col("case_id").cast("int"), mins=F.col("event_order").cast("int")))


# a richer net: after "user" either "assistant" or another "user" may follow
NET2 = rp.PetriNet.build(
    [("t1", "system", {"src": 1}, {"mid": 1}), ("t2", None, {"src": 1}, {"mid": 1}),
     ("t3", "user", {"mid": 1}, {"mid": 1}), ("t4", "assistant", {"mid": 1}, {"mid": 1}),
     ("t5", None, {"mid": 1}, {"snk": 1})], {"src": 1}, {"snk": 1})


@query("N6_decision_examples", """with e as (select conv_id, cast(turn as bigint) as position, role, length(text)::double as a,
    last_value(case when role = 'user' then length(text)::double end ignore nulls) over (partition by conv_id order by turn
    rows between unbounded preceding and 1 preceding) as o from conversations)
    select cast(conv_id as varchar) as case_id, position, case when position = 0 then 'assistant | system | user' else
    'assistant | user' end as dp_key, role as label, 'g' || (conv_id % 3) as goal, case when o is null then 0 else 1 end
    as has_offer, coalesce(o, 0) as amount from e""")
def n6(spark, d):
    x = rp.decision_examples(attributed(spark, d), NET2, ["goal"], ["amount"], offer_activity="user")
    return x.drop("case_start")
