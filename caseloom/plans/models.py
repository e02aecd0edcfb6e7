"""M: predictive models (and F5)."""

import functools

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.staging import staged
from ..operators import boosting, fit, lifecycle, models, pairing
from ..operators.replay import decision_examples
from .base import lifecycle_log, part, query, simple_log
from .replay import NET2, attributed
from . import lifecycle as _l  # noqa: F401  shared CTEs


def sessions(spark, d):
    t = lifecycle.training_sessions(lifecycle_log(spark, d))
    return t.withColumn("row_key", F.col("session_order"))


part("msplit", """select *, ln(1 + duration_s) as y, row_number() over (order by ts, session_order) - 1 <
    floor((select count(*) from {training}) * 0.8) as is_train from {training}""")


def split(spark, d):
    s = staged(sessions(spark, d)).withColumn("y", F.log1p("duration_s"))
    return models.temporal_split(s, ["timestamp", "row_key"])


@functools.lru_cache(maxsize=2)
def _learned(app, spark, d, kind):
    """(rows, model), trained once per application and data; the queries read it."""
    rows = staged(models.duration_rows(staged(sessions(spark, d)))[1])
    return rows, (models.train_duration if kind == "mean" else models.train_quantiles)(rows)


def learned(spark, d, kind):
    return _learned(spark.sparkContext.applicationId, spark, d, kind)


@query("M1_duration_model")
def m1(spark, d):
    """Held-out errors of the boosted duration model: 300 trees of depth 6."""
    rows, model = learned(spark, d, "mean")
    return rounded(models.regression_metrics(boosting.predict(rows.filter("not is_train"), model)))


@query("M2_temporal_split", "select session_order, is_train from {msplit}")
def m2(spark, d):
    return split(spark, d).select("session_order", "is_train")


part("mpred", """select s.*, p from {msplit} s join (select activity, avg(y) as p from {msplit} where is_train
    group by 1) using (activity) where not is_train""")


@query("M3_regression_metrics", """select count(*) as n, round(avg(abs(exp(p) - exp(y))), 3) as mae, round(avg((exp(p) - exp(y))
    ** 2), 0) as mse, round(sqrt(avg((exp(p) - exp(y)) ** 2)), 3) as rmse, round(1 - avg((exp(p) - exp(y)) ** 2) /
    var_pop(exp(y)), 6) as r2, round(1 - avg((p - y) ** 2) / var_pop(y), 6) as r2_log from {mpred}""")
def m3(spark, d):
    s = split(spark, d)
    p = s.filter("is_train").groupBy("activity").agg(F.avg("y").alias("prediction"))
    m = models.regression_metrics(s.filter("not is_train").join(p, "activity"))
    return rounded(m, 6, mae=3, mse=0, rmse=3)


LEVELS = "[" + ", ".join(repr(x) for x in models.LEVELS) + "]"
part("mq", f"""select case when activity = 'W_3' then 'W_3 (old)' else activity end as activity,
    unnest({LEVELS}) as level, unnest(quantile_cont(y, {LEVELS})) as q from {{msplit}} where
    is_train group by activity union all select null, unnest({LEVELS}),
    unnest(quantile_cont(y, {LEVELS})) from {{msplit}} where is_train""")


def table(rows):
    """Quantiles per activity; one activity has another name here and is left to the fallback."""
    t = models.quantile_table(rows.filter("is_train"), ["activity"])
    return staged(t.withColumn("activity", F.expr("if(activity = 'W_3', 'W_3 (old)', activity)")))


@query("M4_quantile_table", "select activity, round(level::double, 2) as level, round(q, 6) as q from {mq}")
def m4(spark, d):
    return rounded(table(split(spark, d)), 6, level=2)


part("mtest", """select s.*, level, coalesce(a.q, f.q) as q from {msplit} s cross join (select level, q from {mq} where
    activity is null) f left join {mq} a using (activity, level) where not is_train""")


@query("M5_quantile_scores", """with l as (select session_order, any_value(y) as y, avg(case when y >= q then level * (y - q)
    else (1 - level) * (q - y) end) as pin, max(q) filter (round(level, 2) = 0.05) as q05, max(q) filter (round(level, 2) =
    0.95) as q95, max(q) filter (round(level, 2) = 0.25) as q25, max(q) filter (round(level, 2) = 0.75) as q75, max(q)
    filter (round(level, 2) = 0.5) as q50 from {mtest} group by 1)
    select round(avg(pin), 6) as mean_pinball, round(avg(case when y between q05 and q95 then 1.0 else 0.0 end), 6) as
    coverage_90, round(avg(case when y between q25 and q75 then 1.0 else 0.0 end), 6) as coverage_50,
    round(1 - avg((y - q50) ** 2) / var_pop(y), 6) as r2_median from l""")
def m5(spark, d):
    s = split(spark, d)
    return rounded(models.quantile_scores(s.filter("not is_train"), table(s), ["activity"]))


@query("M6_curve_at", """with u as (select session_order, activity, (session_order % 100) / 100 as u from {msplit} where not is_train),
    p as (select u.*, level, q, lead(level) over w as l1, lead(q) over w as q1, row_number() over w as i from u join
    {mtest} t using (session_order, activity) window w as (partition by session_order order by level))
    select session_order, round(greatest(1, exp(case when u < 0.05 then min(q) when u >= 0.95 then max(q) else max(q +
    (q1 - q) * (u - level) / (l1 - level)) filter (level <= u and u < l1) end) - 1), 3) as duration_s from p
    group by session_order, u""")
def m6(spark, d):
    rows = split(spark, d)
    s = rows.filter("not is_train").withColumn("u", (F.col("session_order") % 100) / 100)
    c = models.curve_at(models.with_curve(s, table(rows), ["activity"]).drop("duration_s"), "u")
    return rounded(c.select("session_order", "duration_s"), 3)


@query("M5_boosted_quantile_scores")
def m5b(spark, d):
    """Held-out scores of the boosted quantile model: 19 levels, 300 trees of depth 6."""
    rows, model = learned(spark, d, "levels")
    return rounded(models.curve_scores(models.with_learned_curve(rows.filter("not is_train"), model)))


@query("M6_boosted_curve_at")
def m6b(spark, d):
    """Durations read off the learned curves of the held-out rows."""
    rows, model = learned(spark, d, "levels")
    s = rows.filter("not is_train").withColumn("u", (F.col("session_order") % 100) / 100)
    c = models.curve_at(models.with_learned_curve(s, model).drop("duration_s"), "u")
    return rounded(c.select("session_order", "duration_s"), 3)


def examples(spark, d):
    """Next-event decisions of the event log: hour, weekday and visit as features."""
    from ..operators.shape import next_activity, visit_numbers
    log = visit_numbers(next_activity(simple_log(spark, d), keep_last=True)).filter(
        "next_activity is not null")
    return log.select(
        "case_id", F.col("event_order").alias("position"), F.col("activity").alias("dp_key"),
        F.col("next_activity").alias("label"), F.col("timestamp").alias("case_start"),
        F.hour("timestamp").alias("hour"), F.weekday("timestamp").alias("dow"), "visit", "value")


@query("M7_decision_trees")
def m7(spark, d):
    x = staged(examples(spark, d))
    p = models.train_decisions(x, ["hour", "dow", "visit", "value"])[2]
    return rounded(models.classification_metrics(p).join(models.one_vs_rest_auc(p), "dp_key"))


@query("M7_replayed_decisions")
def m7b(spark, d):
    """Trees on the decisions of a replayed log."""
    x = staged(decision_examples(attributed(spark, d), NET2, ["goal"], ["amount"], "user"))
    p = models.train_decisions(x, ["has_offer", "amount", "position"])[2]
    return rounded(models.classification_metrics(p))


# predictions that need no training: the class of the previous event, scored by value
part("mp", """select dp_key, label, case when value < 5 then 'click' when value < 12 then 'view' else 'error' end as predicted,
    value, round(value, 0) as s from (select activity as dp_key, next_activity as label, value from {simple_next} where
    next_activity is not null)""")


def predictions(spark, d):
    v = F.col("value")
    s = F.round(v, 0)
    return examples(spark, d).select(
        "dp_key", "label", F.when(v < 5, "click").when(v < 12, "view").otherwise("error").alias("predicted"),
        F.create_map(F.lit("click"), s, F.lit("view"), -s).alias("scores"))


@query("M8_classification_metrics", """with c as (select distinct dp_key, unnest(['click', 'view', 'error', 'purchase', 'signup'])
    as c from {mp}), m as (select c.dp_key, c.c, count(*) filter (label = c.c) as a, count(*) filter (predicted = c.c) as s,
    count(*) filter (label = c.c and predicted = c.c) as tp from c join {mp} p using (dp_key) group by 1, 2)
    select a.*, round(precision_macro, 6) as precision_macro, round(recall_macro, 6) as recall_macro from (select dp_key,
    count(*) as n, round(count(*) filter (label = predicted) / count(*), 6) as accuracy from {mp} group by 1) a join
    (select dp_key, avg(coalesce(tp / nullif(s, 0), 0)) as precision_macro, avg(coalesce(tp / nullif(a, 0), 0)) as
    recall_macro from m where a + s > 0 group by 1) using (dp_key)""")
def m8(spark, d):
    return rounded(models.classification_metrics(predictions(spark, d)))


@query("M8_auc", """with v as (select dp_key, c, case c when 'click' then s else -s end as s, label = c as pos from {mp},
    (select unnest(['click', 'view']) as c)), g as (select dp_key, c, s, count(*) filter (pos) as p, count(*) filter (not pos)
    as q from v group by 1, 2, 3), r as (select *, coalesce(sum(q) over (partition by dp_key, c order by s rows between
    unbounded preceding and 1 preceding), 0) as b from g) select dp_key, round(avg(a), 6) as auc_macro from (select dp_key, c,
    sum(p * (b + 0.5 * q)) / (sum(p) * sum(q)) as a from r group by 1, 2 having sum(p) > 0 and sum(q) > 0) group by 1""")
def m8b(spark, d):
    return rounded(models.one_vs_rest_auc(predictions(spark, d)))


@query("M8_majority_share", """select dp_key, round(max(n) / sum(n), 6) as majority_share from (select dp_key, label,
    count(*) as n from {mp} group by 1, 2) group by 1""")
def m8c(spark, d):
    return rounded(models.majority_share(examples(spark, d)))


@query("M9_feature_matrix", """with a as (select l, row_number() over (order by l) - 1 as c from (select distinct activity as l from
    {training} union select '__UNKNOWN__')), r as (select l, row_number() over (order by l) - 1 as c from (select distinct
    resource as l from {training} union select '__UNKNOWN__')), p as (select l, row_number() over (order by l) - 1 as c from
    (select distinct previous_activity as l from {training} union select '__UNKNOWN__' union select '__START__'))
    select session_order, a.c::double as f0, r.c::double as f1, p.c::double as f2, day_of_week::double as f3,
    hour_of_day::double as f4, case_position::double as f5, round(case_age_seconds, 6) as f6, case_position::double as f7
    from {training} t join a on a.l = activity join r on r.l = resource join p on p.l = previous_activity""")
def m9(spark, d):
    from pyspark.ml.functions import vector_to_array
    s = staged(sessions(spark, d))
    x = models.feature_matrix(models.encoded(s, models.encoders(s)))
    v = vector_to_array("features")
    return rounded(x.select("session_order", *[v[i].alias(f"f{i}") for i in range(8)]))


@query("M10_feature_importances")
def m10(spark, d):
    return rounded(models.feature_importances(learned(spark, d, "mean")[1], spark))


@query("F5_expected_duration", """with p as (select activity, start_resource as resource, avg(duration_s) as m from {pairs} where duration_s >= 0 group by
    1, 2 having count(*) >= 12), f as (select activity, case distribution when 'lognorm' then greatest(1, scale * exp(0.5 * shape
    * shape)) when 'gamma' then greatest(1, scale * shape) when 'weibull_min' then greatest(1, scale * gamma(1 + 1 / shape))
    else 600.0 end as e from {ptimes_best})
    select x.activity, x.resource, round(coalesce(greatest(1, m), e, 600), 2) as expected_s, case when m is not null then 'model'
    when e is not null then 'fit' else 'default' end as source from (select distinct activity, resource from {lc}) x left join p
    using (activity, resource) left join f on f.activity = x.activity""".replace(
        "coalesce(greatest(1, m), e, 600)", "coalesce(case when m is not null then greatest(1, m) end, e, 600)"))
def f5(spark, d):
    log = lifecycle_log(spark, d)
    t = pairing.processing_times(log)
    p = t.groupBy("activity", "resource") if "resource" in t.columns else \
        t.withColumn("resource", F.col("start_resource")).groupBy("activity", "resource")
    p = p.agg(F.avg("duration_s").alias("predicted_s"), F.count(F.lit(1)).alias("n")).filter("n >= 12")
    fits = fit.best_fit(t, ["activity"], "duration_s")
    out = fit.expected_duration(log.select("activity", "resource").distinct(), p, fits)
    return rounded(out, 2)
