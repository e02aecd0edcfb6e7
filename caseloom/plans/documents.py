"""S: whole model documents, written as JSON and read back."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.staging import scratch, staged
from ..operators import fit, lifecycle, org, pairing, stats
from ..sources import fitted
from .base import chat_log, lifecycle_log, query, simple_log
from .fit import fit_parts
from .lifecycle import seg
from .org import el, members, rlog

fit_parts("acttimes", "{act}", ["activity"], "seconds")
fit_parts("gaptimes", "{rgaps}", ["activity"], "gap_s")


def reference(spark, d):
    """A document with every block, read back from its file."""
    log = simple_log(spark, d)
    s = staged(seg(spark, d))
    doc = fitted.reference_document(
        stats.activity_counts(log),
        fit.best_fit(pairing.processing_times(lifecycle_log(spark, d)), ["activity"], "duration_s"),
        stats.branching(log), stats.branching_by_visit(log), stats.variants(chat_log(spark, d)),
        fit.best_fit(lifecycle.active_sessions(s), ["activity"], "seconds"),
        lifecycle.session_end_hazard(s), lifecycle.suspend_end_hazard(s),
        fit.best_fit(lifecycle.resume_gaps(s), ["activity"], "gap_s"),
        fit.best_fit(lifecycle.withdraw_waits(s), ["activity"], "wait_s"))
    path = scratch(spark) + ".json"
    fitted.write_json(doc, path)
    return fitted.read_reference(spark, path)


@query("S8_active_times", """select activity, distribution, n, round(mean_s, 3) as mean_s, 'active' as mode
    from {acttimes_best}""")
def s8_times(spark, d):
    """Processing times of a reference: those of the lifecycle block replace the others."""
    r = reference(spark, d)
    return rounded(r["processing_times"].select(
        "activity", "distribution", "n", "mean_s", r["mode"].scalar().alias("mode")), 3)


@query("S9_write_every_block", """select 'activity_counts' as block, activity as a, null as b, null as c,
    count(*)::double as value from {simple} group by activity
    union all select 'processing_times', activity, distribution, null, round(mean_s, 3) from {ptimes_best}
    union all select 'lifecycle.processing_times', activity, distribution, null, round(mean_s, 3) from {acttimes_best}
    union all select 'lifecycle.resume_gap_params', activity, distribution, null, round(mean_s, 3) from {gaptimes_best}
    union all select 'lifecycle.withdraw_hazard', activity, distribution, null, round(mean_s, 3) from {waitfit_best}
    union all select 'lifecycle.session_end_probs', activity, null, null, round(p_complete, 3) from {seh}
    union all select 'lifecycle.suspend_end_probs', activity, null, null, round(p_resume, 3) from {sueh}
    union all select 'branching_probs', activity, next_activity, null, round(p, 3) from {branch}
    union all select 'branching_probs_by_visit', activity, visit_bucket, next_activity, round(p, 3) from {branchv}
    union all (select 'process_variants', trace, null, null, frequency from {chatv}
        order by frequency desc, example_case limit 20)""")
def s9_blocks(spark, d):
    """Every block of the written document in long form."""
    doc = reference(spark, d)["document"]
    none = F.lit(None).cast("string")

    def numbers(column, name):
        return doc.select(F.explode(column).alias("a", "v")).select(
            F.lit(name).alias("block"), "a", none.alias("b"), none.alias("c"), F.col("v").cast("double").alias("value"))

    def fits(column, name):
        return doc.select(F.explode(column).alias("a", "f")).select(
            F.lit(name).alias("block"), "a", F.col("f.distribution").alias("b"), none.alias("c"),
            F.col("f.mean_s").alias("value"))
    parts = [numbers("activity_counts", "activity_counts"), fits("processing_times", "processing_times")]
    parts += [fits(f"lifecycle.{c}", f"lifecycle.{c}")
              for c in ("processing_times", "resume_gap_params", "withdraw_hazard")]
    parts += [numbers(f"lifecycle.{c}", f"lifecycle.{c}") for c in ("session_end_probs", "suspend_end_probs")]
    parts.append(doc.select(F.explode("branching_probs").alias("a", "m")).select(
        F.lit("branching_probs").alias("block"), "a", F.explode("m").alias("b", "value"))
        .select("block", "a", "b", none.alias("c"), "value"))
    parts.append(doc.select(F.explode("branching_probs_by_visit").alias("a", "m")).select(
        "a", F.explode("m").alias("b", "k")).select(
        F.lit("branching_probs_by_visit").alias("block"), "a", "b", F.explode("k").alias("c", "value")))
    parts.append(doc.select(F.explode("process_variants.top_20").alias("v")).select(
        F.lit("process_variants").alias("block"), F.col("v.trace").alias("a"), none.alias("b"), none.alias("c"),
        F.col("v.frequency").cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, 3)


@query("S12_load_lifecycle", """select activity, 'session_end_prob' as parameter, null as distribution,
    round(p_complete, 6) as value from {seh}
    union all select activity, 'suspend_end_prob', null, round(p_resume, 6) from {sueh}
    union all select activity, 'processing_time', distribution, 0.0 from {acttimes_best}
    union all select activity, 'resume_gap', distribution, 0.0 from {gaptimes_best}
    union all select activity, 'withdraw', distribution, 0.0 from {waitfit_best}""")
def s12_lifecycle(spark, d):
    """Hazards and fits of the lifecycle block as one table."""
    p = fitted.lifecycle_parameters(reference(spark, d)["document"])
    return rounded(p.select("activity", "parameter", "distribution", "value"))


@query("S12_load_org_model", """with g as (select grp, dense_rank() over (order by grp) - 1 as i from
    (select distinct grp from {members}))
    select cast(i as int) as grp, 'member' as kind, resource as a, null as b, null as c from {members} join g using (grp)
    union all select cast(i as int), 'capability', ct, regexp_replace("at", '^AT[.]', ''), tt from {recall} join g using (grp)""")
def s12_org(spark, d):
    """Members and capabilities of an organisational model read back from its document."""
    m = members(spark, d)
    path = scratch(spark) + ".json"
    fitted.write_json(fitted.org_model_document(m, org.full_recall(rlog(spark, d), m)), path)
    r = fitted.read_permissions(spark, path)
    none = F.lit(None).cast("string")
    return r["members"].select("grp", F.lit("member").alias("kind"), F.col("resource").alias("a"),
                               none.alias("b"), none.alias("c")).unionByName(
        r["capabilities"].select("grp", F.lit("capability").alias("kind"), F.col("ct").alias("a"),
                                 F.col("at").alias("b"), F.col("tt").alias("c")))


@query("S12_load_static", "select distinct resource, activity from {pc}")
def s12_static(spark, d):
    """A resource to activities map read back from its document."""
    path = scratch(spark) + ".json"
    fitted.write_json(fitted.static_document(el(spark, d).filter("resource is not null")
                                             .select("resource", "activity").distinct()), path)
    return fitted.read_permissions(spark, path)["static"]


@query("O4_cluster_contexts")
def o4_clusters(spark, d):
    """Counts of the contexts whose case types are trace clusters."""
    log = staged(el(spark, d))
    rl = org.resource_log(log, "clusters", clusters=org.profile_clusters(log, 10))
    return org.context_counts(rl)
