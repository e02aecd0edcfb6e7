"""Performance KPIs over a log, its sessions and resource availability.

Each KPI is one row (or one row per resource). Sessions are those of
``pairing.paired_instances``; pass them in when several KPIs share them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import has_text, ratio, seconds_between, starts_with_any, total
from ..functions.ordered import along, preceding
from ..functions.quantiles import quantiles
from ..functions.staging import staged
from .pairing import busy_pieces, clipped_to_window, in_window, paired_instances, with_resource
from .shape import event_class, ntz, restrict_to_cases, with_prefixes

# Milestone activities of the loan process.
FIRST_OFFER = ("O_Create Offer",)
DECISION = ("A_Pending", "A_Denied", "A_Cancelled")


def _mean_p95(df: DataFrame, value: str, mean: str, p95: str, n: str) -> DataFrame:
    one = df.agg(F.avg(value).alias(mean), F.count(F.lit(1)).alias(n))
    return one.withColumn(p95, quantiles(df, [], value, {"q": 0.95}).scalar())


def cycle_times(df: DataFrame, arrivals: DataFrame | None = None,
                completions: DataFrame | None = None) -> DataFrame:
    """case_id, cycle_s. ``arrivals`` is (case_id, arrival), ``completions``
    (case_id, completion); the first and last event stand in for them."""
    c = df.groupBy("case_id").agg(F.min("timestamp").alias("__a"), F.max("timestamp").alias("__b"))
    if completions is not None:
        c = c.drop("__b").join(completions.select("case_id", F.col("completion").alias("__b")),
                               "case_id")
    if arrivals is not None:
        c = c.drop("__a").join(arrivals.select("case_id", F.col("arrival").alias("__a")), "case_id")
    return c.select("case_id", seconds_between("__a", "__b").alias("cycle_s"))


def cycle_time(df: DataFrame, arrivals: DataFrame | None = None,
               completions: DataFrame | None = None) -> DataFrame:
    return _mean_p95(cycle_times(df, arrivals, completions), "cycle_s",
                     "avg_cycle_time_s", "p95_cycle_time_s", "n_cases")


def busy_seconds(sessions: DataFrame, intervals: DataFrame | None = None,
                 prefixes: Sequence[str] | None = None, window=None) -> DataFrame:
    """resource, busy_s, clipped to availability intervals and a window."""
    s = with_resource(with_prefixes(sessions, prefixes))
    return busy_pieces(s, intervals, window).groupBy("resource").agg(
        F.sum("seconds").alias("busy_s"))


def occupation(sessions: DataFrame, available: DataFrame, intervals: DataFrame | None = None,
               prefixes: Sequence[str] | None = None, window=None,
               subset: DataFrame | None = None) -> DataFrame:
    """resource, available_s, busy_s, occupation, overtime_s.

    ``available`` is (resource, seconds). A resource that was available but idle
    has occupation 0; without any availability it has none (null).
    """
    a = available.select("resource", F.col("seconds").alias("available_s"))
    if subset is not None:
        a = a.join(subset.select("resource"), "resource", "left_semi")
    busy = busy_seconds(sessions, intervals, prefixes, window)
    raw = busy_seconds(sessions, None, prefixes, window).withColumnRenamed("busy_s", "__raw")
    j = a.join(busy, "resource", "left").join(raw, "resource", "left").na.fill(
        0.0, ["busy_s", "__raw"])
    ok = F.col("available_s") > 0
    return j.select(
        "resource", "available_s", "busy_s",
        F.when(ok, ratio("busy_s", "available_s")).alias("occupation"),
        F.when(ok, F.greatest(F.lit(0.0), F.col("__raw") - F.col("busy_s"))).alias("overtime_s"))


def occupation_summary(per_resource: DataFrame) -> DataFrame:
    """One row: mean occupation, overtime, resources with and without availability."""
    return per_resource.agg(
        F.avg("occupation").alias("avg_resource_occupation"),
        F.coalesce(F.sum("overtime_s"), F.lit(0.0)).alias("busy_seconds_outside_availability"),
        F.count("occupation").alias("n_resources_evaluated"),
        F.sum((F.col("available_s") <= 0).cast("int")).alias("n_resources_zero_availability"))


def fairness(per_resource: DataFrame, weights: DataFrame | None = None,
             digits: int | None = 4) -> DataFrame:
    """One row: mean absolute deviation from the mean occupation; weighted if weights
    (resource, weight) are given. Occupations are rounded first, as reported."""
    o = F.round("occupation", digits) if digits is not None else F.col("occupation")
    p = per_resource.filter(F.col("occupation").isNotNull()).select("resource", o.alias("o"))
    mean = total(p, F.avg("o"))
    out = p.agg(F.avg(F.abs(F.col("o") - mean)).alias("resource_fairness"))
    if weights is not None:
        w = p.join(weights.select("resource", F.col("weight").alias("w")), "resource", "left") \
            .na.fill(0.0, ["w"])
        wm = w.agg(ratio(F.sum(F.col("o") * F.col("w")), F.sum("w"))).scalar()
        dev = w.agg(ratio(F.sum(F.abs(F.col("o") - wm) * F.col("w")), F.sum("w")))
        out = out.withColumn("weighted_resource_fairness", dev.scalar())
    return out


def time_to_milestone(df: DataFrame, activities: Sequence[str],
                      arrivals: DataFrame | None = None) -> DataFrame:
    """One row: mean, p95 of the time to the first completion of a milestone,
    cases reaching it, cases in all."""
    hit = F.when((F.col("lifecycle") == "complete") & F.col("activity").isin(list(activities)),
                 F.col("timestamp"))
    c = df.groupBy("case_id").agg(F.min(hit).alias("__hit"), F.min("timestamp").alias("__a"))
    n = total(df, F.countDistinct("case_id"))
    if arrivals is not None:
        c = c.drop("__a").join(arrivals.select("case_id", F.col("arrival").alias("__a")), "case_id")
    c = c.filter(F.col("__hit").isNotNull()).withColumn("s", seconds_between("__a", "__hit"))
    return _mean_p95(c, "s", "mean_s", "p95_s", "n_cases_reaching_it").withColumn(
        "n_cases_total", n)


def handover(sessions: DataFrame) -> DataFrame:
    """One row: share of consecutive sessions of a case that change resource."""
    s = along(with_resource(sessions), ["case_id"], ["start", "event_order"],
              {"__p": preceding("resource")}).filter(F.col("__p").isNotNull())
    return s.agg(F.avg((F.col("__p") != F.col("resource")).cast("double")).alias("handover_rate"),
                 F.count(F.lit(1)).alias("n_consecutive_steps"))


def activity_switches(sessions: DataFrame, prefixes: Sequence[str] | None = None,
                      window=None) -> DataFrame:
    """One row: share of consecutive sessions of a resource that change activity."""
    s = in_window(with_resource(with_prefixes(sessions, prefixes)), window)
    s = along(s, ["resource"], ["start", "complete", "event_order"],
              {"__p": preceding("activity")}).filter(F.col("__p").isNotNull())
    changed = (F.col("__p") != F.col("activity")).cast("int")
    return s.agg(F.avg(changed.cast("double")).alias("activity_switch_rate"),
                 F.count(F.lit(1)).alias("n_resource_transitions"),
                 F.coalesce(F.sum(changed), F.lit(0)).alias("n_activity_switches"))


def workload_balance(sessions: DataFrame, window_length: str = "1 day",
                     window_seconds: float = 86400.0, subset: DataFrame | None = None,
                     prefixes: Sequence[str] | None = None, window=None) -> DataFrame:
    """One row: mean and max over windows of the spread of occupation over resources.

    Idle resources count as zeros: the population deviation follows from the sum,
    the sum of squares and the number of resources, so no grid of windows and
    resources is built.
    """
    s = with_resource(with_prefixes(sessions, prefixes))
    if window is not None:
        s = clipped_to_window(in_window(s, window), window)
    if subset is not None:
        s = s.join(subset.select("resource").distinct(), "resource", "left_semi")
        n = total(subset, F.countDistinct("resource"))
    else:
        n = total(s, F.countDistinct("resource"))
    per = s.groupBy(F.window("start", window_length)["start"].alias("w"), "resource").agg(
        (F.sum(seconds_between("start", "complete")) / window_seconds).alias("o"))
    sd = per.groupBy("w").agg(F.sum("o").alias("s1"), F.sum(F.col("o") * F.col("o")).alias("s2"))
    sd = sd.withColumn("n", n.cast("double"))
    mean = F.col("s1") / F.col("n")
    sd = sd.withColumn("sd", F.sqrt(F.greatest(
        F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))))
    return sd.agg(F.avg("sd").alias("mean_window_std"), F.max("sd").alias("max_window_std"),
                  F.count(F.lit(1)).alias("n_windows"))


def exposure(df: DataFrame, sessions: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """One row: events, sessions and busy time of work items (w) and milestones (ao)."""
    kind = event_class("activity")
    ev = df.select(kind.alias("k")).filter("k <> 'other'").groupBy().agg(
        F.count(F.lit(1)).alias("event_rows"),
        F.sum((F.col("k") == "W").cast("int")).alias("w_event_rows"))
    s = with_resource(sessions).withColumn("k", kind).filter("k <> 'other'")
    ses = s.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("k") == "W").cast("int")).alias("w"))
    b = busy_pieces(s, intervals).agg(
        F.sum("seconds").alias("n"), F.sum(F.when(F.col("k") == "W", F.col("seconds"))).alias("w"))
    zero = F.lit(0)
    out = ev.withColumns({
        "paired_sessions": ses.select("n").scalar(),
        "w_paired_sessions": F.coalesce(ses.select("w").scalar(), zero),
        "busy_seconds": F.coalesce(b.select("n").scalar(), F.lit(0.0)),
        "w_busy_seconds": F.coalesce(b.select("w").scalar(), F.lit(0.0))})
    out = out.withColumn("w_event_rows", F.coalesce("w_event_rows", zero))
    for what, stem in (("event_rows", "event"), ("paired_sessions", "session"),
                       ("busy_seconds", "busy")):
        out = out.withColumn(f"ao_{what}", F.col(what) - F.col(f"w_{what}"))
        out = out.withColumns({f"w_{stem}_share": ratio(f"w_{what}", what),
                               f"ao_{stem}_share": ratio(f"ao_{what}", what)})
    return out


def report(df: DataFrame, *, arrivals: DataFrame | None = None,
           completions: DataFrame | None = None, available: DataFrame | None = None,
           intervals: DataFrame | None = None, weights: DataFrame | None = None,
           completed: DataFrame | None = None, subset: DataFrame | None = None,
           resource_df: DataFrame | None = None, window=None,
           first_offer: Sequence[str] = FIRST_OFFER,
           decision: Sequence[str] = DECISION) -> DataFrame:
    """All KPIs as rows (metric, value).

    Cycle time uses finished cases (``completed`` has case_id); resource metrics
    keep every event. Without ``available`` the whole log span counts.
    """
    done = df if completed is None else restrict_to_cases(df, completed)
    events = df if resource_df is None else resource_df
    s = staged(paired_instances(events))     # read by most KPIs
    if available is None:
        span = events.agg(seconds_between(F.min("timestamp"), F.max("timestamp"))).scalar()
        available = with_resource(s).select("resource").distinct().withColumn("seconds", span)
    occ = staged(occupation(s, available, intervals, None, window, subset))
    pieces = [
        ("cycle_time", cycle_time(done, arrivals, completions)),
        ("occupation", occupation_summary(occ)),
        ("fairness", fairness(occ, weights)),
        ("time_to_first_offer", time_to_milestone(df, first_offer, arrivals)),
        ("time_to_decision", time_to_milestone(df, decision, arrivals)),
        ("handover", handover(s if resource_df is None else paired_instances(df))),
        ("switches", activity_switches(s, window=window)),
        ("balance", workload_balance(s, subset=subset, window=window)),
        ("cases", df.agg(F.countDistinct("case_id").alias("in_log")).withColumn(
            "completed", total(done, F.countDistinct("case_id"))))]
    out = None
    for name, one in pieces:
        cells = F.array(*[F.struct(F.lit(f"{name}.{c}").alias("metric"),
                                   F.col(c).cast("double").alias("value")) for c in one.columns])
        long = one.select(F.explode(cells).alias("c")).select("c.*")
        out = long if out is None else out.unionByName(long)
    return out


def run_guards(df: DataFrame, per_resource: DataFrame | None = None) -> DataFrame:
    """One row: unassigned work starts, assigned milestone starts, largest occupation,
    and whether the run passes at unit capacity."""
    active = F.col("lifecycle").isin("start", "resume")
    work = active & starts_with_any("activity", ["W_"])
    atomic = active & starts_with_any("activity", ["A_", "O_"])
    named = has_text("resource")
    out = df.agg(
        F.coalesce(F.sum((work & ~named).cast("int")), F.lit(0)).alias("missing_resource_starts"),
        F.coalesce(F.sum((atomic & named).cast("int")), F.lit(0)).alias("assigned_atomic_starts"),
        F.coalesce(F.sum(atomic.cast("int")), F.lit(0)).alias("atomic_starts"))
    top = (per_resource.agg(F.max("occupation")).scalar() if per_resource is not None
           else F.lit(None).cast("double"))
    out = out.withColumn("max_resource_occupation", top)
    return out.withColumn("passes", (F.col("missing_resource_starts") == 0)
                          & (F.coalesce("max_resource_occupation", F.lit(0.0)) <= 1.0 + 1e-9))


def check_run(df: DataFrame, per_resource: DataFrame | None = None, *, unpermitted: int = 0,
              still_queued: int = 0, automatic_atomic: int = 0, capacity: int = 1) -> dict:
    """Raise AssertionError if a run breaks its rules; return the diagnostics row."""
    for c in ("activity", "lifecycle", "resource"):
        if c not in df.columns:
            raise AssertionError(f"log lacks the column {c}")
    row = run_guards(df, per_resource).first().asDict()      # one aggregated row
    if unpermitted != 0:
        raise AssertionError(f"run contains {unpermitted} unpermitted activities")
    if row["missing_resource_starts"]:
        raise AssertionError(f"run contains {row['missing_resource_starts']} unassigned W_ starts")
    if automatic_atomic:
        if automatic_atomic != row["atomic_starts"]:
            raise AssertionError("automatic transitions do not match A_/O_ starts")
        if row["assigned_atomic_starts"]:
            raise AssertionError("run contains assigned automatic A_/O_ starts")
    if still_queued < 0:
        raise AssertionError("queue length at the end is unknown")
    top = row["max_resource_occupation"]
    if capacity == 1 and top is not None and top > 1.0 + 1e-9:
        raise AssertionError(f"resource occupation {top:.6f} exceeds unit capacity")
    return row


def throughput_share(df: DataFrame, start, end) -> DataFrame:
    """Completed events per resource in a window, and their share."""
    c = with_resource(df).filter((F.col("lifecycle") == "complete")
                                 & (F.col("timestamp") >= ntz(start))
                                 & (F.col("timestamp") < ntz(end)))
    c = c.groupBy("resource").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", ratio("n", total(c, F.sum("n"))))


def completion_summary(cases: DataFrame, window_end, milestones: dict[str, str]) -> DataFrame:
    """One row from (case_id, arrival, completion, milestone times...): arrivals, completed
    in all and within the window, completion share, share reaching each milestone."""
    done = F.col("completion").isNotNull()
    n = F.count(F.lit(1))

    def share(c: Column):
        return ratio(F.sum(c.cast("int")), n)
    return cases.agg(
        n.alias("n_arrived"), F.sum(done.cast("int")).alias("n_completed"),
        F.sum((done & (F.col("completion") < ntz(window_end))).cast("int"))
        .alias("n_completed_in_window"), share(done).alias("completion_share"),
        *[share(F.col(c).isNotNull()).alias(f"reached_{name}") for name, c in milestones.items()])
