"""Comparison of a log with reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import ARROW, ratio, total
from ..functions.ordered import along, nth
from .lifecycle import suspend_count_errors
from .pairing import fifo_pairs, item_sessions
from .shape import completed_only, fingerprint_of, fingerprints, next_activity, positions
from .stats import (arrival_gaps, arrival_profile, case_arrivals, case_spans, daily_arrivals)
from ..functions.columns import seconds_between

# Limits of the artefact gate.
MAX_DURATION_ERROR = 0.20
MIN_COMPLETION = 0.99


def relative_error(sim, ref):
    sim, ref = (F.col(c) if isinstance(c, str) else c for c in (sim, ref))
    return ratio(F.abs(sim - ref), ref)


def branching_divergence(df: DataFrame, reference: DataFrame,
                         modelled: DataFrame | None = None) -> DataFrame:
    """activity, tvd, status, excluded_mass for every reference activity.

    ``reference`` is (activity, next_activity, p), ``modelled`` (activity). Status:
    compared, absent (never occurs), always_terminal (never has a successor), or
    not_in_model. With ``modelled``, targets outside the model are dropped from the
    reference, which is rescaled over the rest.
    """
    counts = df.groupBy("activity").agg(F.count(F.lit(1)).alias("__n"))
    sim = next_activity(df).groupBy("activity", "next_activity").agg(
        F.count(F.lit(1)).alias("c"))
    sim = sim.withColumn("q", ratio("c", F.sum("c").over(Window.partitionBy("activity")))).drop("c")
    ref = reference.select("activity", "next_activity", "p")
    excluded = None
    if modelled is not None:
        m = modelled.select(F.col("activity").alias("next_activity")).distinct()
        tagged = ref.join(m.withColumn("__in", F.lit(1)), "next_activity", "left")
        excluded = tagged.groupBy("activity").agg(F.coalesce(F.sum(F.when(
            F.col("__in").isNull(), F.col("p"))), F.lit(0.0)).alias("excluded_mass"))
        ref = tagged.filter("__in = 1").drop("__in")
        mass = F.sum("p").over(Window.partitionBy("activity"))
        ref = ref.withColumn("p", F.when(mass > 0, F.col("p") / mass).otherwise(F.col("p")))
    both = ref.join(sim, ["activity", "next_activity"], "full").na.fill(0.0, ["p", "q"])
    tvd = both.groupBy("activity").agg((F.sum(F.abs(F.col("p") - F.col("q"))) * 0.5).alias("tvd"))
    has_next = sim.select("activity").distinct().withColumn("__s", F.lit(1))
    out = (reference.select("activity").distinct().join(counts, "activity", "left")
           .join(has_next, "activity", "left").join(tvd, "activity", "left"))
    status = (F.when(F.col("__n").isNull(), "absent")
              .when(F.col("__s").isNull(), "always_terminal").otherwise("compared"))
    if modelled is not None:
        known = modelled.select("activity").distinct().withColumn("__m", F.lit(1))
        out = out.join(known, "activity", "left").join(excluded, "activity", "left")
        status = F.when(F.col("__m").isNull(), "not_in_model").otherwise(status)
        mass = F.when(F.col("__status") == "compared", F.col("excluded_mass")).otherwise(0.0)
    else:
        mass = F.lit(0.0)
    out = out.withColumn("__status", status)
    return out.select("activity", F.when(F.col("__status") == "compared", F.col("tvd")).alias("tvd"),
                      F.col("__status").alias("status"), mass.alias("excluded_mass"))


def mean_divergence(divergence: DataFrame, digits: int | None = 4) -> DataFrame:
    t = F.col("tvd") if digits is None else F.round("tvd", digits)
    return divergence.agg(F.avg(t).alias("mean_tvd"))


def processing_time_errors(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean and std of observed durations against (activity, mean_s, std_s)."""
    if "work_item_id" in df.columns:
        d = item_sessions(df).withColumn("duration_s", seconds_between("start", "complete"))
        d = d.filter(F.col("duration_s") >= 0)
    else:
        d = fifo_pairs(df)
    sim = d.groupBy("activity").agg(F.avg("duration_s").alias("sim_mean_s"),
                                    F.stddev_samp("duration_s").alias("sim_std_s"))
    ref = reference.select("activity", F.col("mean_s").alias("ref_mean_s"),
                           F.col("std_s").alias("ref_std_s"))
    return ref.join(sim, "activity", "left").withColumn(
        "rel_err_mean", relative_error("sim_mean_s", "ref_mean_s"))


def arrival_rate_error(df: DataFrame, ref_mean_s: float, ref_daily_mean: float) -> DataFrame:
    """One row: mean gap and mean daily arrivals against a reference. The first and last
    day are left out of the daily mean when there are more than two."""
    a = case_arrivals(df)
    gap = arrival_gaps(a).agg(F.avg("gap_s").alias("sim_mean_interarrival_s"))
    days = daily_arrivals(a)
    w = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("n"))
    lo, hi, n = (w.select(c).scalar() for c in ("lo", "hi", "n"))
    inner = days.filter((n <= 2) | ((F.col("date") > lo) & (F.col("date") < hi)))
    out = gap.withColumn("sim_daily_arrivals_mean", total(inner, F.avg("n")))
    return out.withColumns({
        "rel_err": relative_error("sim_mean_interarrival_s", F.lit(float(ref_mean_s))),
        "daily_arrivals_rel_err": relative_error("sim_daily_arrivals_mean",
                                                 F.lit(float(ref_daily_mean)))})


def arrival_profile_error(df: DataFrame, reference: DataFrame) -> DataFrame:
    """profile, mae of the arrival profile against (profile, slot, share)."""
    p = arrival_profile(case_arrivals(df)).select("profile", "slot", F.col("share").alias("x"))
    return p.join(reference.select("profile", "slot", F.col("share").alias("y")),
                  ["profile", "slot"]).groupBy("profile").agg(
        F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"))


def variant_overlap(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Per reference variant (trace, pct): found as is, found without absent activities.

    Reference traces are split into steps and fingerprinted like the log's cases,
    so no trace of the log is written out.
    """
    steps = reference.select("trace", F.posexplode(F.split("trace", ARROW)).alias("position", "activity"))
    steps = steps.withColumn("position", F.col("position").cast("bigint"))
    acts = df.select("activity").distinct().withColumn("__known", F.lit(1))
    strict = steps.groupBy("trace").agg(*fingerprint_of())
    present = steps.join(acts, "activity", "left")
    dropped = present.groupBy("trace").agg(
        F.sum(F.col("__known").isNull().cast("int")).alias("n_ignored"))
    kept = along(present.filter("__known = 1").withColumnRenamed("position", "__p"),
                 ["trace"], ["__p"], {"position": nth()})
    loose = kept.groupBy("trace").agg(*fingerprint_of())
    seen = fingerprints(df).select("fp1", "fp2", "length").distinct().withColumn("__hit", F.lit(True))

    def found(fp, name):
        return fp.join(seen, ["fp1", "fp2", "length"], "left").select(
            "trace", F.coalesce("__hit", F.lit(False)).alias(name))
    out = (reference.select("trace", "pct").join(found(strict, "found"), "trace")
           .join(dropped, "trace").join(found(loose, "__loose"), "trace", "left"))
    loose_hit = (F.col("n_ignored") > 0) & F.coalesce("__loose", F.lit(False))
    return out.withColumn("found_ignoring_absent", F.col("found") | loose_hit).drop("__loose")


def variant_coverage(overlap: DataFrame) -> DataFrame:
    def agg(c):
        return [F.sum(F.col(c).cast("int")).alias(f"n_{c}"),
                F.coalesce(F.sum(F.when(F.col(c), F.col("pct"))), F.lit(0.0)).alias(f"pct_{c}")]
    return overlap.agg(*agg("found"), *agg("found_ignoring_absent"))


def case_stat_errors(df: DataFrame, ref_length: float, ref_duration_s: float,
                     durations: DataFrame | None = None) -> DataFrame:
    """One row: mean case length and duration against a reference. ``durations``
    (case_id, duration_s) replaces first-to-last event times."""
    c = case_spans(df)
    if durations is not None:
        c = c.drop("duration_s").join(durations.select("case_id", "duration_s"), "case_id", "left")
    return c.agg(F.avg("length").alias("sim_case_length_mean"),
                 F.avg("duration_s").alias("sim_case_duration_mean_s")).withColumns({
                     "case_length_rel_err": relative_error("sim_case_length_mean",
                                                           F.lit(float(ref_length))),
                     "case_duration_rel_err": relative_error("sim_case_duration_mean_s",
                                                             F.lit(float(ref_duration_s)))})


def _cells(df: DataFrame, metric: str, key: str | None, values: list[str]) -> DataFrame:
    k = F.col(key) if key else F.lit(None).cast("string")
    cells = F.array(*[F.struct(F.lit(f"{metric}.{v}").alias("metric"),
                               F.col(v).cast("double").alias("value")) for v in values])
    return df.select(k.alias("key"), F.explode(cells).alias("c")).select("c.metric", "key", "c.value")


def evaluate(df: DataFrame, reference: dict, df_all: DataFrame | None = None,
             modelled: DataFrame | None = None, durations: DataFrame | None = None) -> DataFrame:
    """Every comparison as rows (metric, key, value).

    ``reference``: tables branching, processing_times, variants, profile and
    (optional) suspends; numbers mean_gap_s, daily_mean, case_length,
    case_duration_s. Arrival metrics use ``df_all``, the log before any filter to
    finished cases.
    """
    done = completed_only(df)
    df_all = df if df_all is None else df_all
    div = branching_divergence(done, reference["branching"], modelled)
    rate = arrival_rate_error(df_all, reference["mean_gap_s"], reference["daily_mean"])
    stats = case_stat_errors(done, reference["case_length"], reference["case_duration_s"], durations)
    cover = variant_coverage(variant_overlap(done, reference["variants"]))
    parts = [
        _cells(df.agg(F.countDistinct("case_id").alias("n")), "cases", None, ["n"]),
        _cells(div, "branching", "activity", ["tvd"]),
        _cells(mean_divergence(div), "branching", None, ["mean_tvd"]),
        _cells(processing_time_errors(df, reference["processing_times"]), "processing_times",
               "activity", ["rel_err_mean"]),
        _cells(rate, "arrival_rate", None, rate.columns),
        _cells(arrival_profile_error(df_all, reference["profile"]), "arrival_profile", "profile",
               ["mae"]),
        _cells(cover, "variants", None, cover.columns),
        _cells(stats, "case_stats", None, stats.columns)]
    if "suspends" in reference:
        parts.append(_cells(suspend_count_errors(df, reference["suspends"]), "suspends",
                            "activity", ["abs_error"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def artefact_gate(metrics: DataFrame, completion_share: float | None,
                  max_error: float = MAX_DURATION_ERROR,
                  min_completion: float = MIN_COMPLETION) -> DataFrame:
    """One row: duration error, completion share, and whether both are acceptable."""
    err = metrics.filter("metric = 'case_stats.case_duration_rel_err'").agg(
        F.max("value").alias("case_duration_rel_err"))
    share = F.lit(completion_share).cast("double")
    ok = ((F.col("case_duration_rel_err") <= max_error) & (share >= min_completion))
    return err.withColumn("completion_share", share).withColumn(
        "accepted", F.coalesce(ok, F.lit(False)))


def prefix_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """case_id, compared, agree: do two logs run alike up to the shorter trace?

    Events meet on (case, position); no trace is gathered.
    """
    pa = positions(a).select("case_id", "position", F.col("activity").alias("x"))
    pb = positions(b).select("case_id", "position", F.col("activity").alias("y"))
    ids = a.select("case_id").distinct().join(b.select("case_id").distinct(), "case_id")
    same = pa.join(pb, ["case_id", "position"]).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("compared"),
        F.min((F.col("x") == F.col("y")).cast("int")).alias("s"))
    return ids.join(same, "case_id", "left").select(
        "case_id", F.coalesce("compared", F.lit(0)).alias("compared"),
        (F.coalesce("s", F.lit(1)) == 1).alias("agree"))


def adjacency_conformance(df: DataFrame, adjacency: DataFrame) -> DataFrame:
    """One row: directly-follows steps, and the share an adjacency table allows."""
    steps = next_activity(df).groupBy("activity", "next_activity").agg(
        F.count(F.lit(1)).alias("n"))
    ok = adjacency.select("activity", "next_activity").distinct().withColumn("__ok", F.lit(1))
    j = steps.join(ok, ["activity", "next_activity"], "left")
    good = F.sum(F.when(F.col("__ok") == 1, F.col("n")).otherwise(0))
    return j.agg(F.sum("n").alias("n_steps"), good.alias("n_allowed")).withColumn(
        "conformance", ratio("n_allowed", "n_steps"))
