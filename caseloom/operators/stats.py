"""Log statistics: sizes, arrivals, variants, branching, attributes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import (ARROW, END, LOCAL_ZONE, micros, monday_dow, ratio,
                                 seconds_between, total)
from ..functions.ordered import along, nth, preceding, total_upto
from ..functions.quantiles import quantiles
from ..functions.staging import sized
from .shape import (ORDER, bucket, fingerprint_of, first_of_case, next_activity, ntz,
                    order_of, positions, traces, visit_numbers)

RESIDUAL_WEIGHT = 0.01      # fixed value: weight of a label without an entry


def case_spans(df: DataFrame) -> DataFrame:
    """case_id, first, last, length, duration_s."""
    return df.groupBy("case_id").agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.count(F.lit(1)).alias("length")).withColumn(
        "duration_s", seconds_between("first", "last"))


def basic_stats(df: DataFrame) -> DataFrame:
    """One row: cases, events, activities; case length and duration mean/std/min/max."""
    c = case_spans(df)
    out = [F.count(F.lit(1)).alias("n_cases"), F.sum("length").alias("n_events"),
           F.lit(0).alias("__x")]
    for name, v in (("length", F.col("length").cast("double")), ("duration_s", F.col("duration_s"))):
        out += [F.avg(v).alias(f"{name}_mean"), F.stddev_samp(v).alias(f"{name}_std"),
                F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max")]
    acts = df.select("activity").distinct()
    return c.agg(*out).drop("__x").withColumn(
        "n_activities", total(acts, F.count(F.lit(1))))


def activity_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


def case_arrivals(df: DataFrame) -> DataFrame:
    """case_id, arrival: the first event of every case."""
    return df.groupBy("case_id").agg(F.min("timestamp").alias("arrival"))


def arrival_gaps(arrivals: DataFrame) -> DataFrame:
    """Positive gaps between consecutive arrivals over the whole log.

    Cases arriving at the same instant have gap 0 and are dropped, so only
    distinct instants are ordered.
    """
    t = arrivals.select("arrival").distinct()
    out = along(t, [], ["arrival"], {"previous_arrival": preceding("arrival")})
    return (out.filter(F.col("previous_arrival").isNotNull())
            .withColumn("gap_s", seconds_between("previous_arrival", "arrival")))


def arrival_rate(arrivals: DataFrame) -> DataFrame:
    """One row: gap count, mean, std and arrivals per day."""
    g = arrival_gaps(arrivals).agg(
        F.count(F.lit(1)).alias("n_gaps"), F.avg("gap_s").alias("mean_s"),
        F.stddev_pop("gap_s").alias("std_s"))
    return g.withColumn("arrivals_per_day", ratio(F.lit(86400.0), "mean_s"))


def daily_arrivals(arrivals: DataFrame) -> DataFrame:
    return arrivals.groupBy(F.to_date("arrival").alias("date")).agg(
        F.count(F.lit(1)).alias("n"))


def daily_arrival_stats(arrivals: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    return daily_arrivals(arrivals).agg(
        F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"),
        F.min("n").alias("min"), F.max("n").alias("max"))


def arrival_profile(arrivals: DataFrame) -> DataFrame:
    """profile (hod|dow), slot, n, share; empty slots count 0."""
    spark = arrivals.sparkSession
    cells = arrivals.select(F.explode(F.array(
        F.struct(F.lit("hod").alias("profile"), F.hour("arrival").alias("slot")),
        F.struct(F.lit("dow").alias("profile"), monday_dow("arrival").alias("slot"))))
        .alias("c")).groupBy("c.profile", "c.slot").agg(F.count(F.lit(1)).alias("n"))
    spine = spark.range(1).select(F.explode(F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(23)),
                    lambda i: F.struct(F.lit("hod").alias("profile"), i.alias("slot"))),
        F.transform(F.sequence(F.lit(0), F.lit(6)),
                    lambda i: F.struct(F.lit("dow").alias("profile"), i.alias("slot")))))
        .alias("s")).select("s.*")
    out = spine.join(cells, ["profile", "slot"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy("profile"))))


def variants(df: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent traces: rank, frequency, pct, trace, total_variants.

    Variants are counted by fingerprint; only one case per reported variant has
    its trace written out. Equal frequencies rank by smallest case id.
    """
    v = variant_counts(df)
    best = v.orderBy(F.col("frequency").desc(), "example_case").limit(top)
    w = Window.orderBy(F.col("frequency").desc(), "example_case")
    best = best.withColumn("rank", F.row_number().over(w))
    best = best.withColumn("pct", F.col("frequency") * 100.0
                           / total(df, F.countDistinct("case_id")))
    best = best.withColumn("total_variants", total(v, F.count(F.lit(1))))
    shown = df.join(F.broadcast(best.select(F.col("example_case").alias("case_id"))),
                    "case_id", "left_semi")       # at most `top` cases
    t = traces(shown).select(F.col("case_id").alias("example_case"),
                             F.array_join("trace", ARROW).alias("trace"))
    return best.join(t, "example_case").select(
        "rank", "frequency", "pct", "trace", "total_variants")


def variant_counts(df: DataFrame) -> DataFrame:
    """fp1, fp2, length, frequency, example_case for every variant."""
    per_case = positions(df).groupBy("case_id").agg(*fingerprint_of())
    return per_case.groupBy("fp1", "fp2", "length").agg(
        F.count(F.lit(1)).alias("frequency"), F.min("case_id").alias("example_case"))


def branching(df: DataFrame) -> DataFrame:
    """activity, next_activity, n, p."""
    c = next_activity(df).groupBy("activity", "next_activity").agg(
        F.count(F.lit(1)).alias("n"))
    return c.withColumn("p", ratio("n", F.sum("n").over(Window.partitionBy("activity"))))


def branching_by_visit(df: DataFrame, cap: int = 3, min_samples: int = 30) -> DataFrame:
    """activity, visit_bucket, next_activity, n, p; sparse buckets are left out."""
    steps = visit_numbers(next_activity(df, keep_last=True), cap)
    c = (steps.filter(F.col("next_activity").isNotNull())
         .groupBy("activity", "visit_bucket", "next_activity")
         .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("activity", "visit_bucket")
    c = c.withColumn("__t", F.sum("n").over(w)).filter(F.col("__t") >= min_samples)
    return c.withColumn("p", ratio("n", "__t")).drop("__t")


def _best(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("p").desc(), "next_activity")
    return table.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def predict_next(rows: DataFrame, by_visit: DataFrame, overall: DataFrame,
                 terminal: Sequence[str] = (), cap: int = 3) -> DataFrame:
    """Most probable successor of (activity, visit): bucket table, then overall table.

    Terminal activities, and activities without an entry, predict null.
    """
    a = _best(sized(by_visit), ["activity", "visit_bucket"]).select(
        "activity", F.col("visit_bucket").alias("__b"),
        F.col("next_activity").alias("__n1"), F.col("p").alias("__p1"))
    b = _best(sized(overall), ["activity"]).select(
        "activity", F.col("next_activity").alias("__n2"), F.col("p").alias("__p2"))
    j = (rows.withColumn("__b", bucket("visit", cap))
         .join(a, ["activity", "__b"], "left").join(b, "activity", "left"))
    stop = F.col("activity").isin(list(terminal)) if terminal else F.lit(False)
    return (j.withColumn("predicted", F.when(~stop, F.coalesce("__n1", "__n2")))
            .withColumn("probability", F.when(~stop, F.coalesce("__p1", "__p2")))
            .drop("__b", "__n1", "__n2", "__p1", "__p2"))


def directly_follows(df: DataFrame) -> DataFrame:
    """kind (edge|start|end), source, target, n."""
    e = along(df, ["case_id"], order_of(df), {
        "__prev": preceding("activity"), "__rn": nth()})
    # one pass: each row is an edge from its predecessor, or a start
    edges = e.groupBy(
        F.when(F.col("__rn") == 0, "start").otherwise("edge").alias("kind"),
        F.col("__prev").alias("source"), F.col("activity").alias("target")).agg(
        F.count(F.lit(1)).alias("n"))
    at = F.struct(*[F.col(c) for c in order_of(df)])
    ends = df.groupBy("case_id").agg(F.max_by("activity", at).alias("source")) \
        .groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return edges.unionByName(ends.select(
        F.lit("end").alias("kind"), "source", F.lit(None).cast("string").alias("target"), "n"))


def legal_candidates(table: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Branching table cut to allowed successors, always keeping the likeliest one.

    ``adjacency`` is (activity, next_activity). An activity without any entry
    there is not cut. Shares are renormalised.
    """
    allowed = adjacency.select("activity", "next_activity").distinct().withColumn(
        "__ok", F.lit(True))
    known = adjacency.select("activity").distinct().withColumn("__known", F.lit(True))
    w = Window.partitionBy("activity").orderBy(F.col("p").desc(), "next_activity")
    j = (table.withColumn("__r", F.row_number().over(w))
         .join(allowed, ["activity", "next_activity"], "left")
         .join(known, "activity", "left"))
    keep = F.col("__known").isNull() | F.col("__ok").isNotNull() | (F.col("__r") == 1)
    j = j.filter(keep).drop("__r", "__ok", "__known")
    return j.withColumn("p", ratio("p", F.sum("p").over(Window.partitionBy("activity"))))


def category_shares(df: DataFrame, column: str, given: str | None = None) -> DataFrame:
    """Share of each value of a case attribute, overall or within a parent attribute."""
    keys = [given] if given else []
    first = first_of_case(df, [column, *keys])
    c = (first.filter(F.col(column).isNotNull()).groupBy(*keys, column)
         .agg(F.count(F.lit(1)).alias("n")))
    part = F.sum("n").over(Window.partitionBy(*keys)) if keys else total(c, F.sum("n"))
    return c.withColumn("share", ratio("n", part))


def resource_profile(df: DataFrame, top: int = 20) -> DataFrame:
    """resource, n_events, in_top, activities (sorted set)."""
    r = df.filter(F.col("resource").isNotNull())
    # (resource, activity) pairs are counted first, so a busy resource is small here
    pairs = r.groupBy("resource", "activity").agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy("resource").agg(
        F.sum("n").alias("n_events"), F.sort_array(F.collect_set("activity")).alias("activities"))
    lead = per.select("resource", "n_events").orderBy(
        F.col("n_events").desc(), "resource").limit(top).select(
        "resource", F.lit(True).alias("__t"))
    return (per.join(F.broadcast(lead), "resource", "left")
            .withColumn("in_top", F.coalesce("__t", F.lit(False))).drop("__t"))


def time_range(df: DataFrame) -> DataFrame:
    r = df.agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    return r.withColumn("span_days", seconds_between("start", "end") / F.lit(86400.0))


def arrival_features(arrivals: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Cyclic calendar features of the previous arrival and log gap in minutes."""
    local = arrivals.select(F.convert_timezone(
        F.lit("UTC"), F.lit(zone), F.col("arrival")).alias("local"), "arrival")
    g = along(local.distinct(), [], ["arrival"], {
        "__p": preceding("arrival"), "__c": preceding("local")})
    g = g.filter(F.col("__p").isNotNull())
    gap = seconds_between("__p", "arrival") / F.lit(60.0)
    c = F.col("__c")

    def wave(v: Column, period: float, name: str):
        x = v * F.lit(2 * math.pi) / F.lit(period)
        return [F.sin(x).alias(f"{name}_sin"), F.cos(x).alias(f"{name}_cos")]
    hod = F.hour(c) + F.minute(c) / F.lit(60.0)
    dow = monday_dow(c)
    return g.filter(gap > 0).select(
        "arrival", *wave(hod, 24.0, "hod"), *wave(dow, 7.0, "dow"),
        *wave(F.dayofyear(c), 365.0, "doy"),
        (dow >= 5).cast("double").alias("weekend"), F.log(gap).alias("log_gap_min"))


def open_cases_per_day(arrivals: DataFrame, completions: DataFrame, start, days: int) -> DataFrame:
    """day, open_cases: arrived minus completed before the end of each day.

    Arrivals and completions are first counted per day, so the running totals
    see one row per day.
    """
    def daily(df, c, sign):
        gap = F.timestamp_diff("MICROSECOND", ntz(start), F.col(c))
        day = F.greatest(F.floor(gap / F.lit(86400e6)), F.lit(0))
        return df.groupBy(day.alias("day")).agg((F.count(F.lit(1)) * sign).alias("d"))
    moves = daily(arrivals, "arrival", 1).unionByName(daily(completions, "completion", -1))
    spine = arrivals.sparkSession.range(days).select(F.col("id").alias("day"))
    per = spine.join(moves.groupBy("day").agg(F.sum("d").alias("d")), "day", "left") \
        .withColumn("d", F.coalesce("d", F.lit(0)))
    out = along(per, [], ["day"], {"open_cases": total_upto("d")})
    return out.select("day", "open_cases")


def back_to_back(df: DataFrame) -> DataFrame:
    """One row: ``complete`` rows whose predecessor in log order has the same
    resource and activity."""
    o = along(df, [], order_of(df), {"__r": preceding("resource"), "__a": preceding("activity")})
    hit = ((F.col("lifecycle") == "complete") & F.col("resource").eqNullSafe(F.col("__r"))
           & F.col("activity").eqNullSafe(F.col("__a")))
    return o.agg(F.coalesce(F.sum(hit.cast("bigint")), F.lit(0)).alias("pairs"))


def mean_span_hours(df: DataFrame) -> DataFrame:
    return case_spans(df).agg(F.coalesce(F.avg(F.col("duration_s") / 3600.0), F.lit(0.0))
                              .alias("mean_hours"))


def bands(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Count, median, mean and max of a value per band (lo, hi]."""
    v = F.col(value)
    label = None
    for lo, hi in zip(edges, edges[1:]):
        name = f"({lo:g}, {hi:g}]"
        cond = (v > lo) & (v <= hi)
        label = F.when(cond, name) if label is None else label.when(cond, name)
    b = df.select(label.alias("band"), value).filter(F.col("band").isNotNull())
    agg = b.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                                F.max(value).alias("max"))
    return agg.join(quantiles(b, ["band"], value, {"median": 0.5}), "band")


def branch_weights(options: DataFrame, decision_table: DataFrame, visit_table: DataFrame,
                   overall: DataFrame, decision_cap: int = 5, visit_cap: int = 3) -> DataFrame:
    """Choice probabilities for decision rows, by a cascade of tables.

    ``options`` is (row, dp_key, dp_visit, activity, visit, label), one row per
    label on offer. The first table with an entry for the row supplies the
    weights: decision point and visit bucket, decision point over all visits,
    activity and visit bucket, activity. A label missing there weighs
    ``RESIDUAL_WEIGHT``. Adds ``source`` and ``p``.
    """
    visit_table, overall = sized(visit_table), sized(overall)
    dec = sized(decision_table).select("dp_key", F.col("bucket").alias("__b"),
                                F.col("label").alias("label"), F.col("p").alias("__p"))
    def keyed(t, keys, tag, label="label"):
        p = t.select(*keys, F.col(label).alias("label"), F.col("__p").alias(f"__p_{tag}"))
        has = t.groupBy(*keys).agg(F.max((F.col(label) != END).cast("int")).alias(f"__h_{tag}"))
        return p, has
    o = options.withColumn("__b", bucket("dp_visit", decision_cap)) \
               .withColumn("__v", bucket("visit", visit_cap))
    sources = [
        (dec, ["dp_key", "__b"], "dp", "label"),
        (dec.filter("__b = 'all'").drop("__b"), ["dp_key"], "all", "label"),
        (visit_table.select("activity", F.col("visit_bucket").alias("__v"),
                            "next_activity", F.col("p").alias("__p")),
         ["activity", "__v"], "visit", "next_activity"),
        (overall.select("activity", "next_activity", F.col("p").alias("__p")),
         ["activity"], "global", "next_activity")]
    for t, keys, tag, label in sources:
        p, has = keyed(t, keys, tag, label)
        o = o.join(has, keys, "left").join(p, [*keys, "label"], "left")
    # a decision entry that only knows the end label is skipped, like a missing one
    dp_used = F.when(F.col("__h_dp").isNotNull(), F.col("__h_dp") == 1) \
               .otherwise(F.coalesce(F.col("__h_all") == 1, F.lit(False)))
    source = (F.when(dp_used & F.col("__h_dp").isNotNull(), "decision")
              .when(dp_used, "decision_all")
              .when(F.col("__h_visit").isNotNull(), "visit").otherwise("global"))
    weight = (F.when(source == "decision", F.col("__p_dp"))
              .when(source == "decision_all", F.col("__p_all"))
              .when(source == "visit", F.col("__p_visit")).otherwise(F.col("__p_global")))
    o = o.withColumn("source", source).withColumn(
        "__w", F.coalesce(weight, F.lit(RESIDUAL_WEIGHT)))
    o = o.withColumn("p", ratio("__w", F.sum("__w").over(Window.partitionBy("row"))))
    return o.select(*options.columns, "source", "p")


def arrivals_in_horizon(df: DataFrame, start, days: float, zone: str | None = None) -> DataFrame:
    """Case arrivals in local time, zone dropped, within [start, start + days)."""
    a = case_arrivals(df)
    if zone:
        a = a.withColumn("arrival", F.convert_timezone(
            F.lit("UTC"), F.lit(zone), F.col("arrival")))
    into = F.timestamp_diff("MICROSECOND", ntz(start), F.col("arrival"))
    return a.filter((into >= 0) & (into < F.lit(int(days * 86400e6))))
