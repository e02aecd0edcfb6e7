"""Projections, filters, ordering and numbering of an event log.

A log has the columns ``case_id, activity, timestamp`` and, where an operator
needs them, ``resource``, ``lifecycle`` and ``event_order``. ``event_order``
breaks timestamp ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import START, col, monday_dow, starts_with_any
from ..functions.ordered import along, following, nth, preceding
from ..functions.staging import sized

ORDER = ["timestamp", "event_order"]


def order_of(df: DataFrame) -> list[str]:
    return [c for c in ORDER if c in df.columns]


def number_events(df: DataFrame, source_order: str = "event_order") -> DataFrame:
    """Replace the source-order column by the event's place in its case, from 0."""
    out = along(df, ["case_id"], ["timestamp", source_order], {"__order": nth()})
    return out.drop(source_order, "event_order").withColumnRenamed("__order", "event_order")


def one_per_occurrence(df: DataFrame) -> DataFrame:
    """``complete`` rows, and ``start`` rows of activities that never complete.

    One row per activity is aggregated and joined back: no window over the log.
    """
    low = F.lower(F.col("lifecycle"))
    never = (df.groupBy("activity").agg(F.max(F.coalesce(low == "complete", F.lit(False)))
                                        .alias("done"))
             .filter(~F.col("done")).select("activity"))
    starts = df.filter(low == "start").join(sized(never), "activity", "left_semi")
    return df.filter(low == "complete").unionByName(starts.select(*df.columns))


def completed_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("lifecycle") == "complete")


def event_class(c="activity") -> Column:
    """W for work items, AO for application/offer milestones, else other."""
    return (F.when(starts_with_any(c, ["W_"]), "W")
            .when(starts_with_any(c, ["A_", "O_"]), "AO").otherwise("other"))


def with_prefixes(df: DataFrame, prefixes: Sequence[str] | None,
                  column: str = "activity") -> DataFrame:
    """Rows whose label starts with a prefix. None keeps all, an empty list none."""
    if prefixes is None:
        return df
    return df.filter(starts_with_any(column, list(prefixes)))


def next_activity(df: DataFrame, keep_last: bool = False) -> DataFrame:
    out = along(df, ["case_id"], order_of(df), {"next_activity": following("activity")})
    return out if keep_last else out.filter(F.col("next_activity").isNotNull())


def previous_activity(df: DataFrame, sentinel: str = START) -> DataFrame:
    out = along(df, ["case_id"], order_of(df), {"previous_activity": preceding("activity")})
    return out.withColumn("previous_activity",
                          F.coalesce("previous_activity", F.lit(sentinel)))


def bucket(visit, cap: int) -> Column:
    """Visit numbers 1, 2, ... with ``cap`` and above pooled as ``cap+``."""
    v = col(visit)
    return F.when(v < cap, v.cast("string")).otherwise(F.lit(f"{cap}+"))


def visit_numbers(df: DataFrame, cap: int = 3) -> DataFrame:
    """1-based visit of the activity in its case, and its bucket."""
    out = along(df, ["case_id", "activity"], order_of(df), {"__v": nth()})
    return (out.withColumn("visit", F.col("__v") + 1).drop("__v")
            .withColumn("visit_bucket", bucket("visit", cap)))


def resource_coverage(df: DataFrame) -> DataFrame:
    """Active-day coverage per resource and whether it stays under the weekday ceiling.

    Needs ``date``. The ceiling is the share of weekdays in the log's day span.
    """
    span = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((monday_dow("day") < 5).cast("int")).alias("w"))
    n = days.select("n").scalar()
    ceiling = days.select(F.col("w") / F.col("n")).scalar()
    per = (df.filter(F.col("resource").isNotNull()).groupBy("resource")
           .agg(F.countDistinct("date").alias("active_days")))
    return per.select("resource", "active_days", (F.col("active_days") / n).alias("coverage"),
                      F.when(F.col("active_days") / n > ceiling, "system")
                      .otherwise("human").alias("role"))


def human_work(df: DataFrame, origin: str = "Workflow",
               coverage: DataFrame | None = None) -> DataFrame:
    """Events of the given origin done by human accounts."""
    coverage = resource_coverage(df) if coverage is None else coverage
    humans = coverage.filter(F.col("role") == "human").select("resource")
    return df.filter(F.col("event_origin") == origin).join(sized(humans), "resource", "left_semi")


def traces(df: DataFrame) -> DataFrame:
    """case_id, trace (array of activities in order).

    One output value holds a whole case. Operators that only compare or count
    traces use ``fingerprints`` instead.
    """
    step = F.struct(*[F.col(c) for c in order_of(df)], F.col("activity").alias("__a"))
    return df.groupBy("case_id").agg(F.transform(
        F.array_sort(F.collect_list(step)), lambda s: s["__a"]).alias("trace"))


def positions(df: DataFrame) -> DataFrame:
    """Add ``position``, the place of the event in its case from 0."""
    return along(df, ["case_id"], order_of(df), {"position": nth()})


def fingerprint_of(activity="activity", position="position") -> list[Column]:
    """Aggregates that identify an ordered trace without gathering it.

    Two 64-bit folds over (position, activity) and the length. The folds combine
    map-side, so a case of any length costs one row per task. Different traces
    share all three with a chance of about 2^-128.
    """
    a, p = col(activity), col(position)
    return [F.bit_xor(F.xxhash64(p, a)).alias("fp1"),
            F.bit_xor(F.xxhash64(a, F.lit("·"), p)).alias("fp2"),
            F.count(F.lit(1)).alias("length")]


def fingerprints(df: DataFrame) -> DataFrame:
    """case_id, fp1, fp2, length: equal for two cases when their traces are equal."""
    return positions(df).groupBy("case_id").agg(*fingerprint_of())


def restrict_to_cases(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the listed cases; ``ids`` has a ``case_id`` column."""
    return df.join(ids.select(F.col("case_id")), "case_id", "left_semi")


def first_of_case(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The first row of every case, by aggregation (no per-case sort)."""
    keep = [c for c in (columns or df.columns) if c != "case_id"]
    at = F.struct(*[F.col(c) for c in order_of(df)])
    return df.groupBy("case_id").agg(
        F.min_by(F.struct(*[F.col(c) for c in keep]), at).alias("__r")
    ).select("case_id", "__r.*")


def after_warmup(df: DataFrame, arrivals: DataFrame, horizon_start, horizon_end,
                 warmup_days: float) -> DataFrame:
    """Events of cases that arrive at or after the warm-up cutoff.

    ``arrivals`` is (case_id, arrival); the horizon bounds are datetimes.
    """
    from datetime import timedelta
    if warmup_days <= 0:
        return df
    cutoff = horizon_start + timedelta(days=warmup_days)
    if cutoff >= horizon_end:
        raise ValueError("warm-up must end before the horizon does")
    late = arrivals.filter(F.col("arrival") >= ntz(cutoff))
    return restrict_to_cases(df, late)


def ntz(t) -> Column:
    """A datetime, date-time text or Column as a TIMESTAMP_NTZ column."""
    if isinstance(t, Column):
        return t
    return F.lit(str(t)).cast("timestamp_ntz")


def clip_intervals(intervals: DataFrame, start, end) -> DataFrame:
    """Availability intervals cut to [start, end]; empty ones are dropped."""
    lo = F.greatest("avail_start", ntz(start))
    hi = F.least("avail_end", ntz(end))
    return intervals.filter(hi > lo).withColumns({"avail_start": lo, "avail_end": hi})


def usable_durations(df: DataFrame, column: str, minimum: float = 0.0,
                     strict: bool = True) -> DataFrame:
    """Rows with a finite duration above (or at) ``minimum``."""
    c = F.col(column)
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return df.filter(ok & ((c > minimum) if strict else (c >= minimum)))


def label_dictionary(df: DataFrame, column: str, sentinels: Sequence[str]) -> DataFrame:
    """(label, code) in label order, always holding the sentinels.

    Labels are numbered on the distinct values only.
    """
    extra = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in sentinels])).alias("label"))
    labels = (df.select(F.col(column).cast("string").alias("label"))
              .filter(F.col("label").isNotNull()).unionByName(extra).distinct())
    return along(labels, [], ["label"], {"code": nth()})


def encode(df: DataFrame, column: str, dictionary: DataFrame, fallback: str,
           name: str) -> DataFrame:
    """Add ``name``: the label's code, or the fallback's code for unseen labels."""
    dictionary = sized(dictionary)
    d = dictionary.select(F.col("label").alias("__l"), F.col("code").alias("__c"))
    spare = dictionary.filter(F.col("label") == fallback).select("code").scalar()
    return (df.join(d, F.col(column) == F.col("__l"), "left")
            .withColumn(name, F.coalesce("__c", spare)).drop("__l", "__c"))
