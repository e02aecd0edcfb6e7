"""Pairing of lifecycle transitions into instances and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import START, monday_dow, seconds_between
from ..functions.ordered import (along, by_part, following, lowest_before, lowest_upto, nth, preceding,
                                 total_upto)
from .shape import ntz, order_of

OPEN = ("start", "resume")
CLOSE = ("suspend", "complete")


def pair_by_rank(df: DataFrame, opens: Sequence[str] = ("start", "assign"),
                 closes: Sequence[str] = ("complete",)) -> DataFrame:
    """The k-th opening of a (case, activity) paired with its k-th closing.

    Both sides are numbered in one pass and meet in a group-by on
    (case, activity, k): one shuffle and no self-join.
    """
    lc = F.lower(F.col("lifecycle"))
    is_open, is_close = lc.isin(list(opens)), lc.isin(list(closes))
    rows = df.filter(is_open | is_close).withColumn("__o", is_open.cast("int"))
    rows = along(rows, ["case_id", "activity"], order_of(df), {
        "__n_o": total_upto(F.col("__o")), "__n_c": total_upto(1 - F.col("__o"))})
    rows = rows.withColumn("seq", F.when(F.col("__o") == 1, F.col("__n_o"))
                           .otherwise(F.col("__n_c")) - 1)
    opened, closed = F.col("__o") == 1, F.col("__o") == 0
    aggs = [F.max(F.when(opened, F.col("timestamp"))).alias("start"),
            F.max(F.when(closed, F.col("timestamp"))).alias("complete")]
    if "event_order" in df.columns:
        aggs.append(F.max(F.when(opened, F.col("event_order"))).alias("event_order"))
    if "resource" in df.columns:
        aggs += [F.max(F.when(opened, F.col("resource"))).alias("start_resource"),
                 F.max(F.when(closed, F.col("resource"))).alias("complete_resource")]
    p = rows.groupBy("case_id", "activity", "seq").agg(*aggs)
    p = p.filter(F.col("start").isNotNull() & F.col("complete").isNotNull())
    return p.withColumn("duration_s", seconds_between("start", "complete"))


def processing_times(df: DataFrame) -> DataFrame:
    """Start-to-complete durations >= 0; without a lifecycle column, gaps to the next event."""
    if "lifecycle" not in df.columns:
        return gaps_to_next(df)
    return pair_by_rank(df).filter(F.col("duration_s") >= 0)


def gaps_to_next(df: DataFrame) -> DataFrame:
    """Duration of an event as the gap to the next event of its case."""
    out = along(df, ["case_id"], order_of(df), {"complete": following("timestamp")})
    return (out.withColumn("duration_s", seconds_between("timestamp", "complete"))
            .filter(F.col("duration_s") >= 0)
            .select("case_id", "activity", F.col("timestamp").alias("start"), "complete",
                    "duration_s"))


def instance_features(df: DataFrame, max_seconds: float = 365 * 86400.0) -> DataFrame:
    """Paired instances with the context features of the duration model."""
    p = pair_by_rank(df, opens=("start",)).filter(
        (F.col("duration_s") > 0) & (F.col("duration_s") <= max_seconds))
    p = along(p, ["case_id"], ["start", "event_order"], {
        "case_position": nth(), "__prev": preceding("activity"),
        "__first": lowest_upto("start")})
    return p.select(
        "case_id", "activity", F.col("start_resource").alias("resource"),
        F.col("start").alias("timestamp"), "event_order", "duration_s", "case_position",
        F.col("case_position").alias("n_previous_activities"),
        F.coalesce("__prev", F.lit(START)).alias("previous_activity"),
        seconds_between("__first", "start").alias("case_age_seconds"),
        monday_dow("start").alias("day_of_week"), F.hour("start").alias("hour_of_day"))


def fifo_pairs(df: DataFrame) -> DataFrame:
    """First-in-first-out pairing; a ``complete`` with no waiting ``start`` is ignored.

    A complete is an orphan exactly when it takes the running balance of starts
    over completes to a new minimum below zero.
    """
    keys, order = ["case_id", "activity"], order_of(df)
    rows = df.filter(F.col("lifecycle").isin("start", "complete"))
    move = F.when(F.col("lifecycle") == "start", 1).otherwise(-1)

    def balance(part, run):
        part = run(part, order, {"__bal": total_upto(move)})
        return run(part, order, {"__low": lowest_before("__bal")})
    rows = by_part(rows, keys, balance)
    orphan = ((F.col("lifecycle") == "complete") & (F.col("__bal") < 0)
              & (F.col("__bal") < F.coalesce("__low", F.lit(0))))
    return pair_by_rank(rows.filter(~orphan).drop("__bal", "__low"), opens=("start",))


def item_sessions(df: DataFrame) -> DataFrame:
    """Sessions per work item: an opening directly followed by a closing transition."""
    rows = df.filter(F.col("work_item_id").isNotNull()
                     & F.col("lifecycle").isin(*OPEN, *CLOSE))
    here = F.struct("case_id", "activity", "resource", "timestamp", "lifecycle", "event_order")
    rows = along(rows, ["work_item_id"], order_of(df), {"__p": preceding(here)})
    ok = F.col("__p.lifecycle").isin(*OPEN) & F.col("lifecycle").isin(*CLOSE)
    return rows.filter(ok).select(
        F.col("__p.case_id").alias("case_id"), F.col("__p.activity").alias("activity"),
        F.col("__p.resource").alias("resource"), F.col("__p.timestamp").alias("start"),
        F.col("timestamp").alias("complete"), "work_item_id",
        F.col("__p.event_order").alias("event_order"))


def paired_instances(df: DataFrame) -> DataFrame:
    """case_id, activity, resource, start, complete: work-item sessions if the log
    has work items, else start/complete pairs with the completing resource first."""
    if "work_item_id" in df.columns:
        return item_sessions(df)
    p = pair_by_rank(df, opens=("start",))
    return p.select("case_id", "activity",
                    F.coalesce("complete_resource", "start_resource").alias("resource"),
                    "start", "complete", "event_order")


def _by_day(df: DataFrame, start: str, end: str) -> DataFrame:
    """Cut [start, end) at midnights; adds ``day``."""
    days = df.filter(F.col(end) > F.col(start)).withColumn(
        "day", F.explode(F.sequence(F.to_date(start), F.to_date(end))))
    day0 = F.col("day").cast("timestamp_ntz")
    lo = F.greatest(F.col(start), day0)
    hi = F.least(F.col(end), day0 + F.expr("interval 1 day"))
    return days.withColumns({start: lo, end: hi}).filter(F.col(end) > F.col(start))


def clipped_to_window(sessions: DataFrame, window) -> DataFrame:
    """Sessions cut to an evaluation window; sessions outside it are dropped."""
    lo, hi = F.greatest("start", ntz(window[0])), F.least("complete", ntz(window[1]))
    return sessions.filter(hi > lo).withColumns({"start": lo, "complete": hi})


def busy_pieces(sessions: DataFrame, intervals: DataFrame | None = None,
                window=None) -> DataFrame:
    """Session time inside availability intervals and an evaluation window.

    Sessions and intervals are cut at midnight and meet in an equi-join on
    (resource, day): no range join, and no pair is counted twice. Returns the
    session columns with ``seconds``, one row per piece.
    """
    s = sessions if window is None else clipped_to_window(sessions, window)
    if intervals is None:
        return s.withColumn("seconds", seconds_between("start", "complete"))
    a = _by_day(intervals.select("resource", "avail_start", "avail_end"),
                "avail_start", "avail_end")
    j = _by_day(s, "start", "complete").join(a, ["resource", "day"])
    sec = seconds_between(F.greatest("start", "avail_start"), F.least("complete", "avail_end"))
    return j.withColumn("seconds", sec).filter(F.col("seconds") > 0) \
            .drop("day", "avail_start", "avail_end")


def with_resource(df: DataFrame) -> DataFrame:
    return df.filter(F.col("resource").isNotNull() & (F.col("resource") != ""))


def in_window(sessions: DataFrame, window) -> DataFrame:
    """Sessions that touch the window, uncut."""
    if window is None:
        return sessions
    return sessions.filter((F.col("complete") > ntz(window[0])) & (F.col("start") < ntz(window[1])))


def is_open(c: Column) -> Column:
    return c.isin(*OPEN)
