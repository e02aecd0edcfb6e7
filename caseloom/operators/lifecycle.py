"""Work-item lifecycle: schedule -> start -> (suspend -> resume)* -> terminal.

The state of a work item is read off running values over (case, activity), so
no row is looked at in Python. An item is in one of three states before a row:
N (no start since the last terminal), R (running) or S (suspended).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import (CASE_END, START, TERMINALS, fractional_hour, monday_dow, ratio,
                                 seconds_between, starts_with_any)
from ..functions.ordered import (along, by_part, following, latest_before, latest_upto, nth, preceding,
                                 total_before)
from ..functions.quantiles import quantiles
from . import fit
from .pairing import OPEN
from .shape import order_of
from .stats import case_spans

KEYS = ["case_id", "activity"]
# The seven transitions of the grammar, and the usual column order.
TRANSITIONS = ("schedule", "start", "suspend", "resume", "complete", "ate_abort", "withdraw")
RUNTIME_SCALE = 0.724763        # fixed value: factor reported with the case-duration envelope


def work_rows(df: DataFrame) -> DataFrame:
    return (df.withColumn("lifecycle", F.lower("lifecycle"))
            .filter(starts_with_any("activity", ["W_"])
                    & F.col("lifecycle").isin(*TRANSITIONS)))


def segment(df: DataFrame) -> DataFrame:
    """Every work-item transition with its instance number and what it means.

    Adds ``instance``, ``state`` (N, R, S before the row), ``running_since``,
    ``suspended_at``, ``created_at``/``created_by`` and the flags ``opens``,
    ``stops``, ``terminal``. All passes share one partitioning and order, so the
    log is shuffled and sorted once.
    """
    order = order_of(df)
    return by_part(work_rows(df), KEYS, lambda rows, run: _segment(rows, order, run))


def _segment(rows: DataFrame, order: list[str], run) -> DataFrame:
    lc = F.col("lifecycle")
    w = run(rows, order, {
        "pos": nth(), "instance": total_before(lc.isin(*TERMINALS).cast("int"))})
    pos = F.col("pos")
    w = run(w, order, {
        "__term": latest_before(F.when(lc.isin(*TERMINALS), pos)),
        "__start": latest_before(F.when(lc == "start", pos)),
        "__make": latest_before(F.when(lc.isin("schedule", "start"), pos)),
        "__move": latest_before(F.when(lc.isin("start", "suspend", "resume"), lc))})
    floor = F.coalesce("__term", F.lit(-1))
    started = F.coalesce("__start", F.lit(-1)) > floor
    w = w.withColumn("state", F.when(~started, "N")
                     .when(F.col("__move") == "suspend", "S").otherwise("R"))
    w = w.withColumns({
        "opens": (lc == "start") | ((lc == "resume") & (F.col("state") == "S")),
        "stops": (lc == "suspend") & (F.col("state") == "R"),
        "terminal": lc.isin(*TERMINALS),
        "__creates": lc.isin("schedule", "start")
        & (F.coalesce("__make", F.lit(-1)) <= floor)})
    w = run(w, order, {
        "running_since": latest_before(F.when(F.col("opens"), F.col("timestamp"))),
        "suspended_at": latest_before(F.when(F.col("stops"), F.col("timestamp"))),
        "__made": latest_upto(F.when(F.col("__creates"),
                                     F.struct("pos", "timestamp", "lifecycle")))})
    alive = F.col("__made.pos") > floor
    return w.withColumns({
        "created_at": F.when(alive, F.col("__made.timestamp")),
        "created_by": F.when(alive, F.col("__made.lifecycle"))}).drop(
        "pos", "__term", "__start", "__make", "__move", "__creates", "__made")


def active_sessions(seg: DataFrame) -> DataFrame:
    """Running sessions: activity, outcome (suspend|complete|abort), seconds >= 0."""
    ends = F.col("lifecycle").isin("suspend", "complete", "ate_abort") & (F.col("state") == "R")
    out = seg.filter(ends).withColumn("seconds", seconds_between("running_since", "timestamp"))
    return out.withColumn("outcome", F.when(F.col("lifecycle") == "ate_abort", "abort")
                          .otherwise(F.col("lifecycle")))


def session_end_hazard(seg: DataFrame) -> DataFrame:
    """activity, n_complete, n_suspend, n_abort, p_complete = c / (c + s)."""
    s = active_sessions(seg)

    def n(o):
        return F.sum((F.col("outcome") == o).cast("int"))
    c, u = F.col("n_complete"), F.col("n_suspend")
    return s.groupBy("activity").agg(
        n("complete").alias("n_complete"), n("suspend").alias("n_suspend"),
        n("abort").alias("n_abort")).withColumn(
        "p_complete", F.coalesce(ratio(c, c + u), F.lit(0.0)))


def suspend_end_hazard(seg: DataFrame) -> DataFrame:
    """activity, n_resume, n_abort, p_resume = r / (r + a)."""
    lc = F.col("lifecycle")
    s = seg.filter((F.col("state") == "S") & lc.isin("resume", "ate_abort"))
    r, a = F.col("n_resume"), F.col("n_abort")
    return s.groupBy("activity").agg(
        F.sum((lc == "resume").cast("int")).alias("n_resume"),
        F.sum((lc == "ate_abort").cast("int")).alias("n_abort")).withColumn(
        "p_resume", ratio(r, r + a))


def resume_gaps(seg: DataFrame) -> DataFrame:
    """activity, suspended_at, resumed_at, resource, gap_s >= 0."""
    g = seg.filter((F.col("lifecycle") == "resume") & (F.col("state") == "S"))
    return g.select("case_id", "activity", "event_order", "suspended_at",
                    F.col("timestamp").alias("resumed_at"), "resource",
                    seconds_between("suspended_at", "timestamp").alias("gap_s")) \
            .filter(F.col("gap_s") >= 0)


LOOK_BACK_DAYS = 15


def off_shift_tail(gaps: DataFrame, windows: DataFrame, holidays: DataFrame,
                   system: DataFrame) -> DataFrame:
    """Add ``tail_s``: the off-shift stretch that ends at the resume.

    ``windows`` is (resource, dow, open_h, close_h), folded to one row per
    resource (seven entries at most); the look-back over days happens inside the
    row, so nothing is exploded.
    """
    shifts = windows.groupBy("resource").agg(F.map_from_entries(F.collect_list(
        F.struct("dow", F.struct("open_h", "close_h").alias("w")))).alias("__w"))
    sys = system.select("resource").distinct().withColumn("__sys", F.lit(True))
    g = gaps.join(shifts, "resource", "left").join(sys, "resource", "left")
    hol = F.coalesce(holidays.agg(F.collect_set("date")).scalar(),
                     F.array().cast("array<date>"))   # calendar dates only
    t = F.col("resumed_at")
    g = g.withColumn("__hol", hol)

    def shift(day):
        return F.when(~F.array_contains("__hol", day), F.col("__w")[F.weekday(day)])
    today = shift(F.to_date(t))
    h = fractional_hour(t)
    on = F.coalesce((today["open_h"] <= h) & (h < today["close_h"]), F.lit(False))

    def close_of(back):
        day = F.date_sub(F.to_date(t), back)
        secs = F.bround(shift(day)["close_h"] * 3600.0).cast("decimal(18,6)")
        return day.cast("timestamp_ntz") + F.make_dt_interval(secs=secs)
    closes = F.transform(F.sequence(F.lit(0), F.lit(LOOK_BACK_DAYS - 1)), close_of)
    latest = F.array_max(F.filter(closes, lambda c: c.isNotNull() & (c <= t)))
    tail = (F.when((F.col("gap_s") <= 0) | F.col("resource").isNull()
                   | F.col("__sys").isNotNull() | F.col("__w").isNull() | on, F.lit(0.0))
            .when(latest.isNotNull(), F.least(F.greatest(seconds_between(latest, t), F.lit(0.0)),
                                              F.col("gap_s")))
            .otherwise(F.col("gap_s")))
    return g.withColumn("tail_s", tail).drop("__w", "__sys", "__hol")


def residual_gaps(tails: DataFrame) -> DataFrame:
    """Add ``residual_s`` = gap without the off-shift tail."""
    return tails.withColumn("residual_s",
                            F.greatest(F.lit(0.0), F.col("gap_s") - F.col("tail_s")))


def resume_gap_fits(residuals: DataFrame) -> DataFrame:
    """Best fit of the positive residuals per activity, with the share of zeros."""
    return fit.delay_fit(residuals, ["activity"], "residual_s")


def withdraw_waits(seg: DataFrame) -> DataFrame:
    """Schedule-to-withdraw seconds of items withdrawn while not running."""
    w = seg.filter((F.col("lifecycle") == "withdraw") & (F.col("created_by") == "schedule")
                   & (F.col("state") != "R"))
    return w.select("case_id", "activity", "event_order",
                    seconds_between("created_at", "timestamp").alias("wait_s")) \
            .filter(F.col("wait_s") >= 0)


def tokens(df: DataFrame, seg: DataFrame) -> DataFrame:
    """Occurrence tokens: milestone completes and work-item terminals."""
    low = F.lower(F.col("lifecycle"))
    atomic = df.filter(~starts_with_any("activity", ["W_"]) & (low == "complete")).select(
        "case_id", "event_order", F.col("timestamp").alias("ready_ts"),
        F.col("timestamp").alias("end_ts"), "activity",
        F.lit(None).cast("string").alias("outcome"))
    work = seg.filter("terminal").select(
        "case_id", "event_order", F.coalesce("created_at", "timestamp").alias("ready_ts"),
        F.col("timestamp").alias("end_ts"), "activity", F.col("lifecycle").alias("outcome"))
    return atomic.unionByName(work)


def _linked(tok: DataFrame) -> DataFrame:
    return along(tok, ["case_id"], ["end_ts", "event_order"], {
        "__n": following(F.struct("activity", "ready_ts"))})


def inter_activity_delays(tok: DataFrame) -> DataFrame:
    """activity, next_activity, delay_s = max(0, next ready - current end)."""
    t = _linked(tok).filter(F.col("__n").isNotNull())
    return t.select("case_id", "activity", F.col("__n.activity").alias("next_activity"),
                    F.greatest(F.lit(0.0), seconds_between("end_ts", "__n.ready_ts"))
                    .alias("delay_s"))


def delay_fits(delays: DataFrame) -> DataFrame:
    """Delay fits per transition, and one pooled row with null activities."""
    both = delays.select("delay_s", F.explode(F.array(
        F.struct("activity", "next_activity"),
        F.struct(F.lit("").alias("activity"), F.lit("").alias("next_activity")))).alias("k")) \
        .select("k.*", "delay_s")
    out = fit.delay_fit(both, ["activity", "next_activity"], "delay_s")
    return out.withColumns({c: F.when(F.col(c) != "", F.col(c))
                            for c in ("activity", "next_activity")})


def terminal_continuation(tok: DataFrame) -> DataFrame:
    """activity, outcome, next_activity, n, p over what follows a work-item terminal."""
    t = _linked(tok).filter(F.col("outcome").isNotNull())
    c = t.groupBy("activity", "outcome", F.coalesce("__n.activity", F.lit(CASE_END))
                  .alias("next_activity")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("p", ratio("n", F.sum("n").over(
        Window.partitionBy("activity", "outcome"))))


def suspends_per_instance(seg: DataFrame) -> DataFrame:
    """Suspend counts of finished instances: mean, median, p90, max, share > 0, n."""
    per = seg.groupBy(*KEYS, "instance").agg(
        F.sum(F.col("stops").cast("int")).alias("s"), F.max("terminal").alias("done"))
    per = per.filter("done")
    agg = per.groupBy("activity").agg(
        F.avg("s").alias("mean"), F.max("s").alias("max"),
        F.avg((F.col("s") > 0).cast("double")).alias("share_suspended"),
        F.count(F.lit(1)).alias("n_instances"))
    return agg.join(quantiles(per, ["activity"], "s", {"median": 0.5, "p90": 0.9}), "activity")


def case_duration_envelope(df: DataFrame) -> DataFrame:
    """Fit of first-to-last case durations, with the fixed runtime scale."""
    return fit.delay_fit(case_spans(df), [], "duration_s").withColumn(
        "runtime_scale", F.lit(RUNTIME_SCALE))


def _sessions(rows: DataFrame, order: list[str], run) -> DataFrame:
    """Work-item rows with instance number and, where a session ends, its seconds."""
    lc = F.col("lifecycle")
    w = run(rows, order, {
        "pos": nth(), "instance": total_before(lc.isin(*TERMINALS).cast("int"))})
    pos = F.col("pos")
    w = run(w, order, {
        "__term": latest_before(F.when(lc.isin(*TERMINALS), pos)),
        "__make": latest_upto(F.when(lc.isin("schedule", "start"), pos))})
    floor = F.coalesce("__term", F.lit(-1))
    # the item exists from its first schedule/start on; earlier rows are ignored
    live = F.coalesce("__make", F.lit(-1)) > floor
    w = w.withColumn("__opens", (lc == "start") | ((lc == "resume") & live))
    w = run(w, order, {
        "__last": latest_before(F.when(F.col("__opens") | (lc == "suspend"),
                                       F.struct("pos", "timestamp", "__opens")))})
    running = F.col("__last.__opens") & (F.col("__last.pos") > floor)
    return w.withColumn("duration_s", F.when(
        running & lc.isin("suspend", "complete", "ate_abort"),
        seconds_between("__last.timestamp", "timestamp")))


def training_sessions(df: DataFrame, max_seconds: float = 7 * 86400.0) -> DataFrame:
    """One row per active session with the context of the item's first start.

    Differs from ``segment``: a resume opens whether or not the item was
    suspended, items still open at the end of the log count, and a withdraw ends
    no session.
    """
    order = order_of(df)
    lc = F.col("lifecycle")
    w = by_part(work_rows(df), KEYS, lambda rows, run: _sessions(rows, order, run))
    at = F.struct(*[F.col(c) for c in order])
    first = F.when(lc == "start", at)
    items = w.groupBy(*KEYS, "instance").agg(
        F.min_by("timestamp", first).alias("first_start"),
        F.min_by("resource", first).alias("resource"),
        F.min_by("event_order", first).alias("event_order"),
        F.max(F.col("duration_s") > 0).alias("__any"))
    items = items.filter(F.col("first_start").isNotNull() & F.col("__any")).drop("__any")
    atomic = df.filter(~starts_with_any("activity", ["W_"])
                       & (F.lower("lifecycle") == "complete")).select(
        "case_id", "timestamp", "activity", "event_order", F.lit(0).alias("kind"),
        F.lit(None).cast("bigint").alias("instance"), F.lit(None).cast("string").alias("resource"))
    line = atomic.unionByName(items.select(
        "case_id", F.col("first_start").alias("timestamp"), "activity", "event_order",
        F.lit(1).alias("kind"), "instance", "resource"))
    line = along(line, ["case_id"], ["timestamp", "kind", "event_order"], {
        "case_position": nth(), "__prev": preceding("activity")}).filter("kind = 1")
    begin = df.groupBy("case_id").agg(F.min("timestamp").alias("__begin"))
    line = line.join(begin, "case_id").select(
        *KEYS, "instance", "resource", "timestamp", "case_position",
        F.col("case_position").alias("n_previous_activities"),
        F.coalesce("__prev", F.lit(START)).alias("previous_activity"),
        seconds_between("__begin", "timestamp").alias("case_age_seconds"),
        monday_dow("timestamp").alias("day_of_week"), F.hour("timestamp").alias("hour_of_day"))
    s = w.filter((F.col("duration_s") > 0) & (F.col("duration_s") <= max_seconds)).select(
        *KEYS, "instance", "duration_s", F.col("event_order").alias("session_order"))
    return s.join(line, [*KEYS, "instance"])


def recomposed_items(df: DataFrame) -> DataFrame:
    """Per finished work item: elapsed, active and other seconds, sessions, suspends.

    Extra grouping columns such as ``run_id`` pass through if present.
    """
    extra = [c for c in ("run_id",) if c in df.columns]
    order = order_of(df)
    lc = F.col("lifecycle")
    w = df.filter(starts_with_any("activity", ["W_"]) & F.col("work_item_id").isNotNull()
                  & (F.col("work_item_id") != ""))
    flips = lc.isin("start", "resume", "suspend", "complete")
    w = along(w, [*extra, "work_item_id"], order, {
        "__p": latest_before(F.when(flips, F.struct("timestamp", "lifecycle")))})
    ends = F.col("__p.lifecycle").isin(*OPEN) & lc.isin("suspend", "complete")
    at = F.struct(*[F.col(c) for c in order])
    items = w.groupBy(*extra, "work_item_id").agg(
        F.min_by("activity", at).alias("activity"),
        F.max_by("lifecycle", F.when(lc.isin(*TERMINALS), at)).alias("terminal"),
        F.max_by("timestamp", F.when(lc.isin(*TERMINALS), at)).alias("__end"),
        F.max_by("timestamp", F.when(lc == "schedule", at)).alias("__sched"),
        F.min_by("timestamp", F.when(lc.isin(*OPEN), at)).alias("__first"),
        F.coalesce(F.sum(F.when(ends, F.greatest(
            F.lit(0.0), seconds_between("__p.timestamp", "timestamp")))), F.lit(0.0))
        .alias("active_s"),
        F.sum(lc.isin(*OPEN).cast("int")).alias("sessions"),
        F.sum((ends & (lc == "suspend")).cast("int")).alias("suspends"))
    origin = F.when(F.col("terminal") == "withdraw", F.col("__sched")).otherwise(F.col("__first"))
    items = items.filter(F.col("terminal").isNotNull()).withColumn(
        "elapsed_s", F.greatest(F.lit(0.0), seconds_between(origin, "__end")))
    items = items.withColumn("elapsed_s", F.when(origin.isNotNull(), F.col("elapsed_s")))
    return items.withColumn("non_active_s", F.col("elapsed_s") - F.col("active_s")).drop(
        "__end", "__sched", "__first")


MEASURES = ("elapsed_s", "active_s", "non_active_s", "suspends")


def item_summary(items: DataFrame) -> DataFrame:
    """n, mean, median, p90 of each measure, by terminal and by (activity, terminal).

    Rows with a null activity are the by-terminal level.
    """
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
                      for m in MEASURES])
    long = items.select("terminal", "activity", F.explode(cells).alias("c")).select(
        "terminal", F.explode(F.array(F.lit(None).cast("string"), F.col("activity")))
        .alias("activity"), "c.*").filter(F.col("value").isNotNull())
    keys = ["activity", "terminal", "measure"]
    long = long.withColumn("activity", F.coalesce("activity", F.lit("")))
    agg = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    out = agg.join(quantiles(long, keys, "value", {"median": 0.5, "p90": 0.9}), keys)
    return out.withColumn("activity", F.when(F.col("activity") != "", F.col("activity")))


def resume_ownership(df: DataFrame) -> DataFrame:
    """Share of resumes by the resource of the previous running session; a null
    activity is the overall row."""
    w = df.filter(starts_with_any("activity", ["W_"]) & F.col("work_item_id").isNotNull()
                  & F.col("lifecycle").isin(*OPEN))
    w = along(w, ["work_item_id"], order_of(df), {"__r": preceding("resource")})
    r = w.filter(F.col("lifecycle") == "resume").select(
        F.explode(F.array(F.lit(None).cast("string"), F.col("activity"))).alias("activity"),
        F.coalesce((F.col("resource") == F.col("__r")).cast("int"), F.lit(0)).alias("same"))
    return r.groupBy("activity").agg(
        F.sum("same").alias("same_resource"), F.count(F.lit(1)).alias("total_resumes")) \
        .withColumn("same_resource_rate", ratio("same_resource", "total_resumes"))


def transition_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("lifecycle").agg(F.count(F.lit(1)).alias("n"))


def churn(df: DataFrame, max_sessions: int = 60) -> DataFrame:
    """One row: work items, median and largest session count, items at the guard,
    withdrawals."""
    w = df.filter(F.col("work_item_id").isNotNull() & starts_with_any("activity", ["W_"]))
    lc = F.col("lifecycle")
    per = w.groupBy("work_item_id").agg(
        F.sum(lc.isin(*OPEN).cast("int")).alias("sessions"),
        F.sum((lc == "withdraw").cast("int")).alias("withdrawals"))
    opened = per.filter("sessions > 0")
    one = per.agg(F.count(F.lit(1)).alias("work_items"),
                  F.coalesce(F.max("sessions"), F.lit(0)).alias("max_sessions"),
                  F.coalesce(F.sum((F.col("sessions") >= max_sessions).cast("int")), F.lit(0))
                  .alias("at_guard"),
                  F.coalesce(F.sum("withdrawals"), F.lit(0)).alias("withdrawals"))
    return one.withColumn("median_sessions", quantiles(opened, [], "sessions", {"m": 0.5}).scalar())


def churn_by_activity(df: DataFrame, rare: Sequence[str] = ()) -> DataFrame:
    """activity, work_items, withdrawals; listed rare activities are always present."""
    w = df.filter(F.col("work_item_id").isNotNull() & starts_with_any("activity", ["W_"]))
    per = w.groupBy("activity", "work_item_id").agg(
        F.sum((F.col("lifecycle") == "withdraw").cast("int")).alias("x"))
    per = per.groupBy("activity").agg(F.count(F.lit(1)).alias("work_items"),
                                      F.sum("x").alias("withdrawals"))
    if not rare:
        return per
    names = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(a) for a in rare])).alias("activity"))
    return per.join(names, "activity", "full").na.fill(0, ["work_items", "withdrawals"])


def suspend_count_errors(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean suspends per work item against a reference (activity, mean)."""
    w = df.filter(F.col("work_item_id").isNotNull() & starts_with_any("activity", ["W_"]))
    per = w.groupBy("activity", "work_item_id").agg(
        F.sum((F.col("lifecycle") == "suspend").cast("int")).alias("s"))
    sim = per.groupBy("activity").agg(F.avg("s").alias("sim_mean"),
                                      F.count(F.lit(1)).alias("n_work_items"))
    ref = reference.select("activity", F.col("mean").alias("ref_mean"))
    return ref.join(sim, "activity", "left").withColumn(
        "abs_error", F.abs(F.col("sim_mean") - F.col("ref_mean")))


# Bins of the schedule-to-start gap in minutes [lo, hi).
REGIME_BINS = ((-1, 1 / 60, "<1 s"), (1 / 60, 1, "<1 min"), (1, 60, "1–60 min"),
               (60, 720, "1–12 h"), (720, 1e12, ">12 h"))


def transition_pairs(df: DataFrame) -> DataFrame:
    """Consecutive transitions of a (case, activity): lifecycle, next_lifecycle,
    gap_min, same_resource."""
    nxt = F.struct("timestamp", "lifecycle", "resource")
    t = along(df, KEYS, order_of(df), {"__n": following(nxt)})
    t = t.filter(F.col("__n").isNotNull())
    return t.select("case_id", "activity", "lifecycle", F.col("__n.lifecycle").alias("next_lifecycle"),
                    (seconds_between("timestamp", "__n.timestamp") / 60.0).alias("gap_min"),
                    (F.col("resource") == F.col("__n.resource")).alias("same_resource"))


def regime_audit(df: DataFrame) -> DataFrame:
    """Mean gap between consecutive transitions, by transition pair."""
    return transition_pairs(df).groupBy("lifecycle", "next_lifecycle").agg(
        F.count(F.lit(1)).alias("n"), F.avg("gap_min").alias("mean_gap_min"),
        F.avg(F.coalesce(F.col("same_resource").cast("double"), F.lit(0.0)))
        .alias("same_resource_share"))


def schedule_start_bins(df: DataFrame) -> DataFrame:
    """Share of schedule-to-start pairs per gap bin, with the same-resource share."""
    p = transition_pairs(df).filter("lifecycle = 'schedule' and next_lifecycle = 'start'")
    b = None
    for lo, hi, name in REGIME_BINS:
        cond = (F.col("gap_min") >= lo) & (F.col("gap_min") < hi)
        b = F.when(cond, name) if b is None else b.when(cond, name)
    c = p.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(F.col("same_resource").cast("double"), F.lit(0.0)))
        .alias("same_resource_share"))
    return c.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy())))


def batch_fingerprint(df: DataFrame, transition: str = "suspend", hour: int = 22,
                      many: int = 10) -> DataFrame:
    """One row of signs of automatic batches among one kind of transition."""
    t = df.filter(F.col("lifecycle") == transition)
    per = t.groupBy("timestamp").agg(
        F.countDistinct("case_id").alias("cases"), F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    return per.agg(
        n.alias("n_events"), F.max("cases").alias("max_cases_per_instant"),
        F.sum((F.col("cases") >= many).cast("int")).alias("crowded_instants"),
        ratio(F.sum(F.when(F.hour("timestamp") == hour, F.col("n")).otherwise(0)), n)
        .alias("share_at_hour"),
        ratio(F.sum(F.when(F.second("timestamp") == 0, F.col("n")).otherwise(0)), n)
        .alias("share_on_minute"))


def origin_crosstab(df: DataFrame, origin: str = "event_origin") -> DataFrame:
    """Event counts by origin and transition, one column per transition."""
    return (df.groupBy(origin).pivot("lifecycle", list(TRANSITIONS))
            .agg(F.count(F.lit(1))).na.fill(0))


def hazard_inventory(seg: DataFrame) -> DataFrame:
    """Hazards per activity side by side; ``boundary`` marks a probability of 0 or 1."""
    s = session_end_hazard(seg).select("activity", "p_complete")
    u = suspend_end_hazard(seg).select("activity", "p_resume")
    g = resume_gaps(seg).groupBy("activity").agg(F.count(F.lit(1)).alias("n_gaps"))
    w = withdraw_waits(seg).groupBy("activity").agg(F.count(F.lit(1)).alias("n_withdraws"))
    out = s.join(u, "activity", "full").join(g, "activity", "full").join(w, "activity", "full")
    edge = F.col("p_complete").isin(0.0, 1.0) | F.col("p_resume").isin(0.0, 1.0)
    return out.withColumn("boundary", F.coalesce(edge, F.lit(False)))


def median_hazards(inventory: DataFrame) -> DataFrame:
    q = quantiles(inventory.select(F.explode(F.array(
        F.struct(F.lit("p_complete").alias("hazard"), F.col("p_complete").alias("v")),
        F.struct(F.lit("p_resume").alias("hazard"), F.col("p_resume").alias("v")))).alias("c"))
        .select("c.*"), ["hazard"], "v", {"median": 0.5})
    return q


def hours_by_run(items: DataFrame) -> DataFrame:
    """Mean active and other hours per run and terminal."""
    return items.groupBy("run_id", "terminal").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("active_s") / 3600.0).alias("active_h"),
        (F.avg("non_active_s") / 3600.0).alias("non_active_h"))
