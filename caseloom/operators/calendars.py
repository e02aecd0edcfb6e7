"""Resource presence, weekly windows, holidays, leave and rosters.

Presence is (resource, date, first, last, n_events, dow, span) with local
fractional hours. A calendar is the tables windows (resource, dow, open_h,
close_h, p_work), holidays (date), vacations (resource, date), system (resource).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import col, fractional_hour, monday_dow, ratio, seconds_between
from ..functions.ordered import along, following, nth, settled, total_upto
from ..functions.quantiles import quantiles
from ..functions.staging import staged
from .shape import ntz

# Defaults of the calendar model.
START_Q, END_Q = 0.10, 0.90
MIN_ACTIVE_DAYS = 20
HOLIDAY_SHARE = 0.40
MIN_LEAVE_DAYS = 5
LEAVE_MIN_RATE = 0.60
MIN_TENURE_DAYS = 40


def presence(df: DataFrame) -> DataFrame:
    """One row per resource and day with an event."""
    h = fractional_hour("timestamp")
    p = df.filter(F.col("resource").isNotNull()).groupBy(
        "resource", F.to_date("timestamp").alias("date")).agg(
        F.min(h).alias("first"), F.max(h).alias("last"), F.count(F.lit(1)).alias("n_events"))
    return p.withColumn("dow", monday_dow("date")).withColumn("span", F.col("last") - F.col("first"))


def span_weekdays(p: DataFrame) -> DataFrame:
    """dow, n: how often each weekday occurs in the presence's day span."""
    days = p.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.groupBy(monday_dow("day").alias("dow")).agg(F.count(F.lit(1)).alias("n"))


def fit_weekly(p: DataFrame, min_active_days: int = MIN_ACTIVE_DAYS,
               sparse_floor: int | None = None, start_q: float = START_Q,
               end_q: float = END_Q) -> DataFrame:
    """Windows (resource, dow, open_h, close_h, p_work, tier).

    Tier A: a window per weekday for well-observed resources. Tier B, if
    ``sparse_floor`` is set: one pooled window on the weekdays a sparse resource
    was seen; its extremes stand in for a degenerate quantile window.
    """
    days = p.groupBy("resource").agg(F.count(F.lit(1)).alias("__days"))
    occ = span_weekdays(p).withColumnRenamed("n", "__n")
    def rows_of(cond):
        return p.join(days.filter(cond).select("resource"), "resource", "left_semi")
    per_dow = p.groupBy("resource", "dow").agg(F.count(F.lit(1)).alias("__worked"))
    keys = ["resource", "dow"]
    dense = rows_of(F.col("__days") >= min_active_days)
    tier_a = (quantiles(dense, keys, "first", {"open_h": start_q})
              .join(quantiles(dense, keys, "last", {"close_h": end_q}), keys)
              .filter(F.col("close_h") > F.col("open_h")).withColumn("tier", F.lit("A")))
    windows = tier_a
    if sparse_floor is not None:
        sparse = rows_of((F.col("__days") >= sparse_floor)
                         & (F.col("__days") < min_active_days))
        pooled = (quantiles(sparse, ["resource"], "first", {"__o": start_q})
                  .join(quantiles(sparse, ["resource"], "last", {"__c": end_q}), "resource")
                  .join(sparse.groupBy("resource").agg(F.min("first").alias("__lo"),
                                                       F.max("last").alias("__hi")), "resource"))
        good = F.col("__c") > F.col("__o")
        pooled = pooled.select("resource", F.when(good, F.col("__o")).otherwise(F.col("__lo"))
                               .alias("open_h"),
                               F.when(good, F.col("__c")).otherwise(F.col("__hi"))
                               .alias("close_h")).filter(F.col("close_h") > F.col("open_h"))
        seen = per_dow.select(*keys)
        windows = windows.unionByName(pooled.join(seen, "resource").withColumn(
            "tier", F.lit("B")).select(*tier_a.columns))
    out = windows.join(per_dow.select(*keys, "__worked"), keys).join(occ, "dow")
    return out.withColumn("p_work", ratio("__worked", "__n")).select(
        "resource", "dow", "open_h", "close_h", "p_work", "tier")


def window_hits(work: DataFrame, windows: DataFrame) -> DataFrame:
    """Work events of modelled (resource, weekday) cells, with ``inside`` (bounds inclusive)."""
    h = fractional_hour("timestamp")
    ev = work.withColumn("dow", monday_dow("timestamp")).withColumn("hour", h)
    w = windows.select("resource", "dow", "open_h", "close_h")
    j = ev.join(w, ["resource", "dow"])
    return j.withColumn("inside", (F.col("open_h") <= F.col("hour"))
                        & (F.col("hour") <= F.col("close_h")))


def evaluate_weekly(windows: DataFrame, work: DataFrame, p: DataFrame) -> DataFrame:
    """One row: coverage of events, busy share of open hours, resources modelled."""
    cover = window_hits(work, windows).agg(F.avg(F.col("inside").cast("double")).alias("coverage"))
    days = p.groupBy("resource", "dow").agg(F.count(F.lit(1)).alias("n"), F.sum("span").alias("s"))
    use = windows.join(days, ["resource", "dow"]).agg(
        F.coalesce(ratio(F.sum("s"), F.sum((F.col("close_h") - F.col("open_h")) * F.col("n"))),
                   F.lit(0.0)).alias("window_utilisation"))
    n = windows.agg(F.countDistinct("resource").alias("n"))
    return cover.select("coverage", use.scalar().alias("window_utilisation"),
                        n.scalar().alias("resources_modelled"))


# The compared window definitions (quantiles of first and last hour).
SWEEP = (("min / max", 0.0, 1.0), ("q05 / q95", 0.05, 0.95), ("q10 / q90", 0.10, 0.90),
         ("q25 / q75", 0.25, 0.75))


def window_sweep(work: DataFrame, p: DataFrame,
                 min_active_days: int = MIN_ACTIVE_DAYS) -> DataFrame:
    """Coverage and utilisation per window definition and for one global 9-17 window.

    All definitions are fitted in one pass over the presence and read in one join with the
    events; the global window holds wherever the default definition has one.
    """
    keys, names = ["resource", "dow"], [n for n, _, _ in SWEEP] + ["global 9-17"]
    pairs = [(lo, hi) for _, lo, hi in SWEEP] + [(START_Q, END_Q)]
    p = staged(p)
    days = p.groupBy("resource").agg(F.count(F.lit(1)).alias("__days")).filter(
        F.col("__days") >= min_active_days)
    dense = p.join(days.select("resource"), "resource", "left_semi")
    w = quantiles(dense, keys, "first", {f"__o{i}": lo for i, (lo, _) in enumerate(pairs)}).join(
        quantiles(dense, keys, "last", {f"__c{i}": hi for i, (_, hi) in enumerate(pairs)}), keys)
    fitted = [F.col(f"__c{i}") > F.col(f"__o{i}") for i in range(len(pairs))]
    ends = [(F.col(f"__o{i}"), F.col(f"__c{i}")) for i in range(len(pairs) - 1)] + [(F.lit(9.0), F.lit(17.0))]
    # bounds are null where a definition has no window
    w = staged(w.select(*keys, *[F.when(f, x).alias(f"__{t}{i}") for i, (f, e) in enumerate(zip(fitted, ends))
                                 for t, x in zip("oc", e)]))
    h = F.col("__h")
    ev = work.select("resource", monday_dow("timestamp").alias("dow"), fractional_hour("timestamp").alias("__h"))
    cover = ev.join(w, keys).agg(*[F.avg(((F.col(f"__o{i}") <= h) & (h <= F.col(f"__c{i}"))).cast("double"))
                                   .alias(f"__v{i}") for i in range(len(names))])
    seen = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum("span").alias("__s"))
    use = w.join(seen, keys).agg(*[F.coalesce(ratio(
        F.sum(F.when(F.col(f"__o{i}").isNotNull(), F.col("__s"))),
        F.sum((F.col(f"__c{i}") - F.col(f"__o{i}")) * F.col("__n"))), F.lit(0.0)).alias(f"__u{i}")
        for i in range(len(names))])
    # one row each
    rows = cover.crossJoin(use).select(F.explode(F.array(*[F.struct(
        F.col(f"__v{i}").alias("coverage"), F.col(f"__u{i}").alias("window_utilisation"),
        F.lit(n).alias("window")) for i, n in enumerate(names)])).alias("r"))
    return rows.select("r.*")


def weekday_headcount(p: DataFrame) -> DataFrame:
    """date, headcount for every weekday of the span (0 where nobody worked)."""
    days = p.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("date")).filter(monday_dow("date") < 5)
    n = p.groupBy("date").agg(F.countDistinct("resource").alias("headcount"))
    return days.join(n, "date", "left").withColumn(
        "headcount", F.coalesce("headcount", F.lit(0)))


def stable_window(p: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """One row: first and last day of the months whose mean headcount stays near the peak."""
    m = weekday_headcount(p).groupBy(F.trunc("date", "month").alias("month")).agg(
        F.avg("headcount").alias("mean"))
    peak = m.agg(F.max("mean")).scalar()
    good = m.filter(F.col("mean") >= tolerance * peak)
    return good.agg(F.min("month").alias("start"), F.last_day(F.max("month")).alias("end"))


def discover_holidays(p: DataFrame, threshold: float = HOLIDAY_SHARE,
                      window: tuple | None = None) -> DataFrame:
    """Weekdays whose headcount falls below a share of the centred 21-row median.

    The window runs over weekday dates, one row each, so a single ordered
    partition is as long as the calendar.
    """
    head = weekday_headcount(p)
    if window is not None:
        head = head.filter((F.col("date") >= F.lit(str(window[0])).cast("date"))
                           & (F.col("date") <= F.lit(str(window[1])).cast("date")))
    w = Window.orderBy("date").rowsBetween(-10, 10)
    head = head.withColumn("local", F.when(
        F.count(F.lit(1)).over(w) >= 5, F.expr("percentile(headcount, 0.5D)").over(w)))
    return head.filter(F.col("headcount") < threshold * F.col("local"))


def chance_threshold(n_workdays, q, alpha: float = 0.5) -> Column:
    """Absence-run length that chance alone would not explain at work rate ``q``."""
    runs = F.greatest(n_workdays * q, F.lit(1e-9))
    length = F.ceil(F.log(F.lit(alpha) / runs) / F.log(1.0 - q))
    return F.when((q <= 0) | (q >= 1), F.lit(MIN_LEAVE_DAYS)).otherwise(
        F.greatest(F.lit(MIN_LEAVE_DAYS), length)).cast("int")


def absence_runs(p: DataFrame, holidays: DataFrame, windows: DataFrame,
                 min_rate: float = LEAVE_MIN_RATE,
                 min_tenure: int = MIN_TENURE_DAYS) -> DataFrame:
    """resource, run_start, length, tenure and rate of every leave-length absence run.

    Workdays are numbered once on the calendar; the length of a run is the jump
    in that number between two presence days. No resource-by-day grid is built.
    """
    days = p.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("date"))
    hol = holidays.select("date").distinct().withColumn("__h", F.lit(1))
    cal = days.join(hol, "date", "left").withColumn(
        "workday", ((monday_dow("date") < 5) & F.col("__h").isNull()).cast("int"))
    # calendar rows only; upto = workdays up to and including the date
    cal = along(cal.drop("__h"), [], ["date"], {"upto": total_upto("workday")})
    rate = windows.filter(F.col("dow") < 5).groupBy("resource").agg(
        (F.sum("p_work") / 5.0).alias("rate"))
    known = windows.select("resource").distinct()
    per = p.join(known, "resource", "left_semi").join(cal, "date")
    bounds = per.groupBy("resource").agg(
        F.min(F.col("upto") - F.col("workday")).alias("__w0"), F.max("upto").alias("__w1"))
    bounds = bounds.withColumn("tenure", F.col("__w1") - F.col("__w0"))
    work = along(per.filter("workday = 1").select("resource", "date", "upto").distinct(),
                 ["resource"], ["date"], {"__next": following("upto"), "__rn": nth()})
    j = work.join(bounds, "resource").join(rate, "resource", "left").withColumn(
        "rate", F.coalesce("rate", F.lit(0.0)))
    j = j.filter((F.col("tenure") >= min_tenure) & (F.col("rate") >= min_rate))
    inner = F.coalesce(F.col("__next"), F.col("__w1") + 1) - F.col("upto") - 1
    # a stretch before the first worked workday exists when the first presence is a weekend
    head = F.when(F.col("__rn") == 0, F.col("upto") - F.col("__w0") - 1)
    runs = j.withColumn("__l", F.explode(F.array(inner, head)))
    return runs.filter(F.col("__l") >= chance_threshold(F.col("tenure"), F.col("rate"))).select(
        "resource", F.col("date").alias("near"), F.col("__l").cast("bigint").alias("length"),
        "tenure", "rate")


def leave_profiles(p: DataFrame, holidays: DataFrame, windows: DataFrame,
                   min_rate: float = LEAVE_MIN_RATE,
                   min_tenure: int = MIN_TENURE_DAYS) -> DataFrame:
    """resource, n_blocks, per_year, mean_length: leave of resources where it shows."""
    hol = holidays.select("date").distinct()
    known = windows.select("resource").distinct()
    ends = p.join(known, "resource", "left_semi").groupBy("resource").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi"))
    cal = p.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        F.explode(F.sequence("a", "b")).alias("date")).filter(monday_dow("date") < 5) \
        .join(hol, "date", "left_anti")
    # calendar dates only: one sorted array, searched per resource
    days = cal.agg(F.sort_array(F.collect_list("date"))).scalar()
    t = ends.withColumn("__c", days)
    inside = F.filter("__c", lambda x: (x >= F.col("lo")) & (x <= F.col("hi")))
    t = t.withColumn("__i", inside).select(
        "resource", F.size("__i").alias("tenure"),
        F.date_diff(F.try_element_at("__i", F.lit(-1)), F.try_element_at("__i", F.lit(1)))
        .alias("covered"))
    rate = windows.filter(F.col("dow") < 5).groupBy("resource").agg(
        (F.sum("p_work") / 5.0).alias("rate"))
    t = t.join(rate, "resource").filter((F.col("tenure") >= min_tenure)
                                        & (F.col("rate") >= min_rate))
    runs = absence_runs(p, holidays, windows, min_rate, min_tenure).groupBy("resource").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.avg("length").alias("mean_length"))
    out = t.join(runs, "resource", "left").withColumns({
        "n_blocks": F.coalesce("n_blocks", F.lit(0)),
        "mean_length": F.coalesce("mean_length", F.lit(0.0))})
    return out.withColumn("per_year", F.col("n_blocks") / F.greatest(
        F.col("covered") / F.lit(365.25), F.lit(1e-9))).select(
        "resource", "tenure", "rate", "n_blocks", "per_year", "mean_length")


def rostered(seed: int | None, resource="resource", date="date", p="p_work") -> Column:
    """Is the resource rostered on that day? A hash of (seed, resource, date) against p.

    The same day always gets the same answer; with no seed everyone is on.
    """
    if seed is None:
        return F.lit(True)
    pw = F.coalesce(col(p), F.lit(0.0))
    text = F.concat_ws("|", F.lit(str(seed)), F.col(resource), F.col(date).cast("string"))
    u = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("double") / F.lit(float(1 << 60))
    return F.when(pw <= 0, False).when(pw >= 1, True).otherwise(u < pw)


def on_duty(instants: DataFrame, windows: DataFrame, holidays: DataFrame, vacations: DataFrame,
            system: DataFrame, seed: int | None = None) -> DataFrame:
    """Add ``on_duty`` to (resource, timestamp) rows.

    System accounts are always on, a human without a fitted window never.
    Window bounds are inclusive.
    """
    r = instants.withColumn("date", F.to_date("timestamp")).withColumn(
        "dow", monday_dow("timestamp"))
    w = windows.select("resource", "dow", "open_h", "close_h", "p_work")
    fitted = windows.select("resource").distinct().withColumn("__fit", F.lit(True))
    sys = system.select("resource").distinct().withColumn("__sys", F.lit(True))
    hol = holidays.select("date").distinct().withColumn("__hol", F.lit(True))
    vac = vacations.select("resource", "date").distinct().withColumn("__vac", F.lit(True))
    j = (r.join(w, ["resource", "dow"], "left").join(fitted, "resource", "left")
         .join(sys, "resource", "left").join(hol, "date", "left")
         .join(vac, ["resource", "date"], "left"))
    h = fractional_hour("timestamp")
    inside = F.coalesce((F.col("open_h") <= h) & (h <= F.col("close_h")), F.lit(False))
    ok = inside & F.col("__hol").isNull() & F.col("__vac").isNull() & rostered(seed)
    return j.withColumn("on_duty", F.when(F.col("__fit").isNull(), F.col("__sys").isNotNull())
                        .otherwise(ok)).select(*instants.columns, "on_duty")


def availability(resources: DataFrame, windows: DataFrame, holidays: DataFrame,
                 vacations: DataFrame, system: DataFrame, start, days: int,
                 seed: int | None = None) -> DataFrame:
    """Realised on-duty intervals (resource, avail_start, avail_end) over a horizon."""
    lo = ntz(start)
    hi = lo + F.make_dt_interval(days=F.lit(days))
    grid = resources.select("resource").distinct().withColumn("date", F.explode(F.sequence(
        F.to_date(lo), F.date_add(F.to_date(lo), days)))).withColumn("dow", monday_dow("date"))
    w = windows.select("resource", "dow", "open_h", "close_h", "p_work")
    fitted = windows.select("resource").distinct().withColumn("__fit", F.lit(True))
    sys = system.select("resource").distinct().withColumn("__sys", F.lit(True))
    hol = holidays.select("date").distinct().withColumn("__hol", F.lit(True))
    vac = vacations.select("resource", "date").distinct().withColumn("__vac", F.lit(True))
    j = (grid.join(w, ["resource", "dow"], "left").join(fitted, "resource", "left")
         .join(sys, "resource", "left").join(hol, "date", "left")
         .join(vac, ["resource", "date"], "left"))
    unfitted = F.col("__fit").isNull()
    human_on = (~unfitted & F.col("open_h").isNotNull() & F.col("__hol").isNull()
                & F.col("__vac").isNull() & rostered(seed))
    j = j.filter((unfitted & F.col("__sys").isNotNull()) | human_on)
    day0 = F.col("date").cast("timestamp_ntz")

    def at(hours):
        return day0 + F.make_dt_interval(secs=F.round(hours * 3600.0, 6).cast("decimal(18,6)"))
    a = F.when(unfitted, day0).otherwise(at(F.col("open_h")))
    b = F.when(unfitted, day0 + F.expr("interval 1 day")).otherwise(at(F.col("close_h")))
    out = j.select("resource", F.greatest(a, lo).alias("avail_start"),
                   F.least(b, hi).alias("avail_end"))
    return out.filter(F.col("avail_end") > F.col("avail_start"))


def availability_seconds(resources: DataFrame, intervals: DataFrame) -> DataFrame:
    """resource, seconds; a resource without intervals counts 0."""
    s = intervals.groupBy("resource").agg(
        F.sum(seconds_between("avail_start", "avail_end")).alias("seconds"))
    return resources.select("resource").distinct().join(s, "resource", "left").withColumn(
        "seconds", F.coalesce("seconds", F.lit(0.0)))


# Months compared by the daylight-saving probe.
WINTER, SUMMER = (11, 12, 1, 2), (5, 6, 7, 8)


def dst_probe(df: DataFrame, zone: str = "Europe/Amsterdam") -> DataFrame:
    """5th percentile of the hour in winter and summer, read in UTC and in a local zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("timestamp"))

    def row(name, t):
        return F.struct(F.lit(name).alias("read_as"), F.month(t).alias("m"),
                        (F.hour(t) + F.minute(t) / F.lit(60.0)).alias("h"))
    r = df.select(F.explode(F.array(row("UTC", F.col("timestamp")), row("local", local)))
                  .alias("c")).select("c.*")
    r = r.withColumn("winter", F.when(F.col("m").isin(*WINTER), F.col("h"))).withColumn(
        "summer", F.when(F.col("m").isin(*SUMMER), F.col("h")))
    keys = ["read_as"]
    out = r.select("read_as").distinct()
    for s in ("winter", "summer"):
        out = out.join(quantiles(r, keys, s, {s: 0.05}), keys, "left")
    return out.withColumn("shift", F.abs(F.col("winter") - F.col("summer")))


# Fixed value: rows of the presence that one task of the A/B-week test orders, about.
PARITY_ROWS = 1 << 19


def parity_test(p: DataFrame, min_days: int = 40, min_side: int = 5, seed: int = 0) -> DataFrame:
    """A/B-week test: median shift of the first hour between odd and even ISO weeks,
    against a split by a hash of the row. One row per split.

    The presence is shuffled once, by resource (a row a day: no more than the calendar has),
    into as many parts as its rows need, and ordered there; the days of a resource are added
    up from its cells.
    """
    p = settled(p.select("resource", "date", "dow", F.col("first").cast("double").alias("first")))
    parts = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), p.count() // PARITY_ROWS + 1)
    coin = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "resource",
                                                F.col("date").cast("string"))), 1, 8), 16, 10) \
        .cast("bigint") % 2
    cells = p.repartition(parts, "resource").select("resource", "dow", "first", F.explode(F.array(
        F.struct(F.lit("week").alias("split"), (F.weekofyear("date") % 2).alias("side")),
        F.struct(F.lit("null").alias("split"), coin.cast("int").alias("side")))).alias("c")) \
        .select("resource", "dow", "first", "c.*")
    keys = ["split", "resource", "dow", "side"]
    w = Window.partitionBy(*keys)
    placed = cells.withColumn("__r", F.row_number().over(w.orderBy(F.col("first").asc_nulls_last())) - 1) \
        .withColumns({"__n": F.count(F.lit(1)).over(w), "__k": F.count("first").over(w)})
    at = (F.col("__k") - 1) * 0.5
    lo, hi = F.col("__r") == F.floor(at), F.col("__r") == F.ceil(at)
    med = placed.filter((F.col("__r") == 0) | lo | hi).groupBy(*keys).agg(
        F.max("__n").alias("n"), F.max(F.when(lo, F.col("first"))).alias("__lo"),
        F.max(F.when(hi, F.col("first"))).alias("__hi"))
    med = med.withColumns({"m": F.col("__lo") * 0.5 + F.col("__hi") * 0.5,
                           "__d": F.sum("n").over(Window.partitionBy("split", "resource"))})
    med = med.filter((F.col("__d") >= min_days) & (F.col("n") >= min_side)).dropna(subset=[*keys, "m"])
    pair = med.groupBy("split", "resource", "dow").agg(
        F.count(F.lit(1)).alias("sides"), (F.max("m") - F.min("m")).alias("shift"))
    pair = staged(pair.filter("sides = 2"))
    agg = pair.groupBy("split").agg(F.count(F.lit(1)).alias("n_cells"),
                                    F.avg((F.col("shift") > 1).cast("double")).alias("share_over_1h"))
    return agg.join(quantiles(pair, ["split"], "shift", {"median_shift": 0.5}), "split")


def roster_headcount_error(p: DataFrame, windows: DataFrame, holidays: DataFrame,
                           seed: int) -> DataFrame:
    """One row: mean and sd of real and rostered weekday headcount, relative error of the mean."""
    hol = holidays.select("date").distinct()
    span = p.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    cal = span.select(F.explode(F.sequence("lo", "hi")).alias("date")).filter(
        monday_dow("date") < 5).join(hol, "date", "left_anti").withColumn("dow", monday_dow("date"))
    # calendar dates meet the windows of their weekday
    on = windows.join(cal, "dow").filter(rostered(seed)).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"))
    sim = cal.select("date").join(on, "date", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    real = weekday_headcount(p).filter("headcount > 0")
    s = sim.agg(F.avg("n").alias("m"), F.stddev_samp("n").alias("s"))
    out = real.agg(F.avg("headcount").alias("real_mean"),
                   F.stddev_samp("headcount").alias("real_sd"))
    out = out.withColumns({"model_mean": s.select("m").scalar(), "model_sd": s.select("s").scalar()})
    return out.withColumn("relative_error", F.abs(
        ratio(F.col("model_mean") - F.col("real_mean"), "real_mean")))


def extra_presence(df: DataFrame, transition: str = "schedule") -> DataFrame:
    """(resource, date) cells seen only through one kind of transition."""
    cell = [F.col("resource"), F.to_date("timestamp").alias("date")]
    is_t = F.col("lifecycle") == transition
    per = df.filter(F.col("resource").isNotNull()).groupBy(*cell).agg(
        F.min(is_t.cast("int")).alias("only"))
    return per.filter("only = 1").select("resource", "date")


def tier_membership(p: DataFrame, members: DataFrame, system: DataFrame,
                    min_active_days: int = MIN_ACTIVE_DAYS) -> DataFrame:
    """Per resource of a group: active days, events per day, span and tier A/B/C."""
    per = p.groupBy("resource").agg(
        F.countDistinct("date").alias("active_days"), F.sum("n_events").alias("events"),
        (F.date_diff(F.max("date"), F.min("date")) + 1).alias("span_days"))
    sys = system.select("resource").distinct().withColumn("__s", F.lit(True))
    j = members.select("grp", "resource").join(per, "resource", "left").join(sys, "resource", "left")
    return j.withColumn("per_day", ratio("events", "active_days")).withColumn(
        "tier", F.when(F.col("__s").isNotNull(), "C")
        .when(F.coalesce("active_days", F.lit(0)) >= min_active_days, "A").otherwise("B")).drop("__s")


def tiers_by_group(membership: DataFrame) -> DataFrame:
    """Member counts per group and tier."""
    return membership.groupBy("grp").pivot("tier", ["A", "B", "C"]).agg(
        F.count(F.lit(1))).na.fill(0)


def group_clocks(p: DataFrame, members: DataFrame) -> DataFrame:
    """Median first and last hour of each group's member days."""
    j = p.join(members.select("grp", "resource"), "resource")
    return quantiles(j, ["grp"], "first", {"opens": 0.5}).join(
        quantiles(j, ["grp"], "last", {"closes": 0.5}), "grp")
