"""A parcel depot and a library desk: small logs whose answers follow by hand."""

import datetime as dt

import pytest
from helpers import BASE, at, frame, log, paired, rows
from pyspark.sql import functions as F

from caseloom.operators import calendars, kpi, lifecycle, org, pairing, shape, stats, validate
from caseloom.sources import logs as src

PACK, SCAN = "W_Pack", "W_Scan"


def seconds(spark, **by):
    return frame(spark, list(by.items()), "resource string, seconds double")


def test_parcel_log_is_ordered_by_case_time_and_source(spark):
    raw = spark.createDataFrame(
        [("p9", "O_Label", "2021-05-02T08:00:05Z", "ute", "COMPLETE", 0),
         ("p2", "A_Drop", "2021-05-02T07:59:00Z", "kim", "Complete", 1),
         ("p9", "W_Pack", "2021-05-02T08:00:05Z", "ute", "Start", 2),
         ("p9", "A_Drop", "2021-05-02T07:00:00Z", "ute", "complete", 3),
         ("p2", "W_Pack", "2021-05-02T07:59:00Z", "kim", "SCHEDULE", 4)],
        ["case:concept:name", "concept:name", "time:timestamp", "org:resource",
         "lifecycle:transition", "event_order"])
    out = shape.number_events(src.strict_log(raw))
    assert rows(out, "case_id", "event_order", "activity", "lifecycle") == [
        ("p2", 0, "A_Drop", "complete"), ("p2", 1, "W_Pack", "schedule"),
        ("p9", 0, "A_Drop", "complete"), ("p9", 1, "O_Label", "complete"), ("p9", 2, "W_Pack", "start")]


def test_missing_column_is_named(spark):
    df = spark.createDataFrame([("p", "t")], "case_id string, timestamp string")
    with pytest.raises(ValueError, match="activity"):
        src.strict_log(df)


def test_kth_start_meets_kth_complete(spark):
    # two parcels, packed three times and once: 4, 9, 2 and 6 seconds
    df = paired(spark, [("p1", PACK, "ute", 3, 4), ("p1", PACK, "kim", 50, 9), ("p1", PACK, "ute", 80, 2),
                        ("p2", PACK, "ute", 5, 6)])
    assert rows(pairing.processing_times(df), "case_id", "duration_s") == [
        ("p1", 2.0), ("p1", 4.0), ("p1", 9.0), ("p2", 6.0)]


def test_event_behind_an_item_at_the_same_second_follows_it(spark):
    df = log(spark, [("p", PACK, "ute", "start", 2), ("p", PACK, "ute", "ate_abort", 8),
                     ("p", "O_Return", "ute", "complete", 8), ("q", PACK, "kim", "start", 1),
                     ("q", PACK, "kim", "ate_abort", 5), ("q", "A_Hold", "kim", "complete", 6),
                     ("s", PACK, "kim", "start", 0), ("s", PACK, "kim", "ate_abort", 1),
                     ("s", "A_Hold", "kim", "complete", 1)])
    t = lifecycle.terminal_continuation(lifecycle.tokens(df, lifecycle.segment(df)))
    assert rows(t, "activity", "outcome", "next_activity", "p") == [
        (PACK, "abort", "A_Hold", pytest.approx(2 / 3)), (PACK, "abort", "O_Return", pytest.approx(1 / 3))] or \
        rows(t, "activity", "next_activity", "p") == [
            (PACK, "A_Hold", pytest.approx(2 / 3)), (PACK, "O_Return", pytest.approx(1 / 3))]


def test_delay_runs_from_end_to_first_schedule(spark):
    # drop ends at 4, packing is scheduled at 6 and ends at 31, the label follows at 38
    df = log(spark, [("p", "A_Drop", "ute", "complete", 4), ("p", PACK, "ute", "schedule", 6),
                     ("p", PACK, "ute", "start", 21), ("p", PACK, "ute", "complete", 31),
                     ("p", "O_Label", "kim", "complete", 38)])
    d = lifecycle.inter_activity_delays(lifecycle.tokens(df, lifecycle.segment(df)))
    assert rows(d, "activity", "next_activity", "delay_s") == [("A_Drop", PACK, 2.0), (PACK, "O_Label", 7.0)]


def test_tail_since_the_last_closing_hour(spark):
    # the desk is open Tuesday and Thursday, 10 to 14; a Tuesday noon loan comes back Wednesday 09:30
    tue = dt.datetime(2022, 3, 8, 12)
    wed = dt.datetime(2022, 3, 9, 9, 30)
    gaps = frame(spark, [("ann", tue, wed), ("ann", tue, tue + dt.timedelta(minutes=40)), ("bot", tue, wed)],
                 "resource string, suspended_at timestamp_ntz, resumed_at timestamp_ntz")
    gaps = gaps.withColumn("gap_s", F.timestamp_diff("SECOND", "suspended_at", "resumed_at").cast("double"))
    win = frame(spark, [("ann", 1, 10.0, 14.0), ("ann", 3, 10.0, 14.0)],
                "resource string, dow int, open_h double, close_h double")
    out = lifecycle.off_shift_tail(gaps, win, spark.createDataFrame([], "date date"),
                                   spark.createDataFrame([("bot",)], "resource string"))
    assert rows(out, "resource", "tail_s") == [("ann", 0.0), ("ann", 19.5 * 3600), ("bot", 0.0)]


def test_sessions_carry_the_context_of_their_item(spark):
    df = log(spark, [("p", "O_Label", "kim", "complete", 0), ("p", SCAN, "kim", "start", 7),
                     ("p", SCAN, "kim", "suspend", 12), ("p", SCAN, "ute", "resume", 30),
                     ("p", SCAN, "ute", "suspend", 33), ("p", SCAN, "kim", "resume", 40),
                     ("p", SCAN, "kim", "complete", 48)])
    t = lifecycle.training_sessions(df)
    assert [r[0] for r in rows(t, "duration_s")] == [3.0, 5.0, 8.0]
    assert {r[0] for r in rows(t, "previous_activity")} == {"O_Label"}
    assert {r[0] for r in rows(t, "case_age_seconds")} == {7.0}


def test_occupation_by_share_of_offered_time(spark):
    # ute works 45 of 180 s, kim 10 of 40 s, ann is there for 500 s and does nothing, bea never comes
    df = paired(spark, [("p1", PACK, "ute", 0, 25), ("p2", PACK, "ute", 40, 20), ("p3", SCAN, "kim", 5, 10)])
    occ = kpi.occupation(pairing.paired_instances(df), seconds(spark, ute=180.0, kim=40.0, ann=500.0, bea=0.0))
    assert rows(occ, "resource", "occupation") == [("ann", 0.0), ("bea", None), ("kim", 0.25), ("ute", 0.25)]
    s = kpi.occupation_summary(occ).first()
    assert s.avg_resource_occupation == pytest.approx(0.5 / 3)
    assert (s.n_resources_evaluated, s.n_resources_zero_availability) == (3, 1)


def test_occupation_with_some_work_only(spark):
    df = paired(spark, [("p1", "O_Label", "ute", 0, 7), ("p1", PACK, "ute", 9, 12), ("p1", SCAN, "ute", 30, 24)])
    have = seconds(spark, ute=240.0)
    inst = pairing.paired_instances(df)
    assert kpi.occupation(inst, have, prefixes=["W_"]).first().occupation == pytest.approx(0.15)
    assert kpi.occupation(inst, have, prefixes=["O_"]).first().busy_s == 7.0
    assert kpi.occupation(inst, have, prefixes=["X_"]).first().busy_s == 0.0


def test_overtime_at_both_ends_of_a_shift(spark):
    # shift from 100 to 700 s; work from 80 to 130 and from 690 to 760: 20 + 60 s outside
    df = paired(spark, [("p1", PACK, "ute", 80, 50), ("p2", PACK, "ute", 690, 70)])
    iv = frame(spark, [("ute", at(100), at(700))], "resource string, avail_start timestamp_ntz, avail_end timestamp_ntz")
    row = kpi.occupation(pairing.paired_instances(df), seconds(spark, ute=600.0), intervals=iv).first()
    assert row.overtime_s == 80.0 and row.occupation == pytest.approx(40 / 600)


def test_switches_between_kinds_of_work(spark):
    # ute: pack, pack, scan, pack, label -> 3 of 4 change; kim works once
    df = paired(spark, [(f"p{i}", a, "ute", 10 * i, 3) for i, a in enumerate([PACK, PACK, SCAN, PACK, "O_Label"])]
                + [("p9", SCAN, "kim", 2, 3)])
    inst = pairing.paired_instances(df)
    r = kpi.activity_switches(inst).first()
    assert (r.n_resource_transitions, r.n_activity_switches) == (4, 3)
    r = kpi.activity_switches(inst, ["W_"]).first()
    assert (r.n_resource_transitions, r.activity_switch_rate) == (3, pytest.approx(2 / 3))


def test_balance_over_three_desks(spark):
    # one day: loads of a half, a quarter and nothing; their standard deviation is sqrt(1 / 24)
    df = paired(spark, [("p1", PACK, "ute", 0, 43_200), ("p2", PACK, "kim", 0, 21_600)])
    staff = frame(spark, [("ute",), ("kim",), ("ann",)], "resource string")
    r = kpi.workload_balance(pairing.paired_instances(df), subset=staff).first()
    assert r.n_windows == 1 and r.mean_window_std == pytest.approx((1 / 24) ** 0.5)


def test_exposure_counts_events_and_seconds(spark):
    # busy: 30 s of W work, 12 s of A and O work
    df = paired(spark, [("p1", "A_Drop", "ute", 0, 8), ("p1", PACK, "kim", 10, 18), ("p1", SCAN, "kim", 40, 12),
                        ("p1", "O_Label", "ute", 60, 4), ("p2", PACK, "ute", 70, 0)])
    r = kpi.exposure(df, pairing.paired_instances(df)).first()
    assert (r.event_rows, r.w_event_rows, r.ao_event_rows) == (10, 6, 4)
    assert r.w_event_share == pytest.approx(0.6) and r.ao_busy_share == pytest.approx(12 / 42)


def test_nothing_in_nothing_out(spark):
    df = log(spark, [("p", PACK, "ute", "start", 0)]).limit(0)
    inst = pairing.paired_instances(df)
    assert kpi.cycle_time(df).first().avg_cycle_time_s is None
    assert kpi.handover(inst).first().handover_rate is None
    assert kpi.time_to_milestone(df, ["O_Label"]).first().n_cases_reaching_it == 0


def test_items_made_of_sessions(spark):
    # i1: two pauses, 6 + 5 + 9 s of work within 41 s; i2: done at once; i3: called off after 13 s
    ev = [("p", PACK, "ute", "schedule", 0, "i1"), ("p", PACK, "ute", "start", 3, "i1"),
          ("p", PACK, "ute", "suspend", 9, "i1"), ("p", PACK, "ute", "resume", 15, "i1"),
          ("p", PACK, "ute", "suspend", 20, "i1"), ("p", PACK, "kim", "resume", 35, "i1"),
          ("p", PACK, "kim", "complete", 44, "i1"), ("p", SCAN, "kim", "start", 50, "i2"),
          ("p", SCAN, "kim", "complete", 54, "i2"), ("p", SCAN, "ute", "schedule", 60, "i3"),
          ("p", SCAN, "ute", "withdraw", 73, "i3")]
    df = log(spark, ev, ", work_item_id string")
    items = lifecycle.recomposed_items(df)
    assert rows(items, "work_item_id", "terminal", "active_s", "elapsed_s", "suspends") == [
        ("i1", "complete", 20.0, 41.0, 2), ("i2", "complete", 4.0, 4.0, 0), ("i3", "withdraw", 0.0, 13.0, 0)]
    own = {r.activity: r.same_resource_rate for r in lifecycle.resume_ownership(df).collect()}
    assert own[PACK] == pytest.approx(0.5)
    c = lifecycle.churn(df, max_sessions=3).first()
    assert (c.work_items, c.max_sessions, c.at_guard, c.withdrawals) == (3, 3, 1, 1)


def reference(spark, *r):
    return frame(spark, list(r), "activity string, next_activity string, p double")


def cases(spark, *traces):
    return log(spark, [(f"p{i}", a, "ute", "complete", 7 * k) for i, t in enumerate(traces) for k, a in enumerate(t)])


def test_branching_compared_absent_and_always_last(spark):
    # drop -> pack 3 of 4, drop -> hold 1 of 4, against one half each: distance a quarter
    df = cases(spark, ["drop", "pack"], ["drop", "pack"], ["drop", "pack"], ["drop", "hold"])
    ref = reference(spark, ("drop", "pack", 0.5), ("drop", "hold", 0.5), ("pack", "label", 1.0),
                    ("lost", "found", 1.0))
    got = {r.activity: (r.status, r.tvd) for r in validate.branching_divergence(df, ref).collect()}
    assert got["drop"] == ("compared", pytest.approx(0.25))
    assert got["pack"] == ("always_terminal", None) and got["lost"] == ("absent", None)


def test_unmodelled_successors_are_left_out(spark):
    df = cases(spark, ["drop", "pack"], ["drop", "pack"], ["drop", "hold"])
    ref = reference(spark, ("drop", "pack", 0.4), ("drop", "hold", 0.2), ("drop", "burn", 0.4), ("burn", "ash", 1.0))
    model = frame(spark, [("drop",), ("pack",), ("hold",)], "activity string")
    got = {r.activity: r for r in validate.branching_divergence(df, ref, model).collect()}
    assert got["drop"].excluded_mass == pytest.approx(0.4) and got["drop"].tvd == pytest.approx(0.0)
    assert got["burn"].status == "not_in_model"


def test_warmup_of_three_days(spark):
    t0 = dt.datetime(2022, 6, 1)
    day = lambda x: t0 + dt.timedelta(days=x)       # noqa: E731
    df = log(spark, [(c, PACK, "ute", "start", 60 * i) for i, c in enumerate(["a", "b", "c"])])
    arr = frame(spark, [("a", day(1)), ("b", day(3.5)), ("c", day(6))], "case_id string, arrival timestamp_ntz")
    assert rows(shape.after_warmup(df, arr, t0, day(8), 3), "case_id") == [("b",), ("c",)]
    iv = frame(spark, [("ute", day(2.5), day(4)), ("ute", day(7.75), day(9))],
               "resource string, avail_start timestamp_ntz, avail_end timestamp_ntz")
    clipped = shape.clip_intervals(iv, day(3), day(8))
    assert calendars.availability_seconds(iv, clipped).first().seconds == 1.25 * 86_400
    with pytest.raises(ValueError):
        shape.after_warmup(df, arr, t0, day(8), 8)


def test_cycle_time_averages_over_cases(spark):
    df = paired(spark, [("p", PACK, "ute", 500, 60), ("q", PACK, "ute", 900, 60)])
    arr = frame(spark, [("p", BASE), ("q", at(300))], "case_id string, arrival timestamp_ntz")
    done = frame(spark, [("p", at(1_000)), ("q", at(2_300))], "case_id string, completion timestamp_ntz")
    assert kpi.cycle_time(df, arr, done).first().avg_cycle_time_s == 1_500.0


@pytest.mark.parametrize("ct, tt, want", [
    ("CT.bulk", "TT.Friday", ["kim", "ute"]), ("CT.bulk", "TT.Tuesday", []),
    ("CT.gift", "TT.Tuesday", ["ann"]), ("CT.gift", "TT.Friday", []),
    ("CT.odd", "TT.Friday", ["kim", "ute"]), ("CT.odd", "TT.Tuesday", ["ann"])])
def test_who_may_take_a_parcel(spark, ct, tt, want):
    m = frame(spark, [(1, "kim"), (1, "ute"), (4, "ann")], "grp int, resource string")
    c = frame(spark, [(1, "CT.bulk", PACK, "TT.Friday"), (4, "CT.gift", PACK, "TT.Tuesday")],
              "grp int, ct string, at string, tt string")
    ask = spark.createDataFrame([(PACK, ct, tt)], "activity string, case_type string, time_type string")
    assert sorted(r.resource for r in org.candidates(ask, m, c).collect()) == want
    n = org.candidate_counts(ask, m, c).first()
    assert n.n == len(want) and n.sole == (want[0] if len(want) == 1 else None)


def test_unknown_weekday_is_refused(spark):
    c = frame(spark, [(1, "CT.bulk", PACK, "TT.Friday")], "grp int, ct string, at string, tt string")
    org.self_check(c)
    with pytest.raises(ValueError):
        org.self_check(c.withColumn("tt", F.lit("TT.Fryday")))


def test_roster_is_a_fixed_draw_per_person_and_day(spark):
    days = spark.range(6_000).select(
        F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("resource"), F.lit(0.4).alias("p_work"),
        F.date_add(F.lit("2020-02-01").cast("date"), (F.col("id") / 3).cast("int")).alias("date"))
    x = days.select("resource", "date", calendars.rostered(11).alias("a"), calendars.rostered(11).alias("again"),
                    calendars.rostered(12).alias("other")).toPandas()
    assert (x.a == x.again).all() and (x.a != x.other).any()
    # five standard deviations of the mean of 2,000 draws at 0.4
    assert x.groupby("resource").a.mean().between(0.4 - 0.055, 0.4 + 0.055).all()
    assert days.select(calendars.rostered(None).alias("n")).filter("not n").count() == 0


def test_next_step_by_visit_then_overall(spark):
    overall = reference(spark, ("drop", "pack", 0.7), ("drop", "hold", 0.3), ("pack", "label", 0.55),
                        ("pack", "scan", 0.45))
    by = frame(spark, [("drop", "3+", "hold", 0.8), ("drop", "3+", "pack", 0.2), ("pack", "1", "scan", 1.0)],
               "activity string, visit_bucket string, next_activity string, p double")
    ask = frame(spark, [("drop", 1), ("drop", 5), ("pack", 1), ("pack", 2), ("label", 1), ("what", 2)],
                "activity string, visit int")
    out = stats.predict_next(ask, by, overall, terminal=["label"])
    assert rows(out, "activity", "visit", "predicted") == [
        ("drop", 1, "pack"), ("drop", 5, "hold"), ("label", 1, None), ("pack", 1, "scan"), ("pack", 2, "label"),
        ("what", 2, None)]


def test_run_check_names_unassigned_starts(spark):
    good = [("p", PACK, "ute", "start", 0), ("p", PACK, "ute", "complete", 5)]
    assert kpi.check_run(log(spark, good))["missing_resource_starts"] == 0
    with pytest.raises(AssertionError, match="unassigned"):
        kpi.check_run(log(spark, [*good, ("q", SCAN, "", "start", 3)]))
