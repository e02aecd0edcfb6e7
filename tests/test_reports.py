"""The full reports, end to end over an events table, against plain Python and SQL."""

import datetime as dt
import json
import random
from collections import Counter, defaultdict
from statistics import mean

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points

MID = dt.datetime(2024, 1, 16)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng = random.Random(5)
    types = ("click", "view", "purchase", "signup", "error")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=rng.randrange(30 * 86400)), rng.randrange(25),
             rng.choice(types), rng.uniform(0, 60), json.dumps({"k": rng.randrange(100)}))
            for i in range(1500)]
    d = tmp_path_factory.mktemp("events")
    df = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    spark.createDataFrame(df, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                          "value double, props string").write.parquet(str(d / "events.parquet"))
    return str(d), rows


def item_rows(rows):
    out = []
    for i, ts, user, kind, value, props in rows:
        k = json.loads(props)["k"]
        r = k % 5
        act = f"A_{kind}" if r == 0 else f"O_{kind}" if r == 1 else f"W_{r}"
        step = "complete" if r < 2 else {"signup": "schedule", "click": "start", "error": "suspend",
                                         "view": "resume"}.get(kind) or (
            "withdraw" if value < 8 else "ate_abort" if value < 20 else "complete")
        out.append((str(user), act, ts, step, f"{user}-{act}-{ts.day // 8}", i))
    return sorted(out, key=lambda e: (e[2], e[5]))


def by_case(log, n=0):
    out = defaultdict(list)
    for e in log:
        out[e[n]].append(e)
    return out


def mined(log):
    """Everything the report compares, from one log."""
    done = [e for e in log if e[3] == "complete"]
    steps = defaultdict(Counter)
    for es in by_case(done).values():
        for a, b in zip(es, es[1:]):
            steps[a[1]][b[1]] += 1
    p = {a: {b: n / sum(c.values()) for b, n in c.items()} for a, c in steps.items()}
    took = defaultdict(list)
    for es in by_case(log, 4).values():
        es = [e for e in es if e[3] in ("start", "resume", "suspend", "complete")]
        for a, b in zip(es, es[1:]):
            if a[3] in ("start", "resume") and b[3] in ("suspend", "complete"):
                took[a[1]].append((b[2] - a[2]).total_seconds())
    first = [es[0][2] for es in by_case(log).values()]
    at = sorted(set(first))
    days = Counter(t.date() for t in first)
    inner = [n for t, n in days.items() if len(days) <= 2 or min(days) < t < max(days)]
    held = defaultdict(list)
    for es in by_case(log, 4).values():
        if es[0][1].startswith("W_"):
            held[es[0][1]].append(sum(e[3] == "suspend" for e in es))
    traces = {c: tuple(e[1] for e in es) for c, es in by_case(done).items()}
    tops = Counter(traces.values())
    some = {t: min(c for c, x in traces.items() if x == t) for t in tops}
    return {
        "p": p, "acts": {e[1] for e in done}, "took": {a: mean(x) for a, x in took.items()},
        "gap": mean((b - a).total_seconds() for a, b in zip(at, at[1:])),
        "daily": mean(days.values()), "inner": mean(inner),
        "hod": [sum(t.hour == h for t in first) / len(first) for h in range(24)],
        "dow": [sum(t.weekday() == w for t in first) / len(first) for w in range(7)],
        "held": {a: mean(x) for a, x in held.items()}, "traces": set(traces.values()),
        "top": [(t, n * 100 / len(traces)) for t, n in
                sorted(tops.items(), key=lambda x: (-x[1], some[x[0]]))[:20]],
        "length": mean(map(len, traces.values())), "n": len(by_case(log)),
        "span": mean((es[-1][2] - es[0][2]).total_seconds() for es in by_case(done).values())}


def brute(log, reference):
    s, r = mined(log), mined(reference)
    out = {("cases.n", None): s["n"]}
    tvd = {}
    for a, ps in r["p"].items():
        q = s["p"].get(a)
        tvd[a] = q and sum(abs(ps.get(b, 0) - q.get(b, 0)) for b in {*ps, *q}) / 2
        out["branching.tvd", a] = tvd[a]
    out["branching.mean_tvd", None] = mean(round(x, 4) for x in tvd.values() if x is not None)
    for a, x in r["took"].items():
        out["processing_times.rel_err_mean", a] = abs(s["took"][a] - x) / x
    for a, x in r["held"].items():
        out["suspends.abs_error", a] = abs(s["held"][a] - x)
    out |= {("arrival_rate.sim_mean_interarrival_s", None): s["gap"],
            ("arrival_rate.sim_daily_arrivals_mean", None): s["inner"],
            ("arrival_rate.rel_err", None): abs(s["gap"] - r["gap"]) / r["gap"],
            ("arrival_rate.daily_arrivals_rel_err", None): abs(s["inner"] - r["daily"]) / r["daily"]}
    for k in ("hod", "dow"):
        out["arrival_profile.mae", k] = mean(abs(x - y) for x, y in zip(s[k], r[k]))
    hit = [(t in s["traces"], tuple(a for a in t if a in s["acts"]), t, pct) for t, pct in r["top"]]
    loose = [h or (x != t and x in s["traces"]) for h, x, t, _ in hit]
    out |= {("variants.n_found", None): sum(h[0] for h in hit),
            ("variants.pct_found", None): sum(h[3] for h in hit if h[0]),
            ("variants.n_found_ignoring_absent", None): sum(loose),
            ("variants.pct_found_ignoring_absent", None): sum(h[3] for h, ok in zip(hit, loose) if ok),
            ("case_stats.sim_case_length_mean", None): s["length"],
            ("case_stats.sim_case_duration_mean_s", None): s["span"],
            ("case_stats.case_length_rel_err", None): abs(s["length"] - r["length"]) / r["length"],
            ("case_stats.case_duration_rel_err", None): abs(s["span"] - r["span"]) / r["span"]}
    return out


@pytest.mark.parametrize("name", ["V7_full_evaluate", "V10_full_evaluation"])
def test_evaluation_has_every_row(spark, events, name):
    d, rows = events
    log = item_rows(rows)
    early = [e for e in log if e[2] < MID]
    want = brute(log if name.startswith("V7") else [e for e in log if e[2] >= MID], early)
    out = entry_points.queries()[name](spark, d).collect()
    got = {(r["metric"], r["key"]): r["value"] for r in out}
    assert len(got) == len(out)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-6), k
    assert any(v for (m, _), v in got.items() if m.startswith("branching"))


def test_kpi_report_has_every_row(spark, events):
    d, _ = events
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{d}/events.parquet/*.parquet'")
    cells = con.execute(entry_points.oracle_sql()["K10_full_report"]).fetchall()
    want = dict(cells)
    out = entry_points.queries()["K10_full_report"](spark, d).collect()
    got = {r["metric"]: r["value"] for r in out}
    assert len(out) == len(got) == len(cells) == 27 and set(got) == set(want)
    assert {m.split(".")[0] for m in got} == {
        "cycle_time", "occupation", "fairness", "time_to_first_offer", "time_to_decision", "handover",
        "switches", "balance", "cases"}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-3), k
