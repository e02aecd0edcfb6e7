"""The window sweep against a window definition at a time."""

import random

from helpers import frame
from pyspark.sql import functions as F

from caseloom.operators import calendars as C


def test_sweep_is_one_pass_and_equal_to_each_definition(spark, monkeypatch):
    r = random.Random(4)
    log = frame(spark, [(f"r{r.randint(0, 6)}", 86400 * r.randint(0, 40) + r.randint(0, 86399))
                        for _ in range(1500)], "resource string, s long").select(
        "resource", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs="s")).alias("timestamp"))
    p = C.presence(log)
    want = {}
    for name, lo, hi in (*C.SWEEP, ("global 9-17", C.START_Q, C.END_Q)):
        w = C.fit_weekly(p, 10, start_q=lo, end_q=hi)
        if name == "global 9-17":
            w = w.withColumns({"open_h": F.lit(9.0), "close_h": F.lit(17.0)})
        row = C.evaluate_weekly(w, log, p).first()
        want[name] = round(row["coverage"], 9), round(row["window_utilisation"], 9)
    calls, real = [], C.quantiles
    monkeypatch.setattr(C, "quantiles", lambda *a: calls.append(a) or real(*a))
    out = C.window_sweep(log, p, 10)
    got = {x["window"]: (round(x["coverage"], 9), round(x["window_utilisation"], 9)) for x in out.collect()}
    assert got == want and len(calls) == 2
    assert out.columns == ["coverage", "window_utilisation", "window"]
    none = C.window_sweep(log, p, 10_000).collect()
    assert {(x["coverage"], x["window_utilisation"]) for x in none} == {(None, 0.0)}


def test_parity_test_equals_brute_force_and_orders_its_days_once(spark, monkeypatch):
    from datetime import date, timedelta
    from statistics import median
    from zlib import crc32
    rows = [(f"r{i}" if i < 5 else None, date(2024, 1, 1) + timedelta(days=d), (crc32(f"{i}-{d}".encode()) % 24) + 0.5
             if d % 17 else None) for i in range(6) for d in range(0, 30 + 70 * i, 1 + i % 2)]
    p = spark.createDataFrame(rows, "resource string, date date, first double").withColumn("dow", F.weekday("date"))
    seen, plain = [], C.quantiles

    def spy(df, *args):
        seen.append(df.count())
        return plain(df, *args)
    monkeypatch.setattr(C, "quantiles", spy)
    got = {r.split: r for r in C.parity_test(p).collect()}
    assert set(got) == {"week", "null"}
    coins = {(r.resource, r.date): int(r.h, 16) % 2 for r in p.selectExpr(
        "resource", "date", "substr(md5(concat_ws('|', '0', resource, cast(date as string))), 1, 8) as h").collect()}
    for split, side in (("week", lambda r, d: d.isocalendar()[1] % 2), ("null", lambda r, d: coins[r, d])):
        cells = {}
        for r, d, f in rows:
            if r is not None and sum(x[0] == r for x in rows) >= 40:
                cells.setdefault((r, d.weekday()), {}).setdefault(side(r, d), []).append(f)
        shifts = []
        for c in cells.values():
            m = [median([f for f in v if f is not None]) for v in c.values() if len(v) >= 5 and any(v)]
            if len(m) == 2:
                shifts.append(abs(m[0] - m[1]))
        assert got[split].n_cells == len(shifts) > 10
        assert got[split].share_over_1h == sum(x > 1 for x in shifts) / len(shifts)
        assert got[split].median_shift == median(shifts)
    assert max(seen) <= 2 * 7 * 5       # cells, not days
