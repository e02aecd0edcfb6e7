"""Windows against plain loops on random logs, with and without hot keys."""

import math
import random

import numpy as np
import pytest
from helpers import log

from caseloom.functions.special import digamma, kolmogorov_tail, lgamma, student_two_sided, trigamma
from caseloom.operators import fit, lifecycle, pairing, replay, shape, stats
from caseloom.plans.replay import NET

LC = ["schedule", "start", "suspend", "resume", "complete", "ate_abort", "withdraw"]
SIZES = {"c0": 150, "c1": 30, "c2": 12, "c3": 3}        # c0 holds most of the rows


def events(seed):
    r = random.Random(seed)
    out = []
    for case, n in SIZES.items():
        t = 0
        for _ in range(n):
            t += r.choice([0, 1, 3, 10])
            a = r.choice(["W_a", "W_a", "W_b", "A_x"])
            out.append((case, a, r.choice(["r1", "r2"]), r.choice(LC) if a[0] == "W" else "complete", t))
    return out


def machine(rows):
    """The item state machine, one (case, activity) at a time."""
    facts, state = [], {}
    for i, (case, act, res, lc, t) in enumerate(rows):
        if act[0] != "W":
            continue
        k = (case, act)
        cur = state.get(k)
        if lc in ("schedule", "start"):
            if cur is None:
                cur = state[k] = {"by": lc, "at": t, "run": None, "sus": None}
            if lc == "start":
                cur["run"], cur["sus"] = t, None
        elif lc == "resume":
            if cur and cur["sus"] is not None:
                facts.append(("gap", i, float(t - cur["sus"])))
                cur["run"], cur["sus"] = t, None
        elif lc == "suspend":
            if cur and cur["run"] is not None:
                facts.append(("suspend", i, float(t - cur["run"])))
                cur["run"], cur["sus"] = None, t
        else:
            if cur and cur["run"] is not None and lc != "withdraw":
                facts.append(("abort" if lc == "ate_abort" else lc, i, float(t - cur["run"])))
            if cur and lc == "withdraw" and cur["by"] == "schedule" and cur["run"] is None:
                facts.append(("wait", i, float(t - cur["at"])))
            facts.append(("ready", i, float(t - (cur["at"] if cur else t))))
            state[k] = None
    return sorted(facts)


def spark_facts(df):
    from caseloom.functions.columns import seconds_between
    from pyspark.sql import functions as F
    seg = lifecycle.segment(df)
    parts = [
        lifecycle.active_sessions(seg).select("outcome", "event_order", "seconds"),
        lifecycle.resume_gaps(seg).select(F.lit("gap"), "event_order", "gap_s"),
        lifecycle.withdraw_waits(seg).select(F.lit("wait"), "event_order", "wait_s"),
        lifecycle.tokens(df, seg).filter("outcome is not null").select(
            F.lit("ready"), "event_order", seconds_between("ready_ts", "end_ts"))]
    return sorted(tuple(r) for p in parts for r in p.collect())


def fifo(rows):
    wait, out = {}, []
    for case, act, _, lc, t in rows:
        q = wait.setdefault((case, act), [])
        if lc == "start":
            q.append(t)
        elif lc == "complete" and q:
            out.append((case, act, float(t - q.pop(0))))
    return sorted(out)


def test_item_states_and_fifo_equal_the_loop(spark):
    rows = events(1)
    df = log(spark, rows)
    assert spark_facts(df) == machine(rows)
    got = pairing.fifo_pairs(df).select("case_id", "activity", "duration_s").collect()
    assert sorted(tuple(r) for r in got) == fifo(rows)


def test_replay_of_variants_equals_replay_of_every_case(spark):
    r = random.Random(5)
    rows, want = [], {"perfect": 0, "repaired": 0}
    for c in range(25):
        trace = [r.choice(["user", "assistant", "system", "other"]) for _ in range(r.randrange(1, 6))]
        rows += [(f"c{c}", a, "r", "complete", i) for i, a in enumerate(trace)]
        p, m, bad = replay.Player(NET), NET.initial, False
        for a in trace:
            kind, m, *_ = p.step(m, a)
            bad |= kind != "legal"
        want["repaired" if bad else "perfect"] += 1
    df = log(spark, rows)
    s = replay.replay_summary(replay.replay(df, NET)).first()
    assert (s.n_perfect, s.n_repaired) == (want["perfect"], want["repaired"])


def test_long_traces_are_replayed_in_blocks_with_the_same_steps(spark, monkeypatch):
    """A trace of a third of the events, one of a quarter, and short ones that begin like them."""
    r = random.Random(8)
    traces = {f"c{c}": [r.choice(["user", "assistant", "system"]) for _ in range(r.randrange(1, 8))] for c in range(40)}
    traces["big"] = ["system"] + ["user", "assistant"] * 60
    traces["like"] = traces["big"][:9]
    traces["odd"] = [r.choice(["user", "assistant", "assistant", "system", "other"]) for _ in range(90)]
    df = log(spark, [(c, a, "r", "complete", i) for c, t in traces.items() for i, a in enumerate(t)])
    whole = sorted(map(tuple, replay.replay(df, NET).collect()))
    precise = replay.precision(replay.replay(df, NET)).first()[0]
    monkeypatch.setattr(replay.ordered, "LEAST", 16)
    seen = []
    cut = replay._in_pieces
    monkeypatch.setattr(replay, "_in_pieces", lambda *a: seen.append(a[3]) or cut(*a))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        steps = replay.replay(df, NET)
        assert sorted(map(tuple, steps.collect())) == whole and seen[0] > 4
        assert replay.precision(steps).first()[0] == precise
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # the same steps as those of the firing rule, one event after the other
    p, m = replay.Player(NET), NET.initial
    kinds = []
    for a in traces["odd"]:
        kind, m, *_ = p.step(m, a)
        kinds.append(kind)
    assert [x[1] for x in sorted((x.position, x.kind) for x in steps.collect()
                                 if x.example_case == "odd" and x.kind != "end")] == kinds
    assert replay.reachable(NET, 1) is None and replay.reachable(NET)[0] == NET.initial


def test_repair_caps_places_at_one_token():
    p = replay.Player(NET)
    m = p.step(NET.initial, "user")[1]
    kind, m, _, _, lack, surplus = p.step(m, "user")
    assert (kind, m, lack, surplus) == ("repaired", (("turn", 1),), 1, 1)
    assert p.step(m, "nothing")[0] == "unknown" and p.stop_cost(m) == (1, 1)


def grid_weibull(x):
    best = None
    for c in np.exp(np.linspace(math.log(0.2), math.log(5), 4001)):
        s = np.mean(x ** c) ** (1 / c)
        ll = np.sum(np.log(c / s) + (c - 1) * np.log(x / s) - (x / s) ** c)
        if best is None or ll > best[0]:
            best = (ll, c, s)
    return best


@pytest.mark.parametrize("law, draw", [
    ("gamma", lambda g: g.gamma(4.0, 30.0, 3000)), ("weibull_min", lambda g: 500 * g.weibull(0.6, 3000)),
    ("lognorm", lambda g: g.lognormal(4, 1.2, 3000)), ("expon", lambda g: np.array([1.0, 2, 3]))])
def test_best_fit_finds_the_law(spark, law, draw):
    import pandas as pd
    g = np.random.default_rng(7)
    x = draw(g)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x}))
    row = fit.best_fit(df, ["k"], "x").first()
    assert row.distribution == law
    if law == "weibull_min":
        ll, c, s = grid_weibull(x)
        assert row.params[0] == pytest.approx(c, rel=2e-3) and row.params[2] == pytest.approx(s, rel=2e-3)
    if law == "gamma":
        assert row.params[0] == pytest.approx(4.0, rel=0.1)
    if law == "expon":
        assert list(row.params) == [0.0, 2.0]


def test_constant_values_drop_degenerate_families(spark):
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * 9, "x": [5.0] * 9}))
    assert fit.best_fit(df, ["k"], "x").first().distribution in ("expon", "norm")


def test_special_functions(spark):
    from pyspark.sql import functions as F
    one = spark.range(1)
    v = one.select(lgamma(F.lit(3.7)), digamma(F.lit(1.0)), trigamma(F.lit(1.0)),
                   student_two_sided(F.lit(2.2621571627), F.lit(9.0)), student_two_sided(F.lit(0.5), F.lit(3.0)),
                   kolmogorov_tail(F.lit(1.36))).first()
    want = (math.lgamma(3.7), -0.5772156649015329, math.pi ** 2 / 6, 0.05, 0.6514, 0.0495)
    for a, b, tol in zip(v, want, (1e-10, 1e-10, 1e-10, 1e-8, 1e-3, 1e-3)):
        assert a == pytest.approx(b, abs=tol)


def test_top_peers_over_many_blocks(spark, monkeypatch):
    import pandas as pd
    from caseloom.functions import blocks
    g = np.random.default_rng(3)
    m = g.random((40, 5)).round(2)
    df = spark.createDataFrame(pd.DataFrame([(f"k{i:02d}", f"d{j}", m[i, j]) for i in range(40) for j in range(5)],
                                            columns=["k", "d", "v"]))
    v = blocks.dense(df, "k", "d", "v")

    def got():
        return sorted(tuple(r) for r in blocks.pairwise(v, "k", "cosine", 5).collect())
    whole = got()
    monkeypatch.setattr(blocks, "BLOCK", 9)
    assert got() == whole and len(whole) == 200
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = n @ n.T
    np.fill_diagonal(s, -1)
    assert all(abs(r[2] - np.sort(s[int(r[0][1:])])[::-1][r[3] - 1]) < 1e-8 for r in whole)


def test_queries_agree_with_sql_on_the_smallest_tables(spark):
    import duckdb

    import __spark_entry__ as e
    import verify
    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    for t in verify.TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 200
    for name in ("A7_branching", "L3_session_end", "K5_time_to_milestone", "N1_fitness"):
        df = qs[name](spark, d)
        cur = con.execute(sql[name])
        assert verify.rows(df.columns, [tuple(r) for r in df.collect()])[:2] == \
            verify.rows([c[0] for c in cur.description], cur.fetchall())[:2], name
