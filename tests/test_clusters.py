"""Clusterings and the model sweep against brute force."""

from datetime import timedelta

import numpy as np
import pytest
from helpers import BASE, frame
from pyspark.sql import functions as F

from caseloom.operators import clusters, fit, org


def vectors(spark, x, parts=3):
    rows = [(f"r{i:03d}", [float(v) for v in row], float(i % 3 + 1)) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "resource string, vec array<double>, n double").repartition(parts)


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], set()).add(r[1])
    return out


def greedy(x, k, linkage):
    parts = [[i] for i in range(len(x))]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(9)
    how = {"complete": np.max, "single": np.min, "average": np.mean}[linkage]
    while len(parts) > k:
        _, a, b = min((how(d[np.ix_(p, q)]), i, j) for i, p in enumerate(parts)
                      for j, q in enumerate(parts) if i < j)
        parts[a] = sorted(parts[a] + parts.pop(b))
        parts.sort()
    return {i: {f"r{m:03d}" for m in p} for i, p in enumerate(parts)}


@pytest.mark.parametrize("linkage", ["complete", "single", "average"])
def test_hierarchy_equals_one_merge_at_a_time(spark, linkage):
    x = np.random.default_rng(2).normal(0, 1, (18, 3))
    assert groups(clusters.hierarchical(vectors(spark, x), 4, linkage=linkage)) == greedy(x, 4, linkage)


def test_few_and_equal_vectors(spark):
    x = np.array([[0.0, 0]] * 6 + [[5.0, 5]] * 3)
    assert groups(clusters.hierarchical(vectors(spark, x), 2)) == greedy(x, 2, "complete")
    assert len(groups(clusters.hierarchical(vectors(spark, x[:2]), 5))) == 2
    assert clusters.hierarchical(vectors(spark, x[:0]), 5).collect() == []
    assert clusters.spherical(vectors(spark, x[:0]), 3, "resource").collect() == []
    assert clusters.overlapping(vectors(spark, x[:0]), 3).collect() == []
    assert {g for _, g in map(tuple, clusters.spherical(vectors(spark, x), 5, "resource").collect())} == {0}
    assert len(groups(clusters.overlapping(vectors(spark, x), 5))) == 2


def start(x, first, k, spherical):
    chosen = [x[first]]
    while len(chosen) < k:
        d = np.round(clusters._gap(x, np.array(chosen), spherical).min(1), 9)
        chosen.append(x[int(d.argmax())])
    return np.array(chosen)


def test_spherical_equals_numpy_and_any_partitioning(spark):
    r = np.random.default_rng(5)
    x = np.abs(np.concatenate([r.normal(c, 0.3, (30, 4)) for c in np.eye(4) * 2])).round(6)
    w = np.array([i % 3 + 1 for i in range(len(x))], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = start(x, int(w.argmax()), 4, True)
    for _ in range(50):
        c = c / np.linalg.norm(c, axis=1, keepdims=True)
        of = np.round(1 - unit @ c.T, 9).argmin(1)
        c = np.stack([(unit[of == g] * w[of == g, None]).sum(0) for g in range(4)])
    want = {f"r{i:03d}": int(g) for i, g in enumerate(of)}
    for parts in (1, 5):
        got = clusters.spherical(vectors(spark, x, parts), 4, "resource", "n")
        assert dict(map(tuple, got.collect())) == want


def test_overlapping_equals_numpy(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(0, 0.5, (20, 3)), r.normal(4, 0.5, (20, 3)), np.full((4, 3), 2.0)]).round(6)
    best = None
    for first in range(3):
        c = start(x, first, 2, False)
        for _ in range(200):
            d = ((x[:, None] - c) ** 2).sum(2)
            u = (1 / np.maximum(d, 1e-12))
            u = (u / u.sum(1, keepdims=True)) ** 2
            c = (u.T @ x) / u.sum(0)[:, None]
        cost = (u * d).sum()
        if best is None or cost < best[0] - 1e-9:
            best = (cost, np.sqrt(u))
    got = clusters.overlapping(vectors(spark, x), 2, share=0.3).collect()
    want = {(g, f"r{i:03d}"): best[1][i, g] for i in range(len(x)) for g in range(2)
            if best[1][i, g] >= 0.3}
    assert {(g.grp, g.resource) for g in got} == set(want)
    assert all(g.share == pytest.approx(want[g.grp, g.resource], abs=1e-5) for g in got)
    assert len(got) > len(x)      # those in the middle are in both


def test_sweep_equals_one_model_at_a_time(spark):
    r = np.random.default_rng(7)
    rows = [(f"CT.{r.integers(3)}", f"AT.{r.integers(4)}", f"TT.{r.integers(2)}", f"r{min(r.integers(14), 9)}", str(i))
            for i in range(600)]
    rl = spark.createDataFrame(rows, "case_type string, activity_type string, time_type string, "
                                     "resource string, case_id string")
    logs = {"activity": rl.withColumns({"case_type": F.lit(""), "time_type": F.lit("")}), "attribute": rl}
    members = {("activity", "x"): [(i % 3, f"r{i}") for i in range(10)],
               ("attribute", "x"): [(i % 4, f"r{i}") for i in range(10)] + [(0, "r1"), (1, "r2")]}
    members = {k: spark.createDataFrame(v, "grp int, resource string") for k, v in members.items()}
    got = {(x.contexts, x.profiling): x for x in org.sweep(logs, members).collect()}
    assert len(got) == 4
    for (form, how), m in members.items():
        for profiling in ("FullRecall", "OverallScore"):
            want = org.sweep_row(logs[form], m, form, how, profiling).first()
            for c in ("n_contexts", "n_groups", "fitness", "precision", "f1"):
                assert got[form, profiling][c] == pytest.approx(want[c], abs=1e-9), (form, profiling, c)
    assert sum(x.best for x in got.values()) == sum(x.deployable for x in got.values()) == 1
    assert max(got.values(), key=lambda x: x.f1).best


def test_counts_stand_for_the_events_of_a_log(spark):
    r = np.random.default_rng(8)
    rows = [(str(i % 9) if i % 13 else None, "abc"[r.integers(3)], f"r{r.integers(6)}" if i % 11 else None,
             "xy"[r.integers(2)] if i % 7 else None, BASE + timedelta(hours=int(r.integers(400))), i) for i in range(500)]
    df = frame(spark, rows, "case_id string, activity string, resource string, goal string, "
                            "timestamp timestamp_ntz, event_order long")
    told = spark.createDataFrame([(str(i), i % 2) for i in range(8)], "case_id string, cluster int")
    logs = {"activity": org.resource_log(df, "activity"), "attribute": org.resource_log(df, "attribute", "goal"),
            "clusters": org.resource_log(df, "clusters", clusters=told)}

    def told_rows(x, *cols):
        return sorted(map(str, x.select(*cols).collect()))
    forms = org.counted_forms(df, "goal", told)
    for f, rl in logs.items():
        want = org.context_counts(rl)
        assert told_rows(forms[f], *want.columns) == told_rows(want, *want.columns)
        assert told_rows(org.resource_profiles(forms[f]), "resource", "context", "weight") == \
            told_rows(org.resource_profiles(rl), "resource", "context", "weight")
        assert told_rows(org.context_counts(forms[f]), *want.columns) == told_rows(want, *want.columns)


def test_exact_tail_counts_all_orders(spark):
    from itertools import combinations
    for m, n in ((3, 4), (5, 5), (1, 6)):
        gaps = []
        for first in combinations(range(m + n), m):
            i = np.cumsum([x in first for x in range(m + n)])
            j = np.arange(1, m + n + 1) - i
            gaps.append(int(np.abs(i * n - j * m).max()))
        for g in set(gaps):
            assert fit.exact_ks_tail(g, m, n) == pytest.approx(np.mean([x >= g for x in gaps]), abs=1e-12)
    a, b = (spark.createDataFrame([(float(v),) for v in x], "v double") for x in ([1, 2, 3, 9], [4, 5, 6, 7, 8]))
    got = fit.two_sample_ks(a, b, "v").first()
    assert got.method == "exact" and got.p_value == pytest.approx(fit.exact_ks_tail(15, 4, 5))
    assert fit.two_sample_ks(a, b, "v", "asymptotic").first().method == "asymptotic"
