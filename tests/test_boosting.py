"""Boosting against a plain numpy version that uses the same bins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import boosting as B

FEATURES = ["a", "b", "c"]


def data(seed, n):
    r = np.random.default_rng(seed)
    x = np.stack([r.integers(0, 5, n), r.normal(0, 1, n).round(3), r.integers(0, 200, n)], 1).astype(float)
    y = np.where(x[:, 0] > 2, 3.0, 1.0) + np.sin(x[:, 2] / 40) + r.gamma(1.0, 0.5, n) * (1 + x[:, 0])
    return x, y


def frame(spark, x, y):
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double")


def plain(model, x, y, keys, trees, depth, rate, share, leaf, levels, seed=42):
    """Rows one by one in nested calls: (predictions in grid steps, one column per level)."""
    bins = model.bins(x)
    t = np.rint((y - model.low) / model.step).astype(np.int64)
    q = levels or [None]

    def quantile(v, p):
        return np.sort(v)[max(1, math.ceil(p * len(v) - 1e-9)) - 1]
    f = np.zeros((len(y), len(q)), np.int64)
    for j, p in enumerate(q):
        f[:, j] = quantile(t, p) if levels else round((y.mean() - model.low) / model.step)
    for number in range(1, trees + 1):
        use = B.in_sample(keys, number, share, seed)
        g = sum(np.where(t > f[:, j], round(p * 1000), round(p * 1000) - 1000) for j, p in enumerate(q)) \
            if levels else t - f[:, 0]
        add = np.zeros_like(f)

        def grow(rows, d):
            own = rows[use[rows]]
            best = (0.0, None, None)
            if d < depth and len(own):
                for i in range(bins.shape[1]):
                    for c in range(B.BINS):
                        left = bins[own, i] <= c
                        nl, nr = left.sum(), (~left).sum()
                        if min(nl, nr) < leaf:
                            continue
                        sl, sr = float(g[own][left].sum()), float(g[own][~left].sum())
                        gain = sl ** 2 / nl + sr ** 2 / nr - (sl + sr) ** 2 / (nl + nr)
                        if gain > best[0]:
                            best = (gain, i, c)
            if best[1] is None:
                for j, p in enumerate(q):
                    if len(own):
                        v = quantile(t[own] - f[own, j], p) if levels else g[own].sum() / len(own)
                        add[rows, j] = int(np.rint(rate * v))
                return
            right = bins[rows, best[1]] > best[2]
            grow(rows[~right], d + 1)
            grow(rows[right], d + 1)
        grow(np.arange(len(y)), 0)
        f = f + add
    return f


@pytest.mark.parametrize("levels", [None, [0.1, 0.5, 0.95]])
def test_equal_to_plain_boosting(spark, levels, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 200)
    monkeypatch.setattr(B, "RENEW", 3)
    x, y = data(1, 700)
    df = frame(spark, x, y).repartition(5)
    keys = {r.id: r.k for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    keys = np.array([keys[i] for i in range(len(y))])
    args = dict(trees=7, depth=3, rate=0.3, leaf=15)
    model = B.fit(df, FEATURES, "y", "id", subsample=0.8, levels=levels, **args)
    want = plain(model, x, y, keys, share=0.8, levels=levels, **args)
    assert np.array_equal(model.raw(model.bins(x)), want)
    monkeypatch.setattr(B, "BLOCK", 10_000)
    monkeypatch.setattr(B, "DIRECT", 0)
    again = B.fit(df.repartition(2), FEATURES, "y", "id", subsample=0.8, levels=levels, **args)
    assert np.array_equal(again.raw(again.bins(x)), want)
    got = {r.id: r.prediction for r in B.predict(df, model).collect()}
    v = model.values(x)
    assert all(np.allclose(got[i], v[i] if levels else v[i, 0]) for i in range(len(y)))
    assert abs(model.importances().sum() - 1) < 1e-9


def test_levels_rise_and_beat_a_constant(spark):
    x, y = data(2, 1500)
    df = frame(spark, x, y)
    levels = [i / 20 for i in range(1, 20)]
    model = B.fit(df.filter("id < 1000"), FEATURES, "y", "id", 20, 4, 0.2, 0.8, 20, levels)
    v = model.values(x[1000:])
    assert (np.diff(v, axis=1) >= 0).all()

    def pinball(v):
        e = y[1000:, None] - v
        return np.maximum(np.array(levels) * e, (np.array(levels) - 1) * e).mean()
    assert pinball(v) < 0.8 * pinball(np.quantile(y[:1000], levels)[None, :])


def test_driver_gets_splits_and_quantiles_only(spark, monkeypatch):
    """What a pass returns does not grow with the rows, and the blocks lie in several tasks."""
    monkeypatch.setattr(B, "BLOCK", 100)
    got, tasks, told = [], [], B._Rows.told

    def noted(self, *args):
        out = told(self, *args)
        got.append(len(out))
        tasks.append((self.n_blocks, len(self.kept.df.inputFiles())))
        return out
    monkeypatch.setattr(B._Rows, "told", noted)
    x, y = data(3, 1200)
    B.fit(frame(spark, x, y), FEATURES, "y", "id", 2, 3, 0.1, 0.8, 5, [0.1, 0.5, 0.9])
    assert max(got) <= 8 * 3
    assert {t[0] for t in tasks} == {12} and min(t[1] for t in tasks) >= 4


def test_odd_rows(spark):
    schema = "id long, a double, b double, c double, y double"
    assert not B.fit(spark.createDataFrame([], schema), FEATURES, "y", "id", 3, 2, 0.1, 1.0, 1).trees
    df = spark.createDataFrame([(i, None, float("nan"), 1.0, 4.0 if i % 9 else None) for i in range(60)], schema)
    model = B.fit(df, FEATURES, "y", "id", 3, 2, 0.1, 1.0, 1)
    assert all(abs(r.prediction - 4) < 1e-6 for r in B.predict(df, model).collect())


@pytest.mark.parametrize("grown, direct", [(0, 0), (2, 0), (2, 1), (32, 1), (32, 32)])
@pytest.mark.parametrize("levels", [None, [0.1, 0.5, 0.95]])
def test_equal_wherever_nodes_are_grown(spark, grown, direct, levels, monkeypatch):
    """By passes only, some nodes or all in one task, leaves by level or whole, all rows in one task."""
    monkeypatch.setattr(B, "BLOCK", 100)
    monkeypatch.setattr(B, "RENEW", 2)
    monkeypatch.setattr(B, "GROWN", grown)
    monkeypatch.setattr(B, "DIRECT", direct)
    x, y = data(4, 700)
    df = frame(spark, x, y).repartition(3)
    keys = {r.id: r.k for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    args = dict(trees=3, depth=4, rate=0.3, leaf=9)
    model = B.fit(df, FEATURES, "y", "id", subsample=0.8, levels=levels, **args)
    want = plain(model, x, y, np.array([keys[i] for i in range(len(y))]), share=0.8, levels=levels, **args)
    assert np.array_equal(model.raw(model.bins(x)), want)
    assert len({i for t in model.trees for i in t.feature.tolist()}) == 4 and (model.gains > 0).all()


@pytest.mark.parametrize("direct, most", [(4, 1), (1, 2)])
def test_few_jobs_a_tree(spark, direct, most, monkeypatch):
    """Training is a row of short jobs: a tree of depth 5 is one job, or one for splits and one for leaves."""
    monkeypatch.setattr(B, "BLOCK", 400)
    monkeypatch.setattr(B, "DIRECT", direct)
    x, y = data(5, 1200)
    df = frame(spark, x, y).repartition(3)

    def jobs(trees):
        group = f"trees-{direct}-{trees}"
        spark.sparkContext.setJobGroup(group, "boosting")
        B.fit(df, FEATURES, "y", "id", trees, 5, 0.1, 0.8, 5, [0.1, 0.5, 0.9])
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    few, more = jobs(1), jobs(5)
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert 4 <= more - few <= 4 * most
