"""All decision trees at once against one tree after the other in plain Python."""

import random
from collections import Counter

import numpy as np

from caseloom.operators import boosting, models


def examples(seed):
    r = random.Random(seed)
    out = []
    for dp, n in (("big", 900), ("mid", 160), ("small", 40), ("few", 20), ("one", 90)):
        for i in range(n):
            a, b = r.randrange(6), r.choice([None, r.random(), 2.0])
            y = "x" if dp == "one" else "y" if a > 3 and (b or 0) < 0.6 else r.choice("xxz" if a < 2 else "yz")
            out.append((dp, y, f"c{r.randrange(40)}", i, i, float(a), b))
    return out


def plain(rows, bins, depth, leaf):
    """(node -> (feature, cut), node -> Counter of labels) of one tree."""
    splits, leaves = {}, {}

    def purity(c):
        n = sum(c.values())
        return sum(v * v for v in c.values()) / n if n else 0.0

    def grow(node, at, d):
        have, best = Counter(rows[i][1] for i in at), (0.0, None)
        if d < depth:
            for f in range(bins.shape[1]):
                for c in range(boosting.BINS):
                    left = [i for i in at if bins[i, f] <= c]
                    if len(left) < leaf or len(at) - len(left) < leaf:
                        continue
                    lc = Counter(rows[i][1] for i in left)
                    rise = round(purity(lc) + purity(have - lc) - purity(have), 9)
                    if rise > best[0]:
                        best = (rise, (f, c))
        if best[1] is None:
            leaves[node] = have
            return
        f, c = splits[node] = best[1]
        grow(2 * node + 1, [i for i in at if bins[i, f] <= c], d + 1)
        grow(2 * node + 2, [i for i in at if bins[i, f] > c], d + 1)
    grow(0, list(range(len(rows))), 0)
    return splits, leaves


def test_trees_equal_plain_ones(spark):
    rows = examples(3)
    df = spark.createDataFrame(rows, "dp_key string, label string, case_id string, case_start long, "
                                     "position long, a double, b double").repartition(3)
    splits, leaves, told = models.train_decisions(df, ["a", "b"])
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    train = {k: sorted(v, key=lambda r: (r[3], r[2], r[4]))[:int(len(v) * 0.8)] for k, v in by.items()
             if len(v) >= 30}
    every = spark.createDataFrame([r[5:] for v in train.values() for r in v], "a double, b double")
    edges = boosting.edges(every, ["a", "b"])

    def binned(v):
        return np.array([[0 if x is None else np.searchsorted(e, x) for x, e in zip(r[5:], edges)] for r in v])
    got_splits = {(s.dp_key, s.node): (s.feature, s.cut) for s in splits.collect()}
    got_leaves = {(x.dp_key, x.node): x for x in leaves.collect()}
    want_splits, want_leaves, want = {}, {}, []
    for k, v in train.items():
        if len({r[1] for r in v}) < 2:
            continue
        s, ends = plain(v, binned(v), models.TREE_DEPTH, models.TREE_LEAF)
        want_splits |= {(k, n): x for n, x in s.items()}
        want_leaves |= {(k, n): x for n, x in ends.items()}
        rest = sorted(by[k], key=lambda r: (r[3], r[2], r[4]))[len(v):]
        for r, b in zip(rest, binned(rest)):
            n = 0
            while n in s:
                n = 2 * n + 1 + int(b[s[n][0]] > s[n][1])
            want.append((k, r[1], min(ends[n], key=lambda y: (-ends[n][y], y))))
    assert want_splits and got_splits == want_splits
    assert set(got_leaves) == set(want_leaves)
    for k, c in want_leaves.items():
        assert {x: round(v, 9) for x, v in got_leaves[k].scores.items() if v} == \
            {x: round(v / sum(c.values()), 9) for x, v in c.items()}
    assert sorted((r.dp_key, r.label, r.predicted) for r in told.collect()) == sorted(want)


def test_no_examples(spark):
    df = spark.createDataFrame([], "dp_key string, label string, case_id string, case_start long, "
                                   "position long, a double")
    assert models.train_decisions(df, ["a"])[2].collect() == []
