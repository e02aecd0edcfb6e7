"""Hard negatives against brute force."""

import numpy as np
from pyspark.sql import functions as F

from caseloom.llm import negatives


def brute(rows, k=5, m=10):
    """rows: id -> (label, vector)."""
    out = []
    for a, (label, v) in rows.items():
        if a % 10:
            continue
        s = {b: int(np.dot(v, w)) for b, (_, w) in rows.items() if b != a and len(w) == len(v)}
        first = sorted(s, key=lambda b: (-s[b], b))
        pos = [b for b in first if rows[b][0] == label][:k]
        for p in pos:
            neg = [b for b in first if rows[b][0] != label and 30 * s[p] <= 100 * s[b] <= 90 * s[p]]
            out += [(a, p, r + 1, b, s[p], s[b]) for r, b in enumerate(neg[:m])]
    return sorted(out)


def mined(spark, rows, block):
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, label string, rank string")
    got = negatives.mine(df, "vec_id", "v", "label", F.col("vec_id") % 10 == 0, block=block)
    return sorted(map(tuple, got.collect()))


def test_blocks_ties_and_odd_rows(spark):
    r = np.random.default_rng(3)
    centres = r.normal(0, 60, (6, 32))
    rows = {i: ("hot" if i % 3 == 0 else f"l{i % 7}",
                [int(x) for x in centres[i % 6] + r.normal(0, 40, 32)]) for i in range(400)}
    for i in range(400, 480):       # many equal vectors
        rows[i] = (f"l{i % 2}", [3] * 32)
    rows[480] = ("l1", [0] * 32)
    rows[481] = ("l1", [1, 2])
    rows[490] = ("l1", [2, 1])
    rows[491] = ("l2", [1, 1])
    rows[500] = ("alone", [5] * 32)
    given = [(i, v, label, "x") for i, (label, v) in rows.items()]
    given += [(20, [9] * 32, "zz", "x"), (None, [1] * 32, "l1", "x"), (600, None, "l1", "x"),
              (601, [1] * 31 + [None], "l1", "x"), (610, [1] * 32, None, "x")]
    given += given[:40]             # repeated rows
    want = brute(rows)
    assert want
    assert mined(spark, given, 100) == want
    assert mined(spark, given, 5000) == want


def test_empty(spark):
    assert mined(spark, [], 100) == []
    assert mined(spark, [(10, [1, 2], "a", "x")], 100) == []


def test_bounds_hold():
    r = np.random.default_rng(4)
    x, y = r.integers(-500, 500, (50, 37)), r.integers(-500, 500, (60, 37))
    score = x @ y.T
    width = []
    for s in negatives.LEVELS:
        (xm, xd), (ym, yd) = negatives.summaries(x.astype(float), s), negatives.summaries(y.astype(float), s)
        assert (np.abs(score - xm @ ym.T) <= xd @ yd.T + 1e-6).all()
        width.append((xd @ yd.T).mean())
    assert width == sorted(width, reverse=True)
