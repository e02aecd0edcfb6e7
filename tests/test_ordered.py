"""The block-wise path against plain windows, and how even its blocks are."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from caseloom.functions import ordered as O
from caseloom.functions.quantiles import quantiles


def _rows(seed=1):
    r = random.Random(seed)
    out, i = [], 0
    for k, n in (("a", 300), ("b", 4), (None, 40), ("c", 1), ("d", 60)):
        for _ in range(n):
            i += 1
            out.append((k, r.randrange(0, 50), i, r.choice([None, 1, 2, 3, -4])))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("least", [O.LEAST, 16])
@pytest.mark.parametrize("keys", [["k"], []])
def test_blocks_give_the_rows_of_plain_windows(spark, keys, least, monkeypatch):
    monkeypatch.setattr(O, "LEAST", least)
    df = spark.createDataFrame(_rows(), "k string, t long, i long, v long")
    got = O.along(df, keys, ["t", "i"], dict(
        pos=O.nth(), nxt=O.following("v"), prv=O.preceding("v"), tot=O.total_upto("v"),
        bef=O.total_before("v"), last=O.latest_upto("v"), lastb=O.latest_before("v"),
        low=O.lowest_upto("v"), lowb=O.lowest_before("v"), high=O.highest_upto("v")))
    w = Window.partitionBy(*keys).orderBy("t", "i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*", (F.row_number().over(w) - 1).alias("pos"), F.lead("v").over(w).alias("nxt"),
        F.lag("v").over(w).alias("prv"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("tot"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("bef"),
        F.last("v", True).over(upto).alias("last"), F.last("v", True).over(before).alias("lastb"),
        F.min("v").over(upto).alias("low"), F.min("v").over(before).alias("lowb"),
        F.max("v").over(upto).alias("high"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=lambda t: t[2]) == \
        sorted(map(tuple, want.collect()), key=lambda t: t[2])


@pytest.mark.parametrize("name, first", [
    ("ties", "timestamp'2024-01-01'"),
    ("outlier", "timestamp'2024-01-01' + make_interval(0, 0, 0, if(id = 7, 9999, 0), 0, 0, id % 3600)"),
    ("prefixes", "concat('User_', lpad(id, 8, '0'))")])
def test_no_block_is_twice_the_mean(spark, name, first):
    df = spark.range(100_000).select(F.lit("c").alias("k"), F.expr(first).alias("t"), "id")
    sizes = [r["count"] for r in O.in_blocks(df, ["k"], ["t", "id"]).groupBy("__b").count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 100_000 and max(sizes) <= 2 * 25_000


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_are_exact(spark, keys):
    df = spark.createDataFrame(_rows(3), "k string, t long, i long, v long") \
        .withColumn("x", F.exp(F.col("t") / 5.0) - 3)
    got = quantiles(df, keys, "x", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()
    want = df.groupBy(*keys).agg(*[F.expr(f"percentile(x, {p})") for p in (0.1, 0.5, 0.99)]).collect()
    tidy = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r)       # noqa: E731
                                for r in rows), key=str)
    assert tidy(got) == tidy(want)


def test_quantiles_round_as_the_sql_does(spark):
    import duckdb
    r = random.Random(5)
    hour = lambda: r.randint(0, 23) + r.randint(0, 59) / 60.0 + r.randint(0, 59) / 3600.0     # noqa: E731
    data = []
    for g in range(2000):
        same, n = hour(), r.randint(2, 6)
        data += [(g, same if g % 2 else hour()) for _ in range(n)]
    pdf = pd.DataFrame(data, columns=["g", "x"])
    want = duckdb.sql("""select g, quantile_cont(x, 0.1), quantile_cont(x, 0.9), median(x) from pdf group by 1""")
    got = quantiles(spark.createDataFrame(pdf), ["g"], "x", {"lo": 0.1, "hi": 0.9, "m": 0.5})
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    one = quantiles(spark.createDataFrame([(float("inf"),)] * 2 + [(1.0,)] * 2, "x double"), [], "x",
                    {"lo": 0.1, "mid": 0.5, "hi": 0.9}).collect()
    assert [tuple(x) for x in one] == [(1.0, float("inf"), float("inf"))]


def test_only_crowded_keys_are_cut(spark, monkeypatch):
    monkeypatch.setattr(O, "LEAST", 16)
    df = spark.createDataFrame(_rows(), "k string, t long, i long, v long")
    large, blocks = O.crowded(df, ["k"])
    assert [r.k for r in large.collect()] == ["a"] and blocks == 3      # 300 of 405 rows, 4 partitions
    assert O.crowded(df.filter("k <> 'a' or t < 3"), ["k"]) is None or \
        {r.k for r in O.crowded(df.filter("k <> 'a' or t < 3"), ["k"])[0].collect()} == {"d"}
    assert O.crowded(df.limit(0), ["k"]) is None and O.crowded(df.limit(0), []) is None


def test_passes_over_one_order_share_one_shuffle(spark):
    df = spark.createDataFrame(_rows(), "k string, t long, i long, v long")
    out = O.by_part(df, ["k"], lambda d, run: run(
        run(d, ["t", "i"], {"p": O.nth()}), ["t", "i"], {"q": O.latest_before("p")}))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
