"""Exact dedup against brute force."""

import hashlib
import random

from pyspark.sql import functions as F

from caseloom.llm import exact

SCHEMA = "doc_id long, text string, kept string, content string"


def corpus():
    r = random.Random(5)
    rows = [(i, r.choice(["a", "b", "", None, "long " * 4000, "é\n", "é\n "]) if i % 2 else f"t{i % 61}",
             "x", "y") for i in range(400)]
    rows += [(1000 + i, "hot text", "x", "y") for i in range(300)]
    rows += [(7, "a", "x", "y"), (7, "a", "x", "y"), (None, "a", "x", "y"), (None, "nobody", "x", "y")]
    return rows


def brute(rows, normalise=lambda t: t):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(normalise(t or ""), []).append(i)
    out = []
    for i, t, *_ in rows:
        t = normalise(t or "")
        keep = max((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
                      .collect()), key=str)


def test_decisions(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert told(exact.decide(df)) == brute(rows)


def test_equal_digests_do_not_join_texts(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    weak = exact.decide(df, digest=lambda t: F.length(t) % 3)
    assert told(weak) == brute(rows)


def test_normalised(spark):
    rows = [(1, "A b"), (2, "a  B"), (3, "ab"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact.decide(df, normalise=lambda t: F.regexp_replace(F.lower(t), r"\s+", " "))
    assert told(got) == brute(rows, lambda t: " ".join(t.lower().split()))


def test_clashing_names_and_distinct(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact.decide(df, keep=("doc_id", "kept", "content"))
    assert got.columns == ["doc_id", "kept", "content", "keep_id", "group_size", "_kept", "text_sha256"]
    one = exact.distinct(df)
    assert one.columns == df.columns
    texts = [t or "" for _, t, *_ in one.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in rows})


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact.decide(df).collect() == []
    assert exact.distinct(df).collect() == []
