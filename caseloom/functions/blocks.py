"""Exact all-pairs comparison of short vectors, block against block.

Vectors are split into blocks of bounded size. Each task gets two blocks,
compares them with one matrix product, and emits only what the result needs (the
best few per row, or the distances of a small set). The number of pairs looked at
is what the question asks for; the number of rows shuffled is n x blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BLOCK = 4096


def dense(long: DataFrame, key: str, dim: str, value: str) -> DataFrame:
    """(key, vec): values laid out in label order of the dimensions.

    One key has at most as many entries as there are dimensions (activities).
    """
    names = long.agg(F.sort_array(F.collect_set(dim)).alias("a")).scalar()
    cells = long.groupBy(key).agg(F.map_from_entries(
        F.collect_list(F.struct(F.col(dim), F.col(value).cast("double")))).alias("__m"))
    cells = cells.withColumn("__d", names)
    return cells.select(key, F.transform("__d", lambda d: F.coalesce(
        F.try_element_at("__m", d), F.lit(0.0))).alias("vec"))


def _compare(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        na = np.linalg.norm(a, axis=1, keepdims=True)
        nb = np.linalg.norm(b, axis=1, keepdims=True)
        return (a / np.where(na == 0, 1, na)) @ (b / np.where(nb == 0, 1, nb)).T
    if metric == "euclidean":
        return np.stack([np.sqrt(((row - b) ** 2).sum(axis=1)) for row in a])
    return np.stack([0.5 * np.abs(row - b).sum(axis=1) for row in a])


def pairwise(vectors: DataFrame, key: str, metric: str = "cosine",
             top: int | None = None) -> DataFrame:
    """key, peer, score [, rank]: the ``top`` most similar peers, or every pair (key < peer).

    Scores are rounded to 9 digits, equal scores go by peer name.
    """
    n = max(1, math.ceil(vectors.count() / BLOCK))
    v = vectors.select(F.col(key).cast("string").alias("k"), "vec").withColumn(
        "b", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = v.select("k", "vec", F.col("b").alias("lb"), others.alias("rb"))
    right = v.select(F.col("k").alias("rk"), F.col("vec").alias("rvec"), others.alias("rlb"),
                     F.col("b").alias("rrb"))

    def task(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        out = {"k": [], "peer": [], "score": []}
        if len(lp) and len(rp):
            lk, rk = lp["k"].to_numpy(), rp["rk"].to_numpy()
            order = np.argsort(rk)
            rk = rk[order]
            s = np.round(_compare(np.stack(lp["vec"].to_list()),
                                  np.stack(rp["rvec"].to_list())[order], metric), 9)
            for i, name in enumerate(lk):
                keep = np.flatnonzero(rk != name) if top is not None else np.flatnonzero(rk > name)
                if top is not None and len(keep) > top:
                    keep = keep[np.argsort(-s[i, keep], kind="stable")[:top]]
                out["k"].extend([name] * len(keep))
                out["peer"].extend(rk[keep])
                out["score"].extend(s[i, keep])
        return pd.DataFrame(out)
    pairs = left.groupBy("lb", "rb").cogroup(right.groupBy("rlb", "rrb")).applyInPandas(
        task, "k string, peer string, score double")
    if top is not None:
        w = Window.partitionBy("k").orderBy(F.col("score").desc(), "peer")
        pairs = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return pairs.withColumnRenamed("k", key)
