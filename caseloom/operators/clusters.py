"""Clusterings of profile vectors: hierarchical, overlapping, spherical.

Vectors come as (key, vec) with one entry per dimension, as ``functions.blocks.dense``
makes them. All starts are deterministic, and ties go by key, so that a result does not
depend on how the rows are partitioned. What reaches the driver is a merge per vector of
the hierarchy's rounds or the centres: as many as clusters, never vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import pairwise
from ..functions.ship import ship
from ..functions.staging import Kept, staged

# how the distance of two clusters follows from those of their members
LINKAGE = {"complete": lambda: F.max("d"), "single": lambda: F.min("d"),
           "average": lambda: F.sum(F.col("d") * F.col("n")) / F.sum("n")}


def _small(spark, pairs: dict, a: str, b: str, kind: pa.DataType) -> DataFrame:
    """Names and values from the driver, as Arrow: no Python worker makes the rows."""
    return spark.createDataFrame(pa.table({a: pa.array(list(pairs), pa.string()),
                                           b: pa.array(list(pairs.values()), kind)}))


def hierarchical(vectors: DataFrame, k: int, key: str = "resource", linkage: str = "complete") -> DataFrame:
    """grp, key: ``k`` disjoint groups by merging the nearest ones (Euclidean distance).

    Clusters that are each other's nearest merge in the same round; for these linkages
    the tree is that of merging one pair at a time. A cluster is called after its first
    member; equal distances go by name. Rounds end once the merges below the cut are
    known. Groups are numbered from 0 by the name of their first member. Fewer than ``k``
    vectors make a group each. The distances, rounded to 9 digits, are kept for all pairs of
    the vectors given, such as the staff of a log, not of its events.
    """
    spark = vectors.sparkSession
    names = staged(vectors.select(F.col(key).cast("string").alias("key")).distinct())
    wanted = names.count() - k
    pairs = Kept(pairwise(vectors, key, "euclidean").select(
        F.col(key).alias("a"), F.col("peer").alias("b"), F.col("score").alias("d"), F.lit(1).alias("n")))
    merges, number = [], 0      # (height, round, stays, goes): one per vector at most
    while True:
        ends = pairs.df.select("a", "b", "d").union(pairs.df.select(F.col("b"), F.col("a"), "d"))
        first = ends.groupBy("a").agg(F.min(F.struct(
            "d", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))).alias("m")).select("m.*")
        # the nearest two of all are always among them
        joined = first.groupBy("d", "x", "y").agg(F.count(F.lit(1)).alias("c")).filter("c = 2").collect()
        low = min((r.d for r in joined), default=None)
        if low is None or sum(m[0] < low for m in merges) >= wanted:
            break
        number += 1
        merges += [(r.d, number, r.x, r.y) for r in joined]
        goes = _small(spark, {r.y: r.x for r in joined}, "was", "now", pa.string())
        moved = pairs.df.join(goes.withColumnsRenamed({"was": "a", "now": "na"}), "a", "left") \
            .join(goes.withColumnsRenamed({"was": "b", "now": "nb"}), "b", "left") \
            .withColumns({"x": F.coalesce("na", "a"), "y": F.coalesce("nb", "b")}).filter("x <> y")
        pairs.write(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
            LINKAGE[linkage]().alias("d"), F.sum("n").cast("int").alias("n")))
    pairs.drop()
    up = {y: x for _, _, x, y in sorted(merges)[:max(wanted, 0)]}

    def root(x):
        while x in up:
            x = up[x]
        return x
    moved = _small(spark, {x: root(x) for x in up}, "key", "first", pa.string())
    told = names.join(F.broadcast(moved), "key", "left").withColumn("first", F.coalesce("first", "key"))
    order = staged(told.select("first").distinct())     # k rows
    rank = {r["first"]: i for i, r in enumerate(order.orderBy("first").collect())}
    number = _small(spark, rank, "first", "grp", pa.int32())
    return told.join(F.broadcast(number), "first").select("grp", F.col("key").alias(key))


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def _batches(batches):
    for b in batches:
        if b.num_rows:
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float)
            yield b.column("key"), x.reshape(b.num_rows, -1), b.column("weight").to_numpy().astype(float)


def _gap(x: np.ndarray, centres: np.ndarray, spherical: bool) -> np.ndarray:
    """Distance of each row to each centre: squared Euclidean, or 1 - cosine."""
    if spherical:
        return np.maximum(1 - _unit(x) @ _unit(centres).T, 0)
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def farthest(v: DataFrame, first: list[np.ndarray], k: int, spherical: bool) -> list[np.ndarray]:
    """For each restart: its first vector, then one by one the vector farthest from those
    chosen; ties by key. Fewer if there are no more distinct ones."""
    chosen = [[x] for x in first]
    for _ in range(k - 1):
        centres = [np.array(c) for c in chosen]

        def run(batches):
            best = {}
            for keys, x, _w in _batches(batches):
                for r, c in enumerate(centres):
                    d = np.round(_gap(x, c, spherical).min(1), 9)
                    for i in np.flatnonzero(d == d.max()):
                        cand = (-d[i], keys[i].as_py())
                        if r not in best or cand < best[r][0]:
                            best[r] = (cand, x[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(best), pa.int32()), pa.array([b[0][0] for b in best.values()], pa.float64()),
                 pa.array([b[0][1] for b in best.values()], pa.string()),
                 pa.array([b[1].tolist() for b in best.values()], pa.list_(pa.float64()))],
                names=["r", "d", "key", "vec"])
        got = v.mapInArrow(run, "r int, d double, key string, vec array<double>").groupBy("r").agg(
            F.min(F.struct("d", "key", "vec")).alias("m")).collect()
        for row in got:
            if row.m.d < 0:
                chosen[row.r].append(np.array(row.m.vec))
    return [np.array(c) for c in chosen]


def _memberships(x, centres, spherical):
    """Shares of each row in the clusters: 0 and 1, or by inverse squared distance."""
    d = _gap(x, centres, spherical)
    if spherical:
        u = np.zeros_like(d)
        u[np.arange(len(x)), np.round(d, 9).argmin(1)] = 1
        return u, d
    near = d <= 1e-12
    with np.errstate(divide="ignore"):
        inverse = 1 / np.where(near, 1, d)
    u = np.where(near.any(1, keepdims=True), near, inverse)
    return u / u.sum(1, keepdims=True), d


def _moved(v: DataFrame, centres: list[np.ndarray], spherical: bool):
    """(new centres, objective) of every restart, in one pass over the vectors."""
    def run(batches):
        sums = [np.zeros_like(c) for c in centres]
        sizes, cost = [np.zeros(len(c)) for c in centres], [0.0] * len(centres)
        for _keys, x, w in _batches(batches):
            for r, c in enumerate(centres):
                u, d = _memberships(x, c, spherical)
                u = u ** 2 * w[:, None]
                sums[r] += u.T @ (_unit(x) if spherical else x)
                sizes[r] += u.sum(0)
                cost[r] += float((u * d).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(centres)), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary()),
             pa.array([s.tobytes() for s in sizes], pa.binary()), pa.array(cost)],
            names=["r", "sums", "sizes", "cost"])
    sums, sizes, cost = [np.zeros_like(c) for c in centres], [np.zeros(len(c)) for c in centres], [0.0] * len(centres)
    for row in v.mapInArrow(run, "r int, sums binary, sizes binary, cost double").collect():
        sums[row.r] += np.frombuffer(row.sums).reshape(sums[row.r].shape)
        sizes[row.r] += np.frombuffer(row.sizes)
        cost[row.r] += row.cost
    new = []
    for c, s, n in zip(centres, sums, sizes):
        at = np.where(n[:, None] > 0, s / np.where(n > 0, n, 1)[:, None], c)
        new.append(np.round(_unit(at) if spherical else at, 9))
    return new, cost


def _settle(v, centres, spherical, rounds):
    """Centres of the restart with the least objective, after they have stopped moving."""
    for _ in range(rounds):
        new, cost = _moved(v, centres, spherical)
        still = all(np.array_equal(a, b) for a, b in zip(new, centres))
        centres = new
        if still:
            break
    _, cost = _moved(v, centres, spherical)
    return centres[int(np.argmin(np.round(cost, 9)))]


def _prepared(vectors: DataFrame, key: str, weight: str | None) -> DataFrame:
    ship(vectors.sparkSession)
    return staged(vectors.select(F.col(key).cast("string").alias("key"), "vec",
                                 (F.col(weight) if weight else F.lit(1)).cast("double").alias("weight")))


def _heaviest(v: DataFrame, n: int) -> list[np.ndarray]:
    return [np.array(r.vec, float) for r in v.orderBy(F.col("weight").desc(), "key").limit(n).collect()]


def spherical(vectors: DataFrame, k: int, key: str, weight: str | None = None, rounds: int = 50) -> DataFrame:
    """key, cluster: k-means by cosine, of vectors that stand for ``weight`` rows each.

    It starts from the heaviest vector and then the farthest ones. Clusters are numbered
    in that order; equal cosines go to the lower number. A zero vector is as far from
    every centre as can be and falls to cluster 0. Fewer distinct directions than ``k`` make
    fewer clusters.
    """
    v = _prepared(vectors, key, weight)
    turned = v.filter(F.exists("vec", lambda x: x != 0))
    first = _heaviest(turned, 1)
    if not first:
        return v.select(F.col("key").alias(key), F.lit(0).alias("cluster"))
    centres = _settle(v, farthest(turned, first, k, True), True, rounds)

    def run(batches):
        for keys, x, _w in _batches(batches):
            u, _ = _memberships(x, centres, True)
            yield pa.RecordBatch.from_arrays([keys, pa.array(u.argmax(1), pa.int32())],
                                             names=[key, "cluster"])
    return v.mapInArrow(run, f"`{key}` string, cluster int")


def overlapping(vectors: DataFrame, k: int, key: str = "resource", restarts: int = 3, share: float | None = None,
                rounds: int = 50) -> DataFrame:
    """grp, key, share: groups that may overlap, by fuzzy c-means (squared memberships).

    A member's shares sum up to 1; it belongs to every group in which it has at least
    ``share`` (by default 1.5 / k), and to the one of its largest share. All restarts run
    together, each from another vector and then the farthest ones; the one with the
    least objective counts.
    """
    v = _prepared(vectors, key, None)
    first = _heaviest(v, restarts)
    if not first:
        return v.select(F.lit(0).alias("grp"), F.col("key").alias(key), F.lit(1.0).alias("share"))
    centres = _settle(v, farthest(v, first, k, False), False, rounds)
    least = 1.5 / k if share is None else share

    def run(batches):
        for keys, x, _w in _batches(batches):
            u = np.round(_memberships(x, centres, False)[0], 9)
            i, g = np.nonzero((u >= least) | (np.arange(u.shape[1]) == u.argmax(1)[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g, pa.int32()), keys.take(pa.array(i)), pa.array(u[i, g])],
                names=["grp", key, "share"])
    return v.mapInArrow(run, f"grp int, `{key}` string, share double")
