"""Hard negatives by segment summary filtering, exact.

A vector is cut into segments; of each segment its mean and its deviation (the norm of
what is left without the mean) are kept. With lengths L, means m and deviations d the
inner product of two vectors lies within

    sum over segments of  L * m * m'  -/+  d * d'

so most pairs are dropped on summaries alone: first one segment, then finer ones
(``LEVELS``), and only the rest are multiplied out in integers.

Rows are packed into blocks of about ``BLOCK`` rows by the hash of their id, anchors
likewise; every block of rows meets every block of anchors once, by an equi-join on the
two block numbers, and each meeting returns the best few per anchor. That is the search
of a stated query set against all rows: work grows with anchors times rows, the shuffle
with that divided by ``BLOCK``, a task holds two blocks whatever the input's size, and a
frequent label or vector only means other rows in the same blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.ship import ship
from ..functions.staging import staged
from .base import partitions, query, table
from .texts import arrow_map

BLOCK = 8192            # rows, and anchors, that are compared at a time
TILE = 64               # anchors whose bounds are held at a time
LEVELS = (1, 4, 16)     # segments, coarse to fine
SPARSE = 8              # below 1/SPARSE of a tile, pairs are looked at one by one
PAIRS = 1 << 16         # pairs multiplied out at a time

_PACK = "block int, dim int, ids binary, labels array<string>, vecs binary"


def _pack(t: pa.Table) -> pa.Table:
    """The rows of a block as one packet per vector length, in order of id; of rows that
    repeat an id the first by label and vector."""
    t = t.sort_by([("id", "ascending")])
    best = {}
    for i, label, v in zip(*(t.column(c).to_pylist() for c in ("id", "label", "vec"))):
        if i not in best or (label, v) < best[i]:
            best[i] = (label, v)
    by_dim: dict[int, list] = {}
    for i, (label, v) in best.items():
        by_dim.setdefault(len(v), []).append((i, label, v))
    block, rows = t.column("block")[0].as_py(), sorted(by_dim.items())
    return pa.table({
        "block": pa.array([block] * len(rows), pa.int32()),
        "dim": pa.array([d for d, _ in rows], pa.int32()),
        "ids": pa.array([np.array([r[0] for r in x], np.int64).tobytes() for _, x in rows], pa.binary()),
        "labels": pa.array([[r[1] for r in x] for _, x in rows], pa.list_(pa.string())),
        "vecs": pa.array([np.array([r[2] for r in x], np.int64).tobytes() for _, x in rows], pa.binary())})


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")) \
        .groupBy("block").applyInArrow(_pack, _PACK)


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row and segment: mean times the root of the length, and deviation."""
    n, dim = x.shape
    cuts = np.unique(np.linspace(0, dim, min(segments, max(dim, 1)) + 1).astype(int))[:-1]
    if not dim:
        return np.zeros((n, 0)), np.zeros((n, 0))
    size = np.diff(np.append(cuts, dim))
    total = np.add.reduceat(x, cuts, axis=1)
    mean = total / size
    left = x - np.repeat(mean, size, axis=1)
    return mean * np.sqrt(size), np.sqrt(np.add.reduceat(left * left, cuts, axis=1))


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (row i of a, row j of b)."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        s = slice(at, at + PAIRS)
        out[s] = np.einsum("pk,pk->p", a[i[s]], b[j[s]])
    return out


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity if there are fewer."""
    if x.shape[1] < k:
        return np.full(len(x), -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


class Rows:
    """A block's vectors with their summaries at every level."""

    def __init__(self, ids, labels, vecs, dim):
        self.ids = np.frombuffer(ids, np.int64)
        self.labels = np.array(labels, object)
        self.x = np.frombuffer(vecs, np.int64).reshape(len(self.ids), dim)
        wide = self.x.astype(np.float64)
        self.levels = [summaries(wide, s) for s in LEVELS]
        self.norm = np.sqrt((wide * wide).sum(1))


def survivors(a: Rows, r: Rows, tile: slice, allowed: np.ndarray, useful):
    """Pairs (i, j) of a tile of anchors and the rows that no level of bounds drops.

    ``useful(low, high, live)`` says which live pairs may still be wanted, given
    bounds of their scores.
    """
    slack = 1e-6 + 1e-9 * a.norm[tile, None] * r.norm
    low, high = np.full(allowed.shape, -np.inf), np.full(allowed.shape, np.inf)
    live = allowed
    for at, ((am, ad), (rm, rd)) in enumerate(zip(a.levels, r.levels)):
        if live.sum() * SPARSE < live.size and at:
            break
        middle, spread = am[tile] @ rm.T, ad[tile] @ rd.T + slack
        np.maximum(low, middle - spread, out=low)
        np.minimum(high, middle + spread, out=high)
        live = useful(low, high, live)
    i, j = np.nonzero(live)
    low, high = low[i, j], high[i, j]
    for (am, ad), (rm, rd) in zip(a.levels[at:], r.levels[at:]):
        if not len(i):
            break
        middle = np.einsum("pk,pk->p", am[tile][i], rm[j])
        spread = np.einsum("pk,pk->p", ad[tile][i], rd[j]) + slack[i, j]
        low, high = np.maximum(low, middle - spread), np.minimum(high, middle + spread)
        go = useful(low, high, (i, j))
        i, j, low, high = i[go], j[go], low[go], high[go]
    return i, j


def _same(a: Rows, r: Rows, tile: slice) -> np.ndarray:
    return a.labels[tile, None] == r.labels[None, :]


def _met(keys, packets, out, found):
    """Runs ``found(anchors, rows)`` on every row of joined packets."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                a = Rows(row["a_ids"], row["a_labels"], row["a_vecs"], row["dim"])
                r = Rows(row["ids"], row["labels"], row["vecs"], row["dim"])
                got = found(a, r, row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64())
                     for c in got], names=out)
    return run


def _positives(k: int):
    """Per anchor: its k best rows of the same label."""
    def found(a, r, row):
        out = [[], [], []]
        for at in range(0, len(a.ids), TILE):
            tile = slice(at, at + TILE)
            ids = a.ids[tile]
            allowed = _same(a, r, tile) & (ids[:, None] != r.ids)
            bar = np.full(len(ids), -np.inf)

            def useful(low, high, live):
                if isinstance(live, tuple):
                    return high >= bar[live[0]]
                np.maximum(bar, _kth(np.where(live, low, -np.inf), k), out=bar)
                return live & (high >= bar[:, None])
            i, j = survivors(a, r, tile, allowed, useful)
            s = exact(a.x[tile], r.x, i, j)
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            take = rank < k
            for c, v in zip(out, (ids[i[take]], r.ids[j[take]], s[take])):
                c.append(v)
        return out
    return _met(None, None, ["anchor_id", "positive_id", "positive_score"], found)


def _ceil(n: np.ndarray, d: int) -> np.ndarray:
    return -((-n) // d)


def _negatives(k: int, low_pct: int, high_pct: int):
    """Per anchor and positive: the k best rows of other labels within its window."""
    def found(a, r, row):
        out = [[], [], [], [], []]
        pos = {}
        for x in row["wanted"]:
            pos.setdefault(x["anchor_id"], []).append((x["positive_id"], x["positive_score"]))
        most = max(map(len, pos.values()), default=0)
        for at in range(0, len(a.ids), TILE):
            tile = slice(at, at + TILE)
            ids = a.ids[tile]
            score = np.zeros((len(ids), most), np.int64)
            pid, there = np.zeros_like(score), np.zeros(score.shape, bool)
            for x, anchor in enumerate(ids.tolist()):
                for y, (p, v) in enumerate(pos.get(anchor, ())):
                    pid[x, y], score[x, y], there[x, y] = p, v, True
            lows = _ceil(low_pct * score, 100)
            highs = np.where(there, high_pct * score // 100, lows - 1)
            bars = np.where(there, lows, np.inf).astype(float)

            def useful(low, high, live):
                if isinstance(live, tuple):
                    i = live[0]
                    return ((high[:, None] >= bars[i]) & (low[:, None] <= highs[i])).any(1)
                any_use = np.zeros_like(live)
                for y in range(most):
                    sure = live & (low >= lows[:, y, None]) & (high <= highs[:, y, None])
                    np.maximum(bars[:, y], _kth(np.where(sure, low, -np.inf), k), out=bars[:, y])
                    any_use |= (high >= bars[:, y, None]) & (low <= highs[:, y, None])
                return live & any_use
            i, j = survivors(a, r, tile, ~_same(a, r, tile), useful)
            s = exact(a.x[tile], r.x, i, j)
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            for y in range(most):
                fit = np.flatnonzero((s >= lows[i, y]) & (s <= highs[i, y]))
                of = i[fit]
                fit = fit[np.arange(len(of)) - np.searchsorted(of, of) < k]
                of = i[fit]
                for c, v in zip(out, (ids[of], pid[of, y], r.ids[j[fit]], score[of, y], s[fit])):
                    c.append(v)
        return out
    return _met(None, None, ["anchor_id", "positive_id", "negative_id", "positive_score",
                             "negative_score"], found)


def mine(rows: DataFrame, vec_id: str, vector: str, label: str, anchor: Column,
         positives: int = 5, negatives: int = 10, low_pct: int = 30, high_pct: int = 90,
         block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vector`` is an array of whole numbers whose products sum up within 64 bits; a score
    is the inner product with the anchor. An anchor's positives are its ``positives`` best
    other rows of the same label, higher scores first, equal ones by smaller id. Of the
    rows with another label whose score is ``low_pct`` to ``high_pct`` per cent of the
    positive's, the first ``negatives`` are returned for each anchor and positive.

    ``anchor`` is a condition on ``rows``. Rows with a null id, label, vector or component
    take no part; vectors of different lengths do not meet. Of rows that repeat an id one
    takes part, the first by label (as text) and vector; it is an anchor if any of them
    is. An anchor without positives or negatives has no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    v = F.col(vector)
    good = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                       v.cast("array<bigint>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor")) \
        .filter("id is not null and label is not null and vec is not null "
                "and not exists(vec, x -> x is null)")
    total, asked = good.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    many, few = (max(1, math.ceil(n / block)) for n in (total, asked))
    packets = staged(_packed(good, many))
    # an anchor is the row its id stands for, so all rows of an anchor's id are packed
    ids = good.filter("anchor").select("id").distinct()
    anchors = staged(_packed(good.join(ids, "id", "left_semi"), few).select(
        F.col("block").alias("a_block"), "dim", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "vecs")]))
    tasks = min(many * few, 4 * partitions(spark))
    left = packets.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(few - 1)))) \
        .repartition(tasks, "dim", "block", "a_block")

    def pairs(asking):
        right = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))) \
            .repartition(tasks, "dim", "block", "a_block")
        return left.join(right, ["dim", "block", "a_block"])

    by_score = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    best = arrow_map(pairs(anchors), _positives(positives),
                     "anchor_id bigint, positive_id bigint, positive_score bigint")
    best = staged(best.withColumn("r", F.row_number().over(by_score))
                  .filter(F.col("r") <= positives).drop("r"))
    wanted = best.withColumn("a_block", F.pmod(F.xxhash64("anchor_id"), F.lit(few)).cast("int")) \
        .groupBy("a_block").agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score"))
                                .alias("wanted"))
    found = arrow_map(pairs(anchors.join(wanted, "a_block")), _negatives(negatives, low_pct, high_pct),
                      "anchor_id bigint, positive_id bigint, negative_id bigint, "
                      "positive_score bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(
        F.col("negative_score").desc(), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query("op12_hard_negatives", """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v,
    case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label from embeddings
    where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint as s
    from v a join v b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0),
p as (select a, b, s from s where same
    qualify row_number() over (partition by a order by s desc, b) <= 5)
select p.a as anchor_id, p.b as positive_id,
    row_number() over (partition by p.a, p.b order by s.s desc, s.b)::int as rank,
    s.b as negative_id, p.s as positive_score, s.s as negative_score
from p join s on s.a = p.a and not s.same and 30 * p.s <= 100 * s.s and 100 * s.s <= 90 * p.s
qualify rank <= 10""")
def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Negatives of every hundredth vector; every seventh has its label shifted first."""
    e = table(spark, d, "embeddings")
    ok = F.expr("not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = e.select("vec_id", F.when(ok, whole).alias("v"), shifted.alias("label"))
    return mine(rows, "vec_id", "v", "label", F.col("vec_id") % 100 == 0)
