"""Gradient boosting on binned features: squared loss, or many quantile levels at once.

Features are cut into at most ``BINS`` bins once. The training rows are packed into
blocks of bounded size (bins as bytes, targets and predictions as whole numbers on a
fixed grid), written to the shared folder and read through a persisted RDD, since training
is a long row of short jobs. A node of more than ``GROWN`` blocks' rows is split in a pass
over the blocks: sums and counts per (node, feature, bin) are added up node by node in
tasks, and the driver gets its best split. Bins and gradients of a smaller node meet in one
task, which grows all that is below it; the nodes are dealt out over the tasks. The sums
are exact, so that the model does not depend on how the rows are partitioned or where a
node is grown. Every ``RENEW`` trees the predictions are written anew; between, passes add
the latest trees.

With ``levels`` the trees are grown on the summed gradients of the pinball losses, so all
levels share one set of splits, and each leaf is refitted per level to the exact quantile
of the residuals in it. They meet by leaf, or by leaf and level; those of a leaf of more
than ``GROWN`` blocks' rows are counted by their upper bits, then by the next ones.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..functions.staging import Kept

BINS = 64
BLOCK = 1 << 14         # rows packed together
RENEW = 10              # trees between two versions of the predictions
GROWN = 32              # a node of at most so many blocks' rows is grown in one task, on bins and gradients
DIRECT = 4              # at most so many blocks' rows meet with the residuals of all levels, in one task
FILES = 2               # files of blocks per core, at most
BITS = 26               # bits of a residual
DIGIT = 13              # of these one pass tells apart
SPAN = 1 << (BITS - 2)  # grid steps between the least and the largest target

_PACK = "block int, bins binary, y binary, f binary, key binary"


@dataclass
class Tree:
    """Nodes by heap number; ``feature`` is -1 at leaves, rows with bin > cut go right."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray       # grid steps, one column per level

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[node]
            go = f >= 0
            if not go.any():
                return node
            right = bins[rows, np.maximum(f, 0)] > self.cut[node]
            node = np.where(go, 2 * node + 1 + right, node)


@dataclass
class Boosted:
    """A fitted model; its size depends on trees and levels only."""
    features: list[str]
    edges: list[np.ndarray]
    levels: list[float] | None
    low: float              # value of grid step 0
    step: float
    trees: list[Tree] = field(default_factory=list)
    gains: np.ndarray | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers; a missing value counts as the least."""
        out = np.zeros(x.shape, np.uint8)
        for i, e in enumerate(self.edges):
            out[:, i] = np.searchsorted(e, np.where(np.isnan(x[:, i]), -np.inf, x[:, i]), side="left")
        return out

    def raw(self, bins: np.ndarray) -> np.ndarray:
        total = np.zeros((len(bins), len(self.levels or [0])), np.int64)
        for t in self.trees:
            total += t.value[t.leaves(bins)]
        return total

    def values(self, x: np.ndarray) -> np.ndarray:
        """Predictions; with levels one column each, made non-decreasing."""
        out = self.low + self.raw(self.bins(x)) * self.step
        return np.maximum.accumulate(out, axis=1)

    def importances(self) -> np.ndarray:
        """Share of the whole gain per feature."""
        s = self.gains.sum()
        return self.gains / s if s > 0 else self.gains


def _mix(h: np.ndarray) -> np.ndarray:
    u = np.uint64
    h = (h ^ (h >> u(33))) * u(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> u(33))) * u(0xC4CEB9FE1A85EC53)
    return h ^ (h >> u(33))


def in_sample(key: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree is grown on: by a hash of row key, tree and seed."""
    h = _mix(key.view(np.uint64) + np.uint64((seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return h < np.uint64(min(int(share * 2.0 ** 64), (1 << 64) - 1))


def gradient(r: np.ndarray, weights) -> np.ndarray:
    """What a tree is grown on, in whole numbers: residuals, or summed pinball gradients."""
    if weights is None:
        return r[:, 0]
    return 1000 * (r > 0).sum(1) + int((weights - 1000).sum())


def sums(bins: np.ndarray, g: np.ndarray, node: np.ndarray, count: int) -> np.ndarray:
    """Sums of ``g`` and counts of rows by (node, which of the two, feature, bin)."""
    width = bins.shape[1]
    cell = ((node[:, None] * width + np.arange(width)) * BINS + bins).ravel()
    out = np.empty((count, 2, width, BINS), np.int64)
    # whole numbers well below 2 ** 53: exact as doubles, too
    out[:, 0] = np.bincount(cell, np.repeat(g, width), out[:, 0].size).reshape(out[:, 0].shape)
    out[:, 1] = np.bincount(cell, minlength=out[:, 1].size).reshape(out[:, 1].shape)
    return out


def best_splits(total: np.ndarray, n: np.ndarray, leaf: int):
    """Per node: (gain, feature, cut) of the best split, gain 0 if there is none.

    ``total`` and ``n`` are sums and counts by (node, feature, bin). Of equal gains the
    first feature and cut wins.
    """
    left_s, left_n = total.cumsum(2).astype(float), n.cumsum(2).astype(float)
    all_s, all_n = left_s[:, :1, -1:], left_n[:, :1, -1:]
    right_s, right_n = all_s - left_s, all_n - left_n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s ** 2 / left_n + right_s ** 2 / right_n - all_s ** 2 / all_n
    gain = np.where((left_n >= leaf) & (right_n >= leaf), gain, 0.0).reshape(len(total), -1)
    at = gain.argmax(1)
    return gain[np.arange(len(at)), at], at // total.shape[2], at % total.shape[2]


def rank(level: float, n: int) -> int:
    """Which of n values in order is their quantile, from 1."""
    return max(1, math.ceil(level * n - 1e-9))


def grown(bins: np.ndarray, g: np.ndarray, depth: int, leaf: int, rate: float, mean: bool):
    """A tree of rows in memory, the gain of each of its splits by heap number, and where the rows end.

    Its values are set for the mean only.
    """
    size = (1 << (depth + 1)) - 1
    t, gains, node = _empty(size, 1), np.zeros(size), np.zeros(len(g), np.int64)
    if mean:
        t.value[0] = _mean(g.sum(), len(g), rate)
    for d in range(depth):
        first, count = (1 << d) - 1, 1 << d
        here = np.flatnonzero(node >= first)
        total = sums(bins[here], g[here], node[here] - first, count)
        for i, (gain, feature, cut) in enumerate(zip(*best_splits(total[:, 0], total[:, 1], leaf))):
            if gain > 0:
                at = first + i
                t.feature[at], t.cut[at], gains[at] = feature, cut, gain
                if mean:
                    own = total[i, :, feature]
                    t.value[2 * at + 1:2 * at + 3, 0] = _means(*own[:, :cut + 1].sum(1), *own.sum(1), rate)
        at = node[here]
        f = t.feature[at]
        node[here] = np.where(f >= 0, 2 * at + 1 + (bins[here, np.maximum(f, 0)] > t.cut[at]), at)
        if not (f >= 0).any():
            break
    return t, gains, node


def quantiles(r: np.ndarray, levels: Sequence[float]) -> np.ndarray:
    """Quantile of each row of ``r``, by its level: the value of rank ceil(level * n)."""
    return np.sort(r, axis=1)[np.arange(len(levels)), [rank(q, r.shape[1]) - 1 for q in levels]]


def _empty(size: int, k: int) -> Tree:
    return Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros((size, k), np.int64))


def _by_key(items):
    got = defaultdict(list)
    for key, x in items:
        got[key].append(x)
    return got.items()


def _parts(node: np.ndarray):
    """(node, its rows) of all nodes with rows."""
    order = np.argsort(node, kind="stable")
    cuts = np.flatnonzero(np.diff(node[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(node[part[0]]), part


def _blocks(packed, width: int, levels: int):
    """(bins, y, f, key) of each block."""
    for bins, y, f, key in packed:
        bins = np.frombuffer(bins, np.uint8).reshape(-1, width)
        yield (bins, np.frombuffer(y, np.int64), np.frombuffer(f, np.int64).reshape(len(bins), levels),
               np.frombuffer(key, np.int64))


def _latest(bins: np.ndarray, f: np.ndarray, pending: list) -> np.ndarray:
    """``f`` with the pending trees added."""
    for t in pending:
        f = f + t.value[t.leaves(bins)]
    return f


class _Rows:
    """The packed training rows and the passes over them."""

    def __init__(self, df: DataFrame, model: Boosted, y: str, key: str, share: float, seed: int):
        width, edges_of = len(model.features), model.bins
        self.width, self.levels, self.share, self.seed = width, len(model.levels or [0]), share, seed
        self.many = bool(model.levels)
        self.n, self.small, self.few = df.count(), GROWN * BLOCK, DIRECT * BLOCK
        self.n_blocks = max(1, math.ceil(self.n / BLOCK))
        self.direct = self.n_blocks <= min(DIRECT, GROWN)
        self.tasks = df.sparkSession.sparkContext.defaultParallelism
        low, step, levels = model.low, model.step, self.levels

        def pack(t: pa.Table) -> pa.Table:
            t = t.sort_by([("key", "ascending"), ("y", "ascending")])
            x = np.array(t.column("x").to_pylist(), float).reshape(t.num_rows, width)
            target = np.rint((t.column("y").to_numpy() - low) / step).astype(np.int64)
            return pa.table({
                "block": pa.array([t.column("block")[0].as_py()], pa.int32()),
                "bins": pa.array([edges_of(x).tobytes()], pa.binary()),
                "y": pa.array([target.tobytes()], pa.binary()),
                "f": pa.array([np.zeros((t.num_rows, levels), np.int64).tobytes()], pa.binary()),
                "key": pa.array([t.column("key").to_numpy().tobytes()], pa.binary())})
        rows = df.select(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
                                   for c in model.features]).alias("x"),
                         F.col(y).cast("double").alias("y"), F.xxhash64(key).alias("key"))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(self.n_blocks)).cast("int"))
        if self.n_blocks > 1:
            # a file, and so a task, for every few blocks: small ones would be read by one task
            rows = rows.repartitionByRange(min(self.n_blocks, FILES * self.tasks), "block")
        self.kept = Kept(rows.groupBy("block").applyInArrow(pack, _PACK))
        self.pending: list[Tree] = []
        self.read()

    def read(self):
        packed = self.kept.df.select("bins", "y", "f", "key").rdd.map(tuple)
        self.blocks = (packed.coalesce(1) if self.direct else packed).persist(StorageLevel.MEMORY_AND_DISK)

    def draw(self, number: int, weights):
        """What passes read: ``drawn``, bins and residuals of the rows that tree ``number`` is grown on
        (0: all), and ``light``, their bins and what it is grown on."""
        width, k, many, share, seed = self.width, self.levels, self.many, self.share, self.seed
        pending = list(self.pending)

        def run(packed):
            for bins, y, f, key in _blocks(packed, width, k):
                if number:
                    use = in_sample(key, number, share, seed)
                    bins, y, f = bins[use], y[use], f[use]
                r = y[:, None] - _latest(bins, f, pending)
                yield bins, np.clip(r, -2 * SPAN, 2 * SPAN - 1).astype(np.int32) if many else r
        self.drawn = self.blocks.mapPartitions(run)
        if many and not self.direct:
            self.drawn.persist(StorageLevel.MEMORY_AND_DISK)
        self.light = self.drawn.map(lambda b: (b[0], gradient(b[1], weights)))
        if self.n > self.small:     # several passes
            self.light.persist(StorageLevel.MEMORY_AND_DISK)

    def told(self, rows, run, meet, load: dict) -> list:
        """What ``meet`` makes of the (key, data) that ``run`` makes of blocks. The data of a key meet
        in one task, so that the driver gets merged results only. ``load`` has the work of each key."""
        if self.direct:
            return rows.mapPartitions(lambda it: meet(run(it))).collect()
        place = {key: i % self.tasks for i, key in enumerate(sorted(load, key=load.get, reverse=True))}
        met = rows.mapPartitions(run).partitionBy(min(len(place), self.tasks), place.__getitem__).mapPartitions(meet)
        out = met.collect()
        met._jrdd.rdd().cleanShuffleDependencies(False)     # else its files stay until the driver collects garbage
        return out

    def counted(self, rows, shape: tuple, count, merge) -> list:
        """What ``merge(node, counts)`` gives for every node with rows, as one list.

        ``count(total, *block)`` adds a block to the counts of its task, one array by node.
        """
        def run(blocks):
            total = np.zeros(shape, np.int64)
            for block in blocks:
                count(total, *block)
            for i in np.flatnonzero(total.reshape(shape[0], -1).any(1)).tolist():
                yield i, total[i]

        def meet(items):
            got = {}
            for node, total in items:
                got[node] = got[node] + total if node in got else total
            return [x for node, total in got.items() for x in merge(node, total)]
        return self.told(rows, run, meet, dict.fromkeys(range(shape[0]), 1))

    def splits(self, tree: Tree, first: int, count: int, leaf: int) -> list:
        """Per node of one level with rows: (node, gain, feature, cut, gradient sum and row count
        left of the cut, and of all) of its best split."""
        def add(total, bins, g):
            node = tree.leaves(bins) - first
            here = node >= 0
            total += sums(bins[here], g[here], node[here], count)

        def best(node, t):
            s, n = t
            gain, feature, cut = (x[0].item() for x in best_splits(s[None], n[None], leaf))
            left = feature, slice(0, cut + 1)
            return [(first + node, gain, feature, cut, *(int(x) for x in (s[left].sum(), n[left].sum(), s[0].sum(),
                                                                          n[0].sum())))]
        return sorted(self.counted(self.light, (count, 2, self.width, BINS), add, best))

    def whole(self, tree: Tree, nodes: dict[int, int], depth: int, weights, leaf: int, rate: float, levels) -> list:
        """(node, tree, gains, rows of each leaf) of the nodes, each with all that is below it grown in
        one task, where all rows lie in one with the leaves' quantiles. ``nodes`` tells their rows."""
        direct = self.direct

        def run(blocks):
            for bins, x in blocks:
                for node, part in _parts(tree.leaves(bins)):
                    if node in nodes:
                        yield node, (bins[part], x[part])

        def meet(items):
            for node, blocks in _by_key(items):
                bins, x = (np.concatenate(c) for c in zip(*blocks))
                t, gains, at = grown(bins, gradient(x, weights) if direct else x,
                                     depth + 1 - (node + 1).bit_length(), leaf, rate, not levels)
                parts = list(_parts(at))
                if direct and levels:
                    t.value = np.zeros((len(gains), len(levels)), np.int64)
                    for i, part in parts:
                        t.value[i] = np.rint(rate * quantiles(x[part].T, levels))
                yield node, t, gains, {i: len(part) for i, part in parts}
        return self.told(self.drawn if direct else self.light, run, meet, nodes)

    def refit(self, tree: Tree, leaves: dict[int, int], levels: Sequence[float], rate: float):
        """Set the leaves' values: quantiles of the residuals. ``leaves`` tells their rows."""
        few, small = self.few, {node for node, n in leaves.items() if n <= self.small}

        def run(blocks):
            for bins, r in blocks:
                for node, part in _parts(tree.leaves(bins)):
                    if node in small:
                        x = np.ascontiguousarray(r[part].T)
                        yield from [((node, 0), x)] if leaves[node] <= few else [
                            ((node, i), x[i:i + 1]) for i in range(len(levels))]

        def meet(items):
            for (node, i), x in _by_key(items):
                x = np.concatenate(x, axis=1)
                yield node, i, quantiles(x, levels[i:i + len(x)])
        load = {(node, i): n for node, n in leaves.items() if node in small
                for i in range(1 if n <= few else len(levels))}
        for node, i, q in self.told(self.drawn, run, meet, load) if load else []:
            tree.value[node, i:i + len(q)] = np.rint(rate * q)
        large = [node for node in leaves if node not in small]
        if large:
            tree.value[large] = np.rint(rate * self.digits(tree, large, levels))

    def digits(self, tree: Tree, leaves: Sequence[int], levels: Sequence[float]) -> np.ndarray:
        """Exact residual quantile per leaf and level: the value of rank ceil(level * n).

        Residuals are told apart by their upper bits first, then among those that share them.
        """
        k, nodes = len(levels), len(leaves)
        where = np.full(len(tree.feature), -1)
        where[list(leaves)] = np.arange(nodes)
        top, want = np.zeros((nodes, k), np.int64), np.zeros((nodes, k), np.int64)
        known = np.zeros(nodes, bool)
        for shift in range((BITS - 1) // DIGIT * DIGIT, -1, -DIGIT):
            first = shift + DIGIT >= BITS

            def add(total, bins, r, shift=shift, top=top, first=first):
                node = where[tree.leaves(bins)]
                node, r = node[node >= 0], (r[node >= 0].astype(np.int64) + 2 * SPAN) >> shift
                cell = ((node[:, None] * k + np.arange(k)) << DIGIT) + (r & ((1 << DIGIT) - 1))
                cell = cell.ravel() if first else cell[(r >> DIGIT) == top[node]]
                total += np.bincount(cell, minlength=total.size).reshape(total.shape)

            def pick(node, n, want=want, first=first):
                out = []
                for i, size in enumerate(n):
                    below = np.cumsum(size)
                    nth = rank(levels[i], int(below[-1])) if first else int(want[node, i])
                    at = int(np.searchsorted(below, nth))
                    out.append((node, i, at, nth - int(below[at - 1] if at else 0)))
                return out
            top, want = top << DIGIT, want.copy()
            for node, i, digit, rest in self.counted(self.drawn, (nodes, k, 1 << DIGIT), add, pick):
                top[node, i] += digit
                want[node, i] = rest
                known[node] = True
        return np.where(known[:, None], top - 2 * SPAN, 0)

    def grow(self, number: int, depth: int, weights, leaf: int, rate: float, levels) -> tuple[Tree, np.ndarray]:
        """Tree ``number`` and the gains of its splits by heap number."""
        self.draw(number, weights)
        size = (1 << (depth + 1)) - 1
        t, gains = _empty(size, self.levels), np.zeros(size)
        now, small, leaves = {0: self.n}, {}, {}
        for d in range(depth + 1):
            small |= {node: n for node, n in now.items() if n <= self.small}
            now = {node: n for node, n in now.items() if n > self.small}
            if d == depth or not now:
                break
            now = {}
            for at, gain, feature, cut, left_s, left_n, s, n in self.splits(t, (1 << d) - 1, 1 << d, leaf):
                if not levels and d == 0:
                    t.value[0] = _mean(s, n, rate)
                if not gain > 0:
                    leaves[at] = n
                    continue
                t.feature[at], t.cut[at], gains[at] = feature, cut, gain
                now |= {2 * at + 1: left_n, 2 * at + 2: n - left_n}
                if not levels:
                    t.value[2 * at + 1:2 * at + 3, 0] = _means(left_s, left_n, s, n, rate)
        leaves |= now
        for node, below, gain, ends in self.whole(t, small, depth, weights, leaf, rate, levels) if small else []:
            for i in range(len(gain)):
                at = (node << (i + 1).bit_length() - 1) + i
                t.feature[at], t.cut[at], t.value[at] = below.feature[i], below.cut[i], below.value[i]
                gains[at] = gain[i]
                if i in ends:
                    leaves[at] = ends[i]
        if levels and not self.direct:
            self.refit(t, leaves, levels, rate)
        if not self.direct:
            self.light.unpersist()
            self.drawn.unpersist()
        return t, gains

    def add(self, tree: Tree):
        self.pending.append(tree)
        if len(self.pending) < RENEW:
            return
        width, levels, pending = self.width, self.levels, list(self.pending)

        def run(batches):
            for b in batches:
                packed = zip(*(b.column(c).to_pylist() for c in ("bins", "y", "f", "key")))
                new = [_latest(bins, f, pending).tobytes() for bins, _, f, _ in _blocks(packed, width, levels)]
                yield b.set_column(b.schema.get_field_index("f"), "f", pa.array(new, pa.binary()))
        old = self.blocks
        self.kept.write(self.kept.df.mapInArrow(run, _PACK))
        self.pending = []
        self.read()
        old.unpersist()

    def drop(self):
        self.blocks.unpersist()
        self.kept.drop()


def edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Cuts of each feature at its quantiles: at most ``bins`` - 1 of them."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    got = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, F.lit(10_000)).alias(f"e{i}")
                   for i, c in enumerate(features)]).first()
    return [np.unique(np.array(got[i] or [], float)) for i in range(len(features))]


def fit(df: DataFrame, features: Sequence[str], y: str, key: str, trees: int, depth: int, rate: float,
        subsample: float, leaf: int, levels: Sequence[float] | None = None, seed: int = 42) -> Boosted:
    """Boosted trees for ``y``: its mean, or with ``levels`` those quantiles of it.

    ``key`` tells rows apart and decides which of them a tree is grown on. Rows with a
    null ``y`` take no part; null features count as the least value. Without rows, or
    with one value of ``y`` only, the model is constant.
    """
    ship(df.sparkSession)
    df = df.filter(F.col(y).isNotNull())
    n, low, high, mean = df.agg(F.count(F.lit(1)), F.min(y), F.max(y), F.avg(y)).first()
    features = list(features)
    levels = list(levels) if levels else None
    width = max(high - low, 1e-9) if n else 1.0
    model = Boosted(features, edges(df, features), levels, float(low or 0.0), width / SPAN,
                    gains=np.zeros(len(features)))
    k = len(levels or [0])
    weights = np.array([round(q * 1000) for q in levels]) if levels else None
    if not n:
        return model
    rows = _Rows(df, model, y, key, subsample, seed)
    if levels:
        root, _ = rows.grow(0, 0, weights, leaf, 1.0, levels)
    else:
        root = _empty(1, k)
        root.value[:] = round((mean - low) / model.step)
    model.trees.append(root)
    rows.add(root)
    for number in range(1, trees + 1):
        t, gains = rows.grow(number, depth, weights, leaf, rate, levels)
        np.add.at(model.gains, t.feature[t.feature >= 0], gains[t.feature >= 0])
        model.trees.append(t)
        rows.add(t)
    rows.drop()
    return model


def _mean(total, n, rate: float) -> int:
    return int(np.rint(rate * (total / n))) if n else 0


def _means(left_s, left_n, s, n, rate: float) -> tuple[int, int]:
    """Values of the two children of a node."""
    return _mean(left_s, left_n, rate), _mean(s - left_s, n - left_n, rate)


def predict(df: DataFrame, model: Boosted, name: str = "prediction") -> DataFrame:
    """Add ``name``: a double, or with levels an array of doubles, one per level."""
    ship(df.sparkSession)
    many = model.levels is not None

    @F.pandas_udf("array<double>" if many else "double")
    def told(x):
        import pandas as pd
        if not len(x):
            return pd.Series([], dtype=object if many else float)
        v = model.values(np.array(x.tolist(), float).reshape(len(x), -1))
        return pd.Series(v.tolist()) if many else pd.Series(v[:, 0])
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in model.features])
    return df.withColumn(name, told(x))
