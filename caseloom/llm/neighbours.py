"""Approximate nearest neighbours by NN-descent, searched greedily.

A graph of near neighbours is grown from rough groups (random-projection cells): in
each round every node's neighbours, forward and reverse, are joined with their vectors
and compared with each other, and each keeps the best it has met. A query walks the
graph: it expands the best nodes it knows and looks at their neighbours until the best
stay the same. Answers are scored again on the original vectors in double precision.

Nodes live in parts of near nodes. A part fetches each vector it needs once per round,
as one byte per component, so traffic is linear in the nodes and nothing is broadcast.
The projections are fitted on a bounded sample. Nodes many others point at take part
with ``REVERSE`` of those per round, chosen anew each round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.ship import ship
from ..functions.staging import staged
from .base import query, table
from .substrings import _parts
from .texts import arrow_map

K = 50                  # neighbours kept in the graph
REVERSE = 50            # reverse neighbours used in a round
ROUNDS = 6
SETTLED = 0.02          # share of entries that may still change
TREES = 4               # groupings the graph starts from
LEAF = 200              # nodes compared with each other at the start
PART = 1000             # nodes of a part, about
CELLS = 4096            # cells of a projection tree, at most
SAMPLE = 20_000         # vectors the trees are fitted on, at most (about)
BEAM = 60               # best nodes a query keeps
EXPAND = 10             # of them looked into per round
STEPS = 4               # rounds of a search, at most


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(node, v): ids with vectors that can be compared.

    Null ids, and vectors that are null, zero, or hold a null or non-finite component
    are left out, and so are vectors of another length than most. Of several vectors of
    one id the smallest in array order counts.
    """
    v = vectors.select(F.col(vec_id).cast("long").alias("node"),
                       F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(F.col("node").isNotNull() & F.col("v").isNotNull() & ~odd
                 & F.exists("v", lambda x: x != 0)).groupBy("node").agg(F.min("v").alias("v"))
    v = staged(v.withColumn("size", F.size("v")))
    sizes = sorted((-r["count"], -r["size"]) for r in v.groupBy("size").count().collect())
    return v.filter(F.col("size") == -sizes[0][1]).drop("size") if sizes else v.drop("size")


def _tree(sample: np.ndarray, cells: int, rng):
    """Planes of a balanced binary tree, in heap order."""
    depth = max(0, int(np.ceil(np.log2(cells)))) if len(sample) > 1 else 0
    planes, cuts, held = [], [], [np.arange(len(sample))]
    for _ in range(depth):
        new = []
        for a in held:
            if len(a) > 1:
                i, j = rng.choice(a, 2, replace=False)
                plane = sample[i] - sample[j]
            else:
                plane = rng.normal(size=sample.shape[1])
            p = sample[a] @ plane
            cut = float(np.median(p)) if len(a) else 0.0
            planes.append(plane)
            cuts.append(cut)
            new += [a[p <= cut], a[p > cut]]
        held = new
    return depth, np.array(planes), np.array(cuts)


def _cell(v: np.ndarray, tree) -> np.ndarray:
    depth, planes, cuts = tree
    at = np.zeros(len(v), np.int64)
    for d in range(depth):
        node = at + (1 << d) - 1
        at = 2 * at + ((v * planes[node]).sum(1) > cuts[node])
    return at


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _bytes_of(v: np.ndarray):
    scale = np.abs(v).max(1) / 127
    return np.rint(v / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def _floats(t: pa.Table) -> np.ndarray:
    raw = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.int8).reshape(t.num_rows, -1)
    return raw.astype(np.float32) * t.column("scale").to_numpy()[:, None]


def _placed(trees):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"))
            q, scale = _bytes_of(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(scale),
                 *[pa.array(_cell(v, t)) for t in trees]],
                names=["node", "vec", "scale", *[f"cell{i}" for i in range(len(trees))]])
    return run


def _anew(df: DataFrame) -> DataFrame:
    """The same columns under new identities, to stand beside what they came from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


_PACKET = "part bigint, n bigint, data binary"


def _pack(part, u, w, s) -> list:
    return [(p, len(x), x.tobytes() + y.tobytes() + z.tobytes())
            for p, (x, y, z) in _parts(part, u, w, s.astype(np.float32))]


def _packets(rows) -> pa.Table:
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()),
                     "n": pa.array([r[1] for r in rows], pa.int64()),
                     "data": pa.array([r[2] for r in rows], pa.binary())})


def _unpack(t: pa.Table):
    u, w, s = [], [], []
    for n, d in zip(t.column("n").to_pylist(), t.column("data").to_pylist()):
        u.append(np.frombuffer(d, np.int64, n))
        w.append(np.frombuffer(d, np.int64, n, 8 * n))
        s.append(np.frombuffer(d, np.float32, n, 16 * n))
    none = np.zeros(0, np.int64)
    return [np.concatenate(x) if x else none for x in (u, w, s)]


def _best(u, w, s, k):
    """Top ``k`` distinct partners of each u: (u, w, s), best first."""
    o = np.lexsort((w, -s, u))
    u, w, s = u[o], w[o], s[o]
    o = np.lexsort((w, u))      # the same pair from two places: one stays
    first = np.ones(len(u), bool)
    first[1:] = (u[o][1:] != u[o][:-1]) | (w[o][1:] != w[o][:-1])
    keep = np.zeros(len(u), bool)
    keep[o[first]] = True
    u, w, s = u[keep], w[keep], s[keep]
    new = np.ones(len(u), bool)
    new[1:] = u[1:] != u[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(u)), 0))
    top = np.arange(len(u)) - start < k
    return u[top], w[top], s[top]


def _rough(k: int, leaf: int):
    """Near neighbours inside one cell, cut into groups by further projections."""
    def run(t: pa.Table) -> pa.Table:
        v, node = _floats(t), t.column("node").to_numpy()
        part = t.column("part").to_numpy()
        rng = np.random.default_rng(t.column("g")[0].as_py())
        todo, u, w, s = [np.arange(len(node))], [], [], []
        while todo:
            a = todo.pop()
            if len(a) > leaf:       # halves by rank: equal vectors split, too
                i, j = rng.choice(a, 2, replace=False)
                a = a[np.lexsort((rng.random(len(a)), v[a] @ (v[i] - v[j])))]
                todo += [a[:len(a) // 2], a[len(a) // 2:]]
                continue
            sim = v[a] @ v[a].T
            np.fill_diagonal(sim, -np.inf)
            m = min(k, len(a) - 1)
            if m > 0:
                top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                u.append(np.repeat(a, m))
                w.append(a[top].ravel())
                s.append(np.take_along_axis(sim, top, 1).ravel())
        if not u:
            return _packets([])
        u, w, s = map(np.concatenate, (u, w, s))
        return _packets(_pack(part[u], node[u], node[w], s))
    return run


def _merge(k: int):
    """In a part: each node's best of what it had and what was found."""
    def run(g: pa.Table, found: pa.Table) -> pa.Table:
        node = np.sort(g.column("node").to_numpy())
        lists = g.column("nbrs").combine_chunks()
        had = np.repeat(g.column("node").to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False))
        old_w = lists.flatten().to_numpy()
        old_s = g.column("sims").combine_chunks().flatten().to_numpy()
        u, w, s = _unpack(found)
        # known pairs first: they keep their score, so a repeat is no change
        mark = np.concatenate([np.zeros(len(had), bool), np.ones(len(u), bool)])
        u, w = np.concatenate([had, u]), np.concatenate([old_w, w])
        s = np.concatenate([old_s, s.astype(np.float32)])
        o = np.lexsort((mark, w, u))
        first = np.ones(len(u), bool)
        first[1:] = (u[o][1:] != u[o][:-1]) | (w[o][1:] != w[o][:-1])
        o = o[first]
        u, w, s, mark = u[o], w[o], s[o], mark[o]
        o = np.lexsort((w, -s, u))
        u, w, s, mark = u[o], w[o], s[o], mark[o]
        at = np.searchsorted(u, node)
        to = np.searchsorted(u, node, side="right")
        to = np.minimum(to, at + k)
        size = to - at
        pick = np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        off = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        fresh = np.add.reduceat(np.concatenate([mark[pick], [False]]).astype(np.int64),
                                np.minimum(np.concatenate([[0], np.cumsum(size)[:-1]]), len(pick))) \
            if len(node) else np.zeros(0, np.int64)
        fresh[size == 0] = 0
        kth = np.where(size >= k, s[np.maximum(to - 1, 0)] if len(s) else 0, -np.inf).astype(np.float32)
        part = g.column("part")[0].as_py() if len(node) else 0
        return pa.table({
            "part": pa.array(np.full(len(node), part, np.int64)), "node": pa.array(node),
            "nbrs": pa.ListArray.from_arrays(off, pa.array(w[pick])),
            "sims": pa.ListArray.from_arrays(off, pa.array(s[pick])),
            "kth": pa.array(kth), "fresh": pa.array(fresh)})
    return run


_GRAPH = "part bigint, node bigint, nbrs array<bigint>, sims array<float>, kth float, fresh bigint"


def _local_join(k: int):
    """In a part: the neighbours of each node compared with each other."""
    def run(pairs: pa.Table, need: pa.Table) -> pa.Table:
        member = need.column("member").to_numpy()
        order = np.argsort(member)
        member = member[order]
        v = _floats(need)[order]
        kth, home = need.column("kth").to_numpy()[order], need.column("home").to_numpy()[order]
        at = np.searchsorted(member, pairs.column("member").to_numpy())
        u, w, s = [], [], []
        for _, (x,) in _parts(pairs.column("node").to_numpy(), at):
            x = np.unique(x)
            sim = v[x] @ v[x].T
            np.fill_diagonal(sim, -np.inf)
            a, b = np.nonzero(sim > kth[x][:, None])
            u.append(x[a])
            w.append(x[b])
            s.append(sim[a, b])
        if not u:
            return _packets([])
        u, w, s = _best(*map(np.concatenate, (u, w, s)), k)
        return _packets(_pack(home[u], member[u], member[w], s))
    return run


def graph(v: DataFrame, k: int = K, rounds: int = ROUNDS):
    """(nodes, graph): where each node lives with its vector; its near neighbours."""
    ship(v.sparkSession)
    n = v.count()
    sample = v.filter(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < max(1, int(1e6 * SAMPLE / max(n, 1))) + 1)
    got = sample.select("v").toPandas()["v"].tolist() if n else []      # bounded by SAMPLE
    rng = np.random.default_rng(7)
    cells = int(min(CELLS, max(1, n // PART)))
    base = np.array(got) if got else np.zeros((0, 1))
    trees = [_tree(base, cells, rng) for _ in range(TREES)]
    placed = staged(arrow_map(v, _placed(trees), "node bigint, vec binary, scale float, "
                              + ", ".join(f"cell{i} bigint" for i in range(TREES))))
    # a cell that holds many equal vectors is dealt into several groups by hash
    for i in range(TREES):
        size = placed.groupBy(f"cell{i}").agg(F.ceil(F.count(F.lit(1)) / (4 * PART)).alias(f"cut{i}"))
        placed = placed.join(F.broadcast(size), f"cell{i}")     # CELLS rows at most
    group = lambda i: (F.lit(i * 10_000_000_000) + F.col(f"cell{i}") * 1_000_000        # noqa: E731
                       + F.pmod(F.xxhash64("node", F.lit(i)), F.col(f"cut{i}")))
    nodes = staged(placed.select("node", "vec", "scale", group(0).alias("part"),
                                 *[group(i).alias(f"g{i}") for i in range(TREES)]))
    rough = nodes.select("node", "part", "vec", "scale", F.explode(
        F.array(*[f"g{i}" for i in range(TREES)])).alias("g")) \
        .groupBy("g").applyInArrow(_rough(k, LEAF), _PACKET)
    nodes = nodes.select("node", "part", "vec", "scale")
    empty = nodes.select("part", "node", F.array().cast("array<bigint>").alias("nbrs"),
                         F.array().cast("array<float>").alias("sims"))
    g = staged(empty.groupBy("part").cogroup(rough.groupBy("part")).applyInArrow(_merge(k), _GRAPH))
    for r in range(rounds):
        out = g.select("part", "node", F.explode("nbrs").alias("member"))
        # two levels, so that a node that very many point at is ranked in pieces
        salted = Window.partitionBy("member", F.pmod(F.xxhash64("node"), F.lit(64))).orderBy("lot")
        whole = Window.partitionBy("member").orderBy("lot")
        back = (out.select("node", "member", F.xxhash64("node", "member", F.lit(r)).alias("lot"))
                .withColumn("p", F.row_number().over(salted)).filter(F.col("p") <= REVERSE)
                .withColumn("p", F.row_number().over(whole)).filter(F.col("p") <= REVERSE)
                .select(F.col("member").alias("node"), F.col("node").alias("member"))
                .join(nodes.select("node", "part"), "node").select("part", "node", "member"))
        pairs = staged(out.union(back).distinct())
        known = g.select(F.col("node").alias("member"), "kth").join(
            nodes.select(F.col("node").alias("member"), "vec", "scale", F.col("part").alias("home")), "member")
        need = _anew(pairs.select("part", "member").distinct().join(known, "member"))
        found = pairs.groupBy("part").cogroup(need.groupBy("part")).applyInArrow(_local_join(k), _PACKET)
        g = staged(g.select("part", "node", "nbrs", "sims").groupBy("part")
                   .cogroup(found.groupBy("part")).applyInArrow(_merge(k), _GRAPH))
        if (g.agg(F.sum("fresh")).first()[0] or 0) < SETTLED * k * n:
            break
    return nodes, g


_STATE = "part bigint, query bigint, ids array<bigint>, sims array<float>, todo array<bigint>, done array<bigint>"


def _step(beam: int, expand: int):
    """In a part: score what the queries have met, keep the best, choose what to expand."""
    def run(state: pa.Table, need: pa.Table) -> pa.Table:
        member = need.column("member").to_numpy()
        order = np.argsort(member)
        member, v = member[order], (_floats(need)[order] if len(order) else np.zeros((0, 1), np.float32))
        met, hold = {}, {}
        cols = [state.column(c).to_pylist() for c in ("query", "kind", "ids", "sims", "done", "part")]
        for q, kind, ids, sims, done, part in zip(*cols):
            if kind:
                met.setdefault(q, []).append(ids)
            else:
                hold[q] = (ids, sims, done, part)
        rows = []
        for q, (ids, sims, done, part) in hold.items():
            ids, sims = np.array(ids, np.int64), np.array(sims, np.float32)
            new = np.unique(np.concatenate(met[q])) if q in met else np.zeros(0, np.int64)
            new = np.setdiff1d(new, np.append(ids, q))
            if len(new):
                x = v[np.searchsorted(member, new)]
                ids = np.concatenate([ids, new])
                sims = np.concatenate([sims, x @ v[np.searchsorted(member, q)]])
            best = np.lexsort((ids, -sims))[:beam]
            ids, sims = ids[best], sims[best]
            todo = ids[~np.isin(ids, done)][:expand]
            rows.append((part, q, ids.tolist(), sims.tolist(), todo.tolist(), list(done) + todo.tolist()))
        names = ["part", "query", "ids", "sims", "todo", "done"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()),
                 pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table({n: pa.array([r[i] for r in rows], k)
                         for i, (n, k) in enumerate(zip(names, kinds))})
    return run


def search(nodes: DataFrame, g: DataFrame, queries: DataFrame, steps: int = STEPS) -> DataFrame:
    """(query, ids): the best nodes each query has met on its walk from its own place."""
    none = F.array().cast("array<bigint>")
    state = g.join(queries.select(F.col("query").alias("node")), "node", "left_semi").select(
        "part", F.col("node").alias("query"), F.slice("nbrs", 1, BEAM).alias("ids"),
        F.slice("sims", 1, BEAM).alias("sims"), F.slice("nbrs", 1, EXPAND).alias("todo"),
        F.slice("nbrs", 1, EXPAND).alias("done"))
    lists = g.select(F.col("node").alias("at"), "nbrs")
    vectors = nodes.select(F.col("node").alias("member"), "vec", "scale")
    for _ in range(steps):
        state = staged(state)
        met = staged(state.select("part", "query", F.explode("todo").alias("at")).join(lists, "at")
                     .select("part", "query", "nbrs"))
        need = (met.select("part", F.explode("nbrs").alias("member"))
                .union(state.select("part", "query")).distinct().join(vectors, "member"))
        need = _anew(need)
        both = state.select("part", "query", F.lit(0).alias("kind"), "ids", "sims", "done").union(
            met.select("part", "query", F.lit(1), "nbrs", F.array().cast("array<float>"), none))
        state = both.groupBy("part").cogroup(need.groupBy("part")).applyInArrow(
            _step(BEAM, EXPAND), _STATE)
    return state.select("query", "ids")


def nearest(vectors: DataFrame, queries, top: int = 20, vec_id: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the largest inner products found for each query.

    ``queries`` is a condition on the column ``node``. A query is not its own candidate;
    ties go to the smaller id. With fewer candidates than ``top``, all are returned.
    """
    v = usable(vectors, vec_id, vector)
    nodes, g = graph(v)
    found = search(nodes, g, v.filter(queries).select(F.col("node").alias("query")))
    pairs = found.select(F.col("query").alias("query_id"), F.explode("ids").alias("vec_id"))
    scored = (pairs.join(v.select(F.col("node").alias("vec_id"), F.col("v").alias("b")), "vec_id")
              .join(v.select(F.col("node").alias("query_id"), F.col("v").alias("a")), "query_id"))
    score = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (scored.select("query_id", "vec_id", score.alias("score"))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))


@query("op3_nearest_neighbours")
def op3_nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest rows of every twentieth id."""
    return nearest(table(spark, d, "embeddings"), F.pmod("node", F.lit(20)) == 0)
