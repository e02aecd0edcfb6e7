"""Similarity join on word shingles: MinHash candidates, Bayesian pruning, exact proof.

1. Texts with the same shingle set are one class; only one of them is compared.
2. Band values of MinHash signatures are the buckets in which candidates meet. Buckets
   with the same members are looked at once. Inside a bucket, members join leaders
   rather than each other, so a bucket of k copies gives about k edges, not k squared.
3. Connected edges make clusters. Members of a cluster are compared block against
   block: signatures are read sixteen values at a time and a pair is dropped once the
   posterior probability that it reaches the threshold is below ``TOLERANCE``; the
   others are proved on the shingle sets. Only counts and spanning links leave a task.
"""

from __future__ import annotations

import functools
import math
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import ship
from ..functions.staging import staged
from .base import WORD, fresh, query, table
from .substrings import Hasher, mix
from .texts import arrow_map, by_bytes, forget, whole_groups

SHINGLE = 5
THRESHOLD = "4/5"
BANDS, ROWS = 32, 4         # a pair at the threshold is missed once in 20 million
STEP = 16                   # signature values read at a time
TOLERANCE = 1e-9
LOOSE = 0.35                # estimated similarity that ties a member to a leader
BLOCK = 256                 # members compared with each other at a time
HOT = 4096                  # members of a bucket handled together
PIECE = 2048                # rows of small groups handled together
FOREST = 200_000            # nodes whose links a task joins up before it hands them on

_U = np.uint64
_WORDS = re.compile(WORD)


@functools.lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    n = BANDS * ROWS
    return (r.integers(1, 1 << 63, n, dtype=_U) * _U(2) + _U(1), r.integers(0, 1 << 63, n, dtype=_U))


def shingles(text: str | None, hasher: Hasher) -> np.ndarray:
    """Sorted distinct hashes of runs of five words; a shorter text is one shingle."""
    words = _WORDS.findall(text) if text else []
    if not words:
        return np.zeros(0, _U)
    h = hasher.words(words)
    return np.unique(hasher.runs(h, min(SHINGLE, len(h))))


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values: the upper halves of the least products."""
    mul, add = _multipliers()
    out = np.full(len(mul), np.iinfo(np.uint64).max, _U)
    for at in range(0, len(s), 512):
        part = s[at:at + 512, None] * mul
        part += add
        np.minimum(out, part.min(0), out=out)
    return (out >> _U(32)).astype(np.uint32)


@functools.lru_cache(maxsize=4)
def least_matches(threshold: str, tolerance: float = TOLERANCE) -> np.ndarray:
    """By number of values read: the fewest matches with which a pair may go on.

    With m of n values equal and a uniform prior, the similarity has the density
    Beta(m + 1, n - m + 1); it reaches t with the probability that a binomial of n + 1
    trials at t is at most m.
    """
    t, out = float(Fraction(threshold)), []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return np.array(out)


def surviving(a: np.ndarray, b: np.ndarray, threshold: str = THRESHOLD):
    """Index pairs (row of a, row of b) that no look at the signatures has dropped."""
    need = least_matches(threshold)
    i, j = map(np.ravel, np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
    same = np.zeros(len(i), np.int16)
    for k, least in enumerate(need):
        x, y = a[:, k * STEP:(k + 1) * STEP], b[:, k * STEP:(k + 1) * STEP]
        more = np.empty(len(i), np.int16)
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            more[s] = (x[i[s]] == y[j[s]]).sum(1)
        same = same + more
        go = same >= least
        i, j, same = i[go], j[go], same[go]
    return i, j


def linked(sets_a: list, sets_b: list, i: np.ndarray, j: np.ndarray, threshold: str = THRESHOLD):
    """Of the index pairs, those whose sets reach the threshold exactly."""
    if not len(i):
        return i, j
    t = Fraction(threshold)
    na, nb = np.array(list(map(len, sets_a))), np.array(list(map(len, sets_b)))
    if len(i) <= 64:
        inter = np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True))
                          for x, y in zip(i, j)])
    else:
        both = np.concatenate(sets_a + sets_b)
        vocab, code, uses = np.unique(both, return_inverse=True, return_counts=True)
        new = np.cumsum(uses > 1) - 1       # shingles of one text meet no other
        owner = np.repeat(np.arange(len(na) + len(nb)), np.concatenate([na, nb]))
        keep = uses[code] > 1
        code, owner = new[code[keep]], owner[keep]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        total = np.zeros((len(na), len(nb)), np.float32)
        width = 8192
        size = int((uses > 1).sum())
        for at in range(0, size, width):
            s, e = np.searchsorted(code, [at, at + width])
            m = np.zeros((len(na) + len(nb), min(width, size - at)), np.float32)
            m[owner[s:e], code[s:e] - at] = 1
            total += m[:len(na)] @ m[len(na):].T
        inter = total[i, j].astype(np.int64)
    ok = inter * t.denominator >= t.numerator * (na[i] + nb[j] - inter)
    return i[ok], j[ok]


def _roots(n: int, pairs) -> list[int]:
    """Smallest index of each connected part."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for x, y in pairs:
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its connected part, for nodes with edges.

    ``edges`` has columns a and b. Labels pass along edges and then to the label's own
    label, so the rounds grow with the logarithm of a part's width.
    """
    both = staged(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a"))
                  .distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m")))
        step = (labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label")))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        now = staged(step.join(jump, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        if not now.filter("label <> old").limit(1).count():
            return now.select("node", "label")
        labels = now.select("node", "label")


def _sketch(keep: int, names: list[str], schema: pa.Schema):
    def run(batches):
        forget()
        hasher = Hasher()
        for b in by_bytes(batches, "__text"):
            cls, size, sig = [], [], []
            for t in b.column("__text").to_pylist():
                s = shingles(t, hasher)
                size.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in range(keep)]
                + [b.column("__id"), b.column("__h"), pa.array(cls, pa.binary()), pa.array(size, pa.int64()),
                   pa.array(sig, pa.binary())], schema=schema)
    return run


def _bands(batches):
    mul, _ = _multipliers()
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, BANDS, ROWS)
        key = np.zeros(sig.shape[:2], _U)
        for r in range(ROWS):
            key = mix(key + sig[:, :, r].astype(_U) * mul[r])
        key = mix(key + np.arange(1, BANDS + 1, dtype=_U) * mul[ROWS]).view(np.int64)
        at = np.repeat(np.arange(b.num_rows), BANDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.ravel()), b.column("cls").take(pa.array(at))], names=["key", "cls"])


def _gather(t: pa.Table) -> pa.Table:
    """In each bucket: members tied to leaders that may be alike."""
    t = t.sort_by([("key", "ascending"), ("blk", "ascending"), ("cls", "ascending")])
    a, b = [], []
    key, blk = t.column("key").to_numpy(), t.column("blk").to_numpy()
    cls = t.column("cls").to_pylist()
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32) \
        .reshape(len(cls), BANDS * ROWS) if cls else None
    new = np.flatnonzero((key[1:] != key[:-1]) | (blk[1:] != blk[:-1])) + 1
    limits = [0, *new.tolist(), len(cls)] if cls else []
    hub = {}
    for s, e in zip(limits[:-1], limits[1:]):
        rest, group = np.arange(s, e), np.arange(s, e)
        while len(rest):
            head = rest[0]
            alike = (sig[rest] == sig[head]).mean(1)
            # tied members become one group, so that a member leaves one edge at most
            tied = np.unique(group[rest[alike >= LOOSE] - s])
            if len(tied) > 1:
                group[np.isin(group, tied)] = tied[0]
            # a member as close as a link is led; one less close also looks for others
            rest = rest[alike < float(Fraction(THRESHOLD))]
            rest = rest[rest != head]
        for x, root in zip(range(s, e), group.tolist()):
            if x != root:
                a.append(cls[x])
                b.append(cls[root])
            elif blk[x] >= 0:       # a split bucket: its groups are tied to each other
                a.append(cls[x])
                b.append(hub.setdefault(int(key[x]), cls[x]))
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _forest(tables):
    """Links (a, b) of a task as a forest: one link from each node to its tree's smallest."""
    up: dict = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def trees():
        rows = [(x, r) for x in list(up) if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)],
                                          names=["a", "b"])
    for t in tables:
        for x, y in zip(t.column("a").to_pylist(), t.column("b").to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > FOREST:
            yield trees()
            up.clear()
    yield trees()


def _lead(batches):
    """Buckets, sorted: the forest of the ties between their members."""
    return _forest(_gather(t) for t in whole_groups(batches, ["key", "blk"], PIECE))


def _proofs(threshold: str):
    prove = _prove(threshold)

    def run(batches):
        for t in whole_groups(batches, ["label", "i", "j"], BLOCK):
            yield from prove(t).to_batches()
    return run


def _sets(batches):
    """Shingle sets of the class members to compare, checked against the class."""
    hasher = Hasher()
    for b in by_bytes(batches, "text"):
        sets, sigs, keep = [], [], []
        for r, (t, c) in enumerate(zip(b.column("text").to_pylist(), b.column("cls").to_pylist())):
            s = shingles(t, hasher)
            if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == c:
                keep.append(r)
                sets.append(s.tobytes())
                sigs.append(signature(s).astype(np.uint16).tobytes())
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(x).take(at) for x in ("cls", "label", "n", "blocks")]
            + [pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())],
            names=["cls", "label", "n", "blocks", "shingles", "sig"])


def _prove(threshold: str):
    """Block pairs of clusters: links counted per member, one spanning link each."""
    def run(t: pa.Table) -> pa.Table:
        out = {"cls": [], "root": [], "links": [], "texts": []}
        t = t.sort_by([("label", "ascending"), ("i", "ascending"), ("j", "ascending"),
                       ("own", "ascending"), ("cls", "ascending")])
        cls, own = t.column("cls").to_pylist(), t.column("own").to_numpy()
        n = t.column("n").to_numpy()
        job = list(zip(t.column("label").to_pylist(), t.column("i").to_pylist(), t.column("j").to_pylist()))
        raw, sigs = t.column("shingles").to_pylist(), t.column("sig").to_pylist()
        at = 0
        while at < len(job):
            to = at
            while to < len(job) and job[to] == job[at]:
                to += 1
            i_block, j_block = job[at][1:]
            rows = np.arange(at, to)
            left = rows[own[at:to] == i_block]
            right = left if i_block == j_block else rows[own[at:to] == j_block]
            count, texts, pairs = np.zeros(to - at, np.int64), np.zeros(to - at, np.int64), []
            if len(left) and len(right):
                sets = {r: np.frombuffer(raw[r], _U) for r in rows}
                sig = {r: np.frombuffer(sigs[r], np.uint16) for r in rows}
                x, y = surviving(np.stack([sig[r] for r in left]), np.stack([sig[r] for r in right]),
                                 threshold)
                if i_block == j_block:
                    x, y = x[x < y], y[x < y]
                x, y = linked([sets[r] for r in left], [sets[r] for r in right], x, y, threshold)
                x, y = left[x] - at, right[y] - at
                np.add.at(count, x, n[at + y])
                np.add.at(count, y, n[at + x])
                np.add.at(texts, x, 1)
                np.add.at(texts, y, 1)
                pairs = zip(x.tolist(), y.tolist())
            root = _roots(to - at, pairs)
            for r in np.flatnonzero(texts).tolist():
                out["cls"].append(cls[at + r])
                out["root"].append(cls[at + root[r]])
                out["links"].append(int(count[r]))
                out["texts"].append(int(texts[r]))
            at = to
        return pa.table({"cls": pa.array(out["cls"], pa.binary()), "root": pa.array(out["root"], pa.binary()),
                         "links": pa.array(out["links"], pa.int64()),
                         "texts": pa.array(out["texts"], pa.int64())})
    return run


def similarity_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    keep: tuple = ("doc_id",), threshold: str = THRESHOLD) -> DataFrame:
    """``keep`` plus class_id, n_links and n_linked_texts, one row per row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of five-word
    shingles is at least the threshold. ``class_id`` is the smallest id of the documents
    that links connect; ``n_links`` counts the other documents a document is linked to,
    ``n_linked_texts`` those classes of other shingle sets.

    A text of one to four words is one shingle. A null or wordless text has none: it is
    linked to nothing and its class is its own id. Rows repeated under one id are
    documents of their own. If ``keep`` names a column like one of the three, the new one
    is called the same with underscores in front.
    """
    told = _classed(docs, text, doc_id, keep, threshold)
    return told.select(*told.columns[:-1])


def _classed(docs: DataFrame, text: str, doc_id: str, keep: tuple, threshold: str) -> DataFrame:
    """``similarity_join`` with one more column at the end: what a class is known by."""
    spark = docs.sparkSession
    names = fresh(docs.select(*keep), "class_id", "n_links", "n_linked_texts", "label")
    ship(spark)
    inner = [f"__c{i}" for i in range(len(keep))]
    own = [T.StructField(i, docs.schema[c].dataType) for c, i in zip(keep, inner)]
    schema = T.StructType(own + T.StructType.fromDDL(
        "__id bigint, __h bigint, cls binary, size bigint, sig binary").fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    rows = docs.select(*[F.col(c).alias(i) for c, i in zip(keep, inner)],
                       F.col(doc_id).cast("long").alias("__id"), F.xxhash64(text).alias("__h"),
                       F.col(text).alias("__text"))
    rows = staged(arrow_map(rows, _sketch(len(keep), inner, to_arrow_schema(schema)), schema))
    classes = staged(rows.filter("cls is not null").groupBy("cls").agg(
        F.min("__id").alias("rep"), F.min(F.struct(F.col("__id").isNull(), "__id", "__h")).alias("at"),
        F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig")))
    bands = staged(arrow_map(classes.select("cls", "sig"), _bands, "key long, cls binary"))
    met = bands.groupBy("key").agg(
        F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("cls")).alias("f"),
        F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("g")).filter("k > 1")
    chosen = met.groupBy("k", "f", "g").agg(F.min("key").alias("key")).select("key", "k")
    blocks = F.ceil(F.col("k") / HOT).cast("int")
    members = bands.join(chosen, "key").select(
        "key", "cls", F.when(F.col("k") > HOT, F.pmod(F.xxhash64("cls"), blocks))
        .otherwise(-1).cast("int").alias("blk"))
    # a task reads its buckets one by one, in order, and hands on a forest of their ties
    ties = arrow_map(members.join(classes.select("cls", "sig"), "cls").repartition("key", "blk")
                     .sortWithinPartitions("key", "blk", "cls"), _lead, "a binary, b binary")
    edges = arrow_map(ties.repartition("a"), _forest, "a binary, b binary")
    # leaders of a split bucket meet through the bucket's smallest member
    hot = members.filter("blk >= 0").groupBy("key", "blk").agg(F.min("cls").alias("a"))
    hot = hot.join(members.filter("blk >= 0").groupBy("key").agg(F.min("cls").alias("b")), "key")
    cluster = components(edges.union(hot.select("a", "b")))
    size = cluster.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    wanted = (cluster.join(size, "label").withColumnRenamed("node", "cls")
              .join(classes.select("cls", "n", F.col("at.__id").alias("id"), F.col("at.__h").alias("h")), "cls"))
    # one row of each class brings its text: by hash, and by id, which may be null
    found = docs.select(F.col(doc_id).cast("long").alias("fid"), F.xxhash64(text).alias("fh"),
                        F.col(text).alias("text"))
    compared = arrow_map(
        found.join(wanted, (F.col("fh") == F.col("h")) & F.col("fid").eqNullSafe(F.col("id"))).select("cls", "label", "n", "blocks", "text"),
        _sets, "cls binary, label binary, n bigint, blocks int, shingles binary, sig binary")
    own_block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    jobs = compared.dropDuplicates(["cls"]).withColumn("own", own_block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "cls", "n", "shingles", "sig", "own",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    proved = staged(arrow_map(
        jobs.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j"),
        _proofs(threshold), "cls binary, root binary, links bigint, texts bigint"))
    counts = proved.groupBy("cls").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    spanning = proved.select(F.col("cls").alias("a"), F.col("root").alias("b")).filter("a <> b")
    parts = components(arrow_map(spanning.repartition("a"), _forest, "a binary, b binary"))
    grouped = staged(classes.select("cls", "rep", "n").join(
        parts.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "cls", "left").select(
        "cls", "rep", F.coalesce("label", "cls").alias("label"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_linked_texts")))
    least = grouped.groupBy("label").agg(F.min("rep").alias("class_id"))
    told = grouped.join(least, "label").select("cls", "class_id", "n_links", "n_linked_texts", "label")
    return rows.join(told, "cls", "left").select(
        *[F.col(i).alias(c) for c, i in zip(keep, inner)],
        F.when(F.col("cls").isNull(), F.col("__id")).otherwise(F.col("class_id")).alias(names[0]),
        *[F.coalesce(x, F.lit(0)).cast("long").alias(n)
          for x, n in zip(("n_links", "n_linked_texts"), names[1:])], F.col("label").alias(names[3]))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                threshold: str = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of linked ones: that of the smallest id.

    If rows of a group repeat that id with different texts, the one whose text has the
    smallest hash stays. Rows without an id stay, and so do wordless texts; of rows that
    repeat one id and text one stays. Other columns may have any name.
    """
    ids, hashes = fresh(docs, "near_id", "near_hash")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("hash"),
                       F.col(text).alias("text"))
    told = staged(_classed(rows, "text", "id", ("id", "hash"), threshold)
                  .filter("label is not null and id is not null").select("id", "hash", "class_id", "label"))
    # rows of a group under its smallest id: all but one go, too
    first = told.filter("id = class_id").groupBy("label").agg(F.min("hash").alias("least"))
    also = told.filter("id = class_id").join(first, "label").filter("hash <> least")
    gone = told.filter("id <> class_id").select("id", "hash").union(also.select("id", "hash")).distinct() \
        .select(F.col("id").alias(ids), F.col("hash").alias(hashes))
    return docs.join(gone, (docs[doc_id].cast("long") == gone[ids]) & (F.xxhash64(docs[text]) == gone[hashes]),
                     "left_anti").dropDuplicates([doc_id, text])


@query("op1_ngram_jaccard_join", r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
    from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from
    (select doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w) + 1, 2)))) as i from w)),
n as (select doc_id, count(*) as n, md5(string_agg(g, chr(10) order by g)) as k from s group by doc_id),
meet as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g)
    where a.doc_id <> b.doc_id group by all),
e as (select a, b, x.k <> y.k as other from meet join n x on x.doc_id = a join n y on y.doc_id = b
    where 5 * c >= 4 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
cls as (select a, min(b) as class_id from r group by a)
select d.doc_id, class_id, count(e.b) as n_links, count(distinct case when other then y.k end) as n_linked_texts
from documents d join cls on cls.a = d.doc_id left join e on e.a = d.doc_id
left join n y on y.doc_id = e.b group by all""")
def op1_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    """Class and number of links of every document."""
    return similarity_join(table(spark, d, "documents"))
