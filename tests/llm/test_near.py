"""Similarity join and repeated passages against brute force."""

import random
import re

import numpy as np

from caseloom.llm import near, substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, class_id string, n_words string"


def shingles(t):
    w = WORDS.findall(t or "")
    n = min(5, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, passage = [], r.choices(vocab, k=70)
    for i in range(n):
        w = r.choices(vocab, k=r.randrange(5, 200))
        if i % 3 == 0:
            w[5:5] = passage
        rows.append((i, " ".join(w)))
    for i in range(n, 2 * n):
        w = rows[r.randrange(min(8, n))][1].split()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(2 * n, None), (2 * n + 1, ""), (2 * n + 2, "a b"), (2 * n + 3, "a b"), (2 * n + 4, " \n"),
             (3, rows[3][1]), (2 * n + 5, "z " * 9000)]
    return [(i, t, "c", "c") for i, t in rows]


def check_join(spark, rows):
    got = near.similarity_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    want = sorted((d, least[find(i)], links[i]) for i, (d, *_) in enumerate(rows))
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in got) == want


def test_join(spark):
    check_join(spark, corpus(1))


def test_join_in_many_blocks_and_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 7)
    monkeypatch.setattr(near, "HOT", 6)
    check_join(spark, corpus(2))


def test_one_of_each(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows + [(None, "n o p q r s", "c", "c")], SCHEMA)
    kept = near.one_of_each(docs).collect()
    told = near.similarity_join(docs).collect()
    groups = {x.class_id for x in told if x.doc_id is not None}
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == sorted(groups)
    assert sum(x.doc_id is None for x in kept) == 1
    assert near.one_of_each(docs.limit(0)).count() == 0


def test_pruning_keeps_links():
    r = np.random.default_rng(1)
    need = near.least_matches(near.THRESHOLD)
    assert (np.diff(need) >= 0).all() and need[-1] > 60
    base = r.integers(0, 1 << 62, 1000, dtype=np.uint64)
    for share in (0.0, 0.05, 0.11, 0.3):
        k = int(1000 * share)
        a, b = np.unique(base), np.unique(np.concatenate([base[k:], r.integers(0, 1 << 62, k, dtype=np.uint64)]))
        x, y = near.surviving(near.signature(a)[None], near.signature(b)[None])
        alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert len(x) == 1 or alike < 0.8
        assert len(near.linked([a], [b], np.array([0]), np.array([0]))[0]) == int(alike >= 0.8)


def repeats(rows, size=50):
    first = {}
    for d, t in rows:
        w = WORDS.findall(t or "") if d is not None else []
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        w = WORDS.findall(t or "")
        gone = {p for i in range(len(w) - size + 1) if d is not None
                and first[tuple(w[i:i + size])] < d for p in range(i, i + size)}
        out.append((d, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)
                    if gone else t or ""))
    return sorted(out, key=str)


def test_repeats(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    passages = [r.choices(vocab, k=k) for k in (49, 50, 51, 75, 120)]
    rows = []
    for i in range(80):
        w = r.choices(vocab, k=r.randrange(0, 90))
        for p in r.sample(passages, r.randrange(0, 3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = p[r.randrange(0, 3):]
        rows.append((i, "\n ".join(w)))
    rows += [(7, rows[7][1]), (200, rows[7][1]), (201, None), (202, ""), (None, rows[9][1]), (203, "a " * 500),
             (204, "a " * 500), (-5, rows[11][1])]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], SCHEMA)
    got = substrings.remove_repeats(docs).collect()
    assert all(x.class_id == "c" for x in got)
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in got), key=str) == repeats(rows)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_one_of_each_goes_by_row(spark):
    """One id with a copied and a unique text, and with two texts alike."""
    r = random.Random(8)
    a = [f"w{r.randrange(500)}" for _ in range(80)]
    near_a = a[:-1] + ["end"]
    lone, lone2 = ([f"v{r.randrange(500)}" for _ in range(40)] for _ in range(2))
    lone_near = lone[:-1] + ["end"]
    rows = [(1, " ".join(a), "x", "y"), (2, " ".join(a), "x", "y"), (2, " ".join(lone2), "x", "y"),
            (3, " ".join(near_a), "x", "y"), (4, " ".join(lone), "x", "y"), (4, " ".join(lone_near), "x", "y"),
            (5, " ".join(lone_near), "x", "y"), (None, " ".join(a), "x", "y"), (6, "", "x", "y"),
            (6, "", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string, label string")
    got = near.one_of_each(df)
    assert got.columns == df.columns
    left = [(x.doc_id, x.text) for x in got.collect()]
    assert len([x for x in left if x[0] == 4]) == 1 and left.count((6, "")) == 1
    assert sorted(x for x in left if x[0] not in (4, 6, None)) == sorted([(1, " ".join(a)), (2, " ".join(lone2))])
    assert (None, " ".join(a)) in left and len(left) == 5


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, class_id string, n_links int")
    got = near.similarity_join(df, keep=("doc_id", "class_id", "n_links"))
    assert got.columns == ["doc_id", "class_id", "n_links", "_class_id", "_n_links", "n_linked_texts"]
    assert [tuple(x) for x in got.collect()] == [(1, "x", 5, 1, 0, 0)]


def test_whole_groups_cuts_only_between_groups():
    import pyarrow as pa
    from caseloom.llm.texts import whole_groups
    r = random.Random(4)
    keys = sorted((r.randrange(6), r.randrange(3)) for _ in range(300)) + [(9, 0)] * 50
    b = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys])], ["k", "b"])
    for size in (1, 7, 350):
        batches = [b.slice(0, 0)] + [b.slice(i, size) for i in range(0, len(keys), size)]
        got = [list(zip(*(t.column(c).to_pylist() for c in ("k", "b")))) for t in whole_groups(batches, ["k", "b"], 40)]
        assert [x for g in got for x in g] == keys
        assert all(g[-1] != h[0] for g, h in zip(got, got[1:]))
        assert all(len(g) >= 40 for g in got[:-1])
    assert list(whole_groups([], ["k"], 40)) == []


def test_forest_keeps_parts_and_one_link_a_node():
    import pyarrow as pa
    r = random.Random(5)
    pairs = [(bytes([r.randrange(60)]), bytes([r.randrange(60)])) for _ in range(40)]
    t = pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})
    out = [x for o in near._forest([t.slice(0, 25), t.slice(25)]) for x in zip(*(c.to_pylist() for c in o.columns))]
    assert len({a for a, _ in out}) == len(out)
    def parts(links):
        up = {}
        def find(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x
        for x, y in links:
            up[find(x)] = find(y)
        return sorted(sorted(x for x in up if find(x) == k) for k in {find(x) for x in list(up)} if sum(find(x) == k for x in up) > 1)
    assert parts(out) == parts([p for p in pairs if p[0] != p[1]])
