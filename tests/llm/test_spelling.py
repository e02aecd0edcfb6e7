"""Spelling variants against brute force."""

import random
from collections import Counter

from caseloom.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words, times=10):
    form, out = {}, []
    by = {w: [o for o in words if near(w, o)] for w in words}
    for w, n in words.items():
        best = min(by[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, form[w], root, len(by[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def told(df):
    return sorted(map(tuple, df.select("word", "n", "form", "root", "n_near", "form_n").collect()))


def vocabulary(seed):
    r = random.Random(seed)
    words = {}
    for letters, count in (("ab", 60), ("abcdé", 80), ("abcdefghijklmnopqrstuvwxyzñü", 60)):
        for _ in range(count):
            w = "".join(r.choice(letters) for _ in range(r.randrange(4, 12)))
            words[w] = r.choice((2, 5, 30, 400, 5000))
            for _ in range(3):
                k, c = r.randrange(len(w)), r.choice(letters)
                v = r.choice((w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:]))
                if len(v) >= 4:
                    words.setdefault(v, r.choice((2, 3, 60)))
    words["z" * 3000] = 4
    words["z" * 2999] = 40
    return words


def test_groups(spark):
    words = vocabulary(1)
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()] + [(None, 5, "x"), ("abc", 9, "x")],
                               "word string, n long, root string")
    assert told(spelling.group(df.union(df))) == brute(words)


def test_crowded_keys(spark, monkeypatch):
    words = vocabulary(2)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    monkeypatch.setattr(spelling, "CROWDED", 1)
    assert told(spelling.group(df)) == brute(words)


def test_counts(spark):
    rows = [(1, "Abcdefg abcdefG, ÀBCDEFGH x" * 3), (2, None), (3, ""), (None, "abcdefg àbcdefgh"),
            (4, "12 abcdefgabcdefg" + "q" * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    change = spelling.with_slips(3)
    want = Counter()
    for i, t in rows:
        for w in spelling.re.findall(spelling.WORD, t or ""):
            w = change(i, spelling._lower(w))
            if len(w) >= 7:
                want[w] += 1
    assert {r[0]: r[1] for r in spelling.count_words(df, change=change).collect()} == dict(want)


def test_empty(spark):
    df = spark.createDataFrame([], "word string, n long")
    assert told(spelling.group(df)) == []


def test_pivots_are_the_least_disjoint_pair():
    r = random.Random(4)
    for _ in range(300):
        places = r.sample(range(12), r.randrange(3, 8))
        weight = {p: r.randrange(9) for p in places}
        best = min(weight[a] + weight[b] for a in places for b in places if b - a >= 2)
        a, b = spelling.pivots(places, weight.get)
        assert b - a >= 2 and weight[a] + weight[b] == best
