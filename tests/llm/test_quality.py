"""Quality rules against a plain-Python version."""

import re
from collections import Counter

from caseloom.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    rep = {p for i, g in enumerate(tri) if c[g] > 1 for p in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(rep))


def test_counts_and_verdicts(spark):
    prose = "The men of the town went to the river and saw that it was wide for them. "
    cases = [None, "", " \t\n", "a", "a b c a b c", "x x x x x x", prose * 5,
             " ".join(f"{prose}{i}" for i in range(3)) + "\n" + prose, "#a| *b\n#a| *b\n\n \n",
             "é\x0bß\x0c語 😀\r\nw", "word " * 5000,
             " ".join(f"w{i} of the big{i} house{i}" for i in range(40)),
             " ".join(f"w{i}%%% of### the||| big{i}" for i in range(40))]
    rows = [(i, t, "clash") for i, t in enumerate(cases)] + [(6, prose * 5, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n = brute(cases[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, r.doc_id
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    kept = {r.doc_id: r.kept for r in got}
    assert kept[11] and not kept[12] and not kept[0] and not kept[10]
    assert quality.judge(docs.limit(0)).count() == 0


def test_one_stage_without_python(spark):
    docs = spark.range(3).selectExpr("id as doc_id", "'a b c' as text")
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
