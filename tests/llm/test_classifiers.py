"""Toxicity and language: brute-force versions of the core, odd rows, held-out rows."""

import math
import random

import numpy as np
import public_tokenizers as P

from caseloom.llm import language, toxicity

PATH = P.path(language.VOCABULARY)


def test_fold_and_hits():
    m = toxicity.Model({toxicity.fold("idiot"): 4.0, toxicity.fold("clown"): 2.0,
                        toxicity.fold("idiotic"): 5.0})
    plain = m.strength(["you idiot"])[0]
    assert plain > 0
    for t in ("you 1d10t", "you IDI0T", "you іdіоt", "you id​iot", "you 1diot!"):
        assert m.strength([t])[0] == plain, t
    assert m.strength(["a class clown", "a clown", None, "", "nonidiot"])[0] == 0.0
    assert m.strength(["a clown"])[0] > 0 and m.strength([None, "", "nonidiot"]) == [0.0] * 3
    # one word counts once, by its heaviest beginning
    assert m.strength(["idiotic"])[0] == 5.0 / math.sqrt(1.01)
    long = m.strength(["idiot " + "fine " * 10_000])[0]
    assert 0 < long < plain
    assert 0 <= m.score(0.0) < 0.5 < m.score(9.0) <= 1


def test_hits_against_search_of_every_place():
    r = random.Random(5)
    terms = {"abc": 1.0, "abca": 2.5, "cab": 0.5, "bb": 4.0}
    m = toxicity.Model(dict(terms), exceptions=("abc cab", "bb"))
    m.exceptions = ("abc cab",)
    for _ in range(300):
        t = "".join(r.choices("abc  ", k=40))
        excused = [(i, i + 7) for i in range(len(t)) if t.startswith("abc cab", i)
                   and (i == 0 or not t[i - 1].isalnum())]
        want = 0.0
        for i in range(len(t)):
            if i and t[i - 1].isalnum():
                continue
            best = max(((w, k) for k, w in terms.items() if t.startswith(k, i)), default=None)
            if best and not any(a <= i and i + len(best[1]) <= b for a, b in excused):
                want += best[0]
        got = m.strength([t])[0] * math.sqrt(1 + len(t.split()) / 100)
        assert abs(got - want) < 1e-9, t


def test_learns_words_from_labels(spark):
    r = random.Random(1)
    fill = ["river", "town", "house", "green", "apple", "stone"]
    rows, labels = [], []
    for i in range(300):
        words = r.choices(fill, k=30)
        bad = i % 5 == 0
        if bad:
            words[r.randrange(30)] = "grumblex" + r.choice("abc")
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(bad)))
    rows += [(400, None, "en"), (401, "", "en"), (None, "grumblexa", None), (7, rows[7][1], "en")]
    labels += [(3, 1, None), (None, 0, 1), (5000, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs, lab)
    got = toxicity.score(docs, m).collect()
    assert len(got) == len(rows)
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        if x.doc_id is None:
            assert x.predicted == 1
        else:
            assert x.predicted == int(x.doc_id < 300 and x.doc_id % 5 == 0), x
    none = toxicity.fit(docs, lab.limit(0))
    assert set(none.weights) == {toxicity.fold(w) for w in toxicity.SEED}
    assert toxicity.score(docs.limit(0), none).count() == 0


def segmentations(w, probs):
    if not w:
        yield 1.0
    for k in range(1, len(w) + 1):
        if w[:k] in probs:
            for rest in segmentations(w[k:], probs):
                yield probs[w[:k]] * rest


def test_forward_sums_all_segmentations():
    vocab = language.vocabulary(PATH)
    r = np.random.default_rng(0)
    m = language.Model(PATH, ["a", "b"], r.random((len(vocab) + 1, 2)) + 0.01)
    words = ["der", "house", "été", "ξψ", "street"]
    got = m.likelihoods(words)
    for i, w in enumerate(words):
        for k in range(2):
            probs = {p: m.probs[j, k] for p, j in vocab.items()}
            for c in "▁" + w:
                probs.setdefault(c, m.probs[len(vocab), k])
            assert abs(got[i, k] - math.log(sum(segmentations("▁" + w, probs)))) < 1e-9
    # expected uses cover each letter of a word once
    size = {j: len(p) for p, j in vocab.items()} | {len(vocab): 1}
    e = m.expected(words, 0, np.array([1.0, 2.0, 3.0, 1.0, 1.0]))
    assert abs(sum(e[j] * size[j] for j in np.nonzero(e)[0])
               - sum(n * (len(w) + 1) for n, w in zip([1, 2, 3, 1, 1], words))) < 1e-6


def test_lattice_holds_every_piece(monkeypatch):
    """Piece ids against a look-up of every part of the words, over several blocks."""
    monkeypatch.setattr(language, "BLOCK", 3)
    vocab = language.vocabulary(PATH)
    words = ["water", "a", "straße", "語言", "zzzzqq", "the", "not", "éa", "𝒳", "x" * 48, "water", "in"] + list(vocab)[:300]
    words = [w.strip("▁") for w in words if w.strip("▁")]
    seen, none = [], len(vocab) + 1
    for n, at, ids in language._lattice(words, language.trie(PATH), len(vocab)):
        for i, got in zip(at, ids):
            w = "▁" + words[i]
            assert len(w) == n and ids.shape[2] == min(n, max(map(len, vocab)))
            seen.append(i)
            for j in range(n):
                for m in range(1, ids.shape[2] + 1):
                    want = vocab.get(w[j:j + m], len(vocab) if m == 1 else none) if j + m <= n else none
                    assert got[j, m - 1] == want, (w, j, m)
    assert sorted(seen) == list(range(len(words)))


def test_predicts_held_out_languages(spark):
    r = random.Random(2)
    words = {"en": "the house and with that this from have water light".split(),
             "de": "das haus und mit dass dieser von haben wasser licht".split(),
             "fr": "la maison et avec que cette depuis avoir lumière eau".split()}
    rows = [(i, " ".join(r.choices(words[k], k=20)), k) for i in range(240)
            for k in [list(words)[i % 3]]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 34 ²!", "de"), (None, "das haus", None),
             (903, "x" * 20_000, None), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.fit(docs, PATH, sample=50)
    got = language.predict(docs.withColumn("score", docs.lang), m).collect()
    assert len(got) == len(rows)
    want = {i: k for i, _, k in rows}
    for x in got:
        assert 0 <= x.score <= 1
        if x.doc_id in (900, 901, 902):
            assert (x.lang_pred, x.score) == ("und", 0.0)
        elif x.doc_id is not None and x.doc_id < 900:
            assert x.lang_pred == want[x.doc_id]
    empty = language.fit(docs.limit(0), PATH)
    assert language.predict(docs.limit(2), empty).first().lang_pred == "und"


def test_likelihood_a_letter():
    """The text's likelihood in its best language over its letters; none without letters."""
    vocab = language.vocabulary(PATH)
    m = language.Model(PATH, ["a", "b"], np.random.default_rng(2).random((len(vocab) + 1, 2)) + 0.01)
    langs, _, per = language.Scorer(m).predict(["water river, a2b", "12", None])
    want = m.likelihoods(["water", "river", "a", "b"]).sum(0)
    assert langs == [["a", "b"][int(want.argmax())], "und", "und"]
    assert abs(per[0] - want.max() / 12) < 1e-9 and per[1:] == [None, None]
