"""The corpus pipeline on a small corpus, each stage against what it must do."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from test_near import repeats, shingles

WORDS = {"en": "the house and with that this from have water light river stone".split(),
         "de": "das haus und mit dass dieser von haben wasser licht fluss stein".split()}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    r = random.Random(3)
    rows, labels = [], []
    shared = r.choices(WORDS["en"], k=60)
    for i in range(300):
        lang = "en" if i % 3 else "de"
        w = [x + str(r.randrange(9)) for x in r.choices(WORDS[lang], k=r.randrange(20, 120))]
        w = [x for y in zip(w, r.choices(WORDS[lang], k=len(w))) for x in y]
        toxic = i % 10 == 4
        if toxic:
            w[3] = w[11] = "1diot"
        if i % 25 == 7:
            w[5:5] = shared
        rows.append((i, " ".join(w), lang, f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    for i in range(300, 330):
        w = rows[i - 295][1].split()
        if i % 2:
            w[-1] = "changed"
        rows.append((i, " ".join(w), rows[i - 295][2], "copy", 0))
    rows += [(903, " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(60)), None, "s", 0),
             (904, "Быстрая лиса прыгает через ленивую собаку и бежит домой", None, "s", 0)]
    rows += [(900, None, "en", None, None), (901, "", None, "s", 0), (902, "12 34 !!", "en", "s", 8),
             (5, rows[5][1], rows[5][2], "again", 0)]
    rows = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s, _ in rows]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, corpus).persist()
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["toxicity"]
    assert {x.doc_id for x in before} - {x.doc_id for x in after} == \
        {x.doc_id for x in before if x.text and "1diot" in x.text}
    before, after = seen["language_id"]
    assert {x.doc_id for x in before} - {x.doc_id for x in after} == {900, 901, 902, 903, 904}
    before, after = seen["ngram_jaccard_join"]
    sets = [(x.doc_id, shingles(x.text)) for x in before]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    assert Counter(x.doc_id for x in after) == Counter({find(i) for i in up})
    assert {tuple(x) for x in after} <= {tuple(x) for x in before}
    before, after = seen["substring_dedup"]
    want = repeats([(x.doc_id, x.text) for x in before])
    assert sorted(((x.doc_id, x.text) for x in after), key=str) == sorted(((d, t) for d, _, _, t in want), key=str)
    assert any(n for _, _, n, _ in want) and all(x.n_chars == len(x.text) for x in after)
    before, after = seen["packing"]
    assert {x.doc_id for x in after} == {x.doc_id for x in before}
    assert all(len(x.ids) == 4 * x.length for x in after)


def test_run_equals_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    got = corpus_pipeline.run(spark, corpus)
    show = lambda df: sorted(map(tuple, df.select("doc_id", "start", "ids_crc32").collect()))      # noqa: E731
    assert show(got) == show(docs)


def test_stages_keep_columns_of_any_name(spark, corpus):
    """Columns called like those a stage adds stay as they are."""
    extra = ("score", "predicted", "lang_pred", "n_words", "n_removed", "kept", "class_id", "label")
    docs = spark.read.parquet(f"{corpus}/documents.parquet").selectExpr(
        "*", *[f"concat('{c}', doc_id) as {c}" for c in extra])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus).persist()
        assert docs.columns == columns, name
        assert all(x[c] == f"{c}{x.doc_id}" for x in docs.collect() for c in extra), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, corpus).count()


def test_later_stages_drop_what_a_worker_keeps():
    """The language stage's words and tables do not stay while repeats are looked for."""
    from caseloom.llm import language, near, substrings
    for begin in (lambda: list(substrings._bundle([])), lambda: list(substrings._probe(1, 2, 25)([])),
                  lambda: list(near._sketch(0, [], None)([]))):
        language._SCORERS["model"] = object()
        language.trie(language.public_tokenizers.path(language.VOCABULARY))
        begin()
        assert not language._SCORERS and not language.trie.cache_info().currsize
