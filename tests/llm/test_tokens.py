"""Encoding and counting against the public libraries, and odd inputs."""

import base64
import hashlib
import random
import struct

import public_tokenizers as P
import sentencepiece
import tiktoken

from caseloom.llm import bpe, token_counts

ALPHABET = list("abceglost  \n\n\t.,'!?0123") + ["'s", "'ll", "é", "ß", "▁", "語", "😀", "　",
                                                  "\x85", "\x1c", "<s>", "<|endoftext|>", "the "]


def texts(n, seed=1):
    r = random.Random(seed)
    out = ["", " ", "  ", "\n", " \n ", "a", "x" * 3000, "the " * 2000, "\n\n  b", "a ▁ b"]
    return out + ["".join(r.choices(ALPHABET, k=r.randrange(1, 120))) for _ in range(n)]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in
             map(bytes.split, open(P.path(bpe.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(2000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(2000))
    assert h.slot(b"other") == -1


def test_encode_equals_library():
    c, want = bpe.codec(P.path(bpe.RANKS)), reference()
    for t in texts(600):
        assert list(c.encode(t)) == want.encode_ordinary(t), repr(t)
        assert c.decode(c.encode(t)) == t.encode()


def test_every_code_point_is_split_as_in_the_library():
    c, want = bpe.codec(P.path(bpe.RANKS)), reference()
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for i in range(0, len(points), 500):
        t = "".join("a" + chr(p) + "b" for p in points[i:i + 500])
        if list(c.encode(t)) != want.encode_ordinary(t):
            for p in points[i:i + 500]:
                s = "a" + chr(p) + "b"
                assert list(c.encode(s)) == want.encode_ordinary(s), hex(p)


def test_segments_do_not_change_ids(monkeypatch):
    c = bpe.codec(P.path(bpe.RANKS))
    for t in texts(100, 2):
        whole = list(c.encode(t))
        parts = [list(c.encode(p)) for p in bpe.segments(t, 7)]
        assert sum(parts, []) == whole


def test_counts_equal_library():
    c = token_counts.counter(P.path(token_counts.MODEL))
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(token_counts.MODEL))
    many = texts(800, 3)
    assert c.count(many) == [len(sp.encode(t)) for t in many]
    for t in texts(100, 4):
        assert "".join(token_counts.segments(t, 5)) == t


def test_queries_on_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "hello world", None), (3, "hello world", None),
            (None, "x " * 30000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(docs, P.path(token_counts.MODEL)).collect()
    assert len(got) == 5 and sorted(r.n_bytes for r in got) == [0, 0, 11, 11, 60000]
    assert [r.over_limit for r in got if r.doc_id is None] == [True]
    enc = bpe.encode_column(docs, P.path(bpe.RANKS)).collect()
    want = reference().encode_ordinary("hello world")
    assert [struct.unpack(f"<{len(want)}I", r.ids) for r in enc if r.doc_id == 3] == [tuple(want)] * 2
    assert [bytes(r.ids) for r in enc if r.doc_id in (1, 2)] == [b"", b""]
    none = docs.filter("doc_id > 99")
    assert token_counts.count_tokens(none, P.path(token_counts.MODEL)).count() == 0


def test_digest_columns(spark, tmp_path):
    spark.createDataFrame([(1, "one two", "en", "s", 7)],
                          "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    r = bpe.op6_byte_bpe(spark, str(tmp_path)).first()
    ids = reference().encode_ordinary("one two")
    assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256(b"one two").hexdigest() and r.n_tokens == len(ids)


def test_both_pattern_matchers_agree():
    r = random.Random(9)
    chars = [chr(c) for c in range(0x2030) if not bpe._RARE.match(chr(c))] + ["€"]
    for _ in range(3000):
        t = "".join(r.choices(chars, k=40)) + "".join(r.choices(" \n'ste1a.é", k=40))
        assert bpe._COMMON.findall(t) == bpe._ANY.findall(t), repr(t)
