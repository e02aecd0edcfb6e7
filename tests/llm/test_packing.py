"""Packing: ids against the library, sequences gapless, little padding, odd rows."""

import random
import zlib
from array import array
from collections import Counter

import public_tokenizers as P
from tokenizers import Tokenizer

from caseloom.llm import packing

PATH = P.path(packing.TOKENIZER)


def test_ids_equal_library():
    r, tok, enc = random.Random(3), Tokenizer.from_file(PATH), packing.encoder(PATH)
    parts = list("abcdeilnst  \n\t.'!09") + ["é", "語", "<|endoftext|>", "'s", "the ", "\x85", "\x1c"]
    for t in ["", " ", "<|endoftext|>", "x" * 3000] + ["".join(r.choices(parts, k=r.randrange(1, 90)))
                                                       for _ in range(500)]:
        assert list(enc.encode(t)) == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_every_code_point_is_encoded_as_in_the_library():
    tok, enc = Tokenizer.from_file(PATH), packing.encoder(PATH)
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for i in range(0, len(points), 500):
        t = "".join(f"a{chr(p)}b {chr(p)} 1{chr(p)}" for p in points[i:i + 500])
        assert list(enc.encode(t)) == tok.encode(t, add_special_tokens=False).ids, hex(points[i])


def test_ids_without_an_encoder_by_ranks(monkeypatch):
    monkeypatch.setattr(packing, "_ranked", lambda *_: None)
    slow, fast = packing.Encoder(PATH), packing.encoder(PATH)
    for t in ["", "the river's  town\n", "x" * 500 + " <|endoftext|> é語"]:
        assert slow.encode(t) == fast.encode(t)


def test_patterns_use_every_piece_once():
    r = random.Random(4)
    for _ in range(50):
        counts = dict(Counter(r.choices(range(1, 65), k=r.randrange(1, 300))))
        got = packing.pack_histogram(counts, 64)
        used = Counter()
        for c, content in got:
            assert sum(content) <= 64 and list(content) == sorted(content, reverse=True)
            for size in content:
                used[size] += c
        assert used == counts
    assert packing.pack_histogram({}, 64) == []


def test_sequences(spark):
    tok = Tokenizer.from_file(PATH)
    r = random.Random(6)
    words = "the river town house of green apple and stone".split()
    rows = [(i, " ".join(r.choices(words, k=r.randrange(0, 900))), "x") for i in range(60)]
    rows += [(100, None, "x"), (101, "", "x"), (5, rows[5][1], "x"), (None, "a b", "x"),
             (102, "word " * 9000, "x")] + [(200 + i, "same text here", "x") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    got = packing.pack(docs, PATH, length=256).collect()
    want = {(i, t): tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in rows}
    text = {i: t for i, t, _ in rows}
    covered = Counter()
    for x in got:
        ids = want[x.doc_id, text[x.doc_id]]
        part = ids[x.start:x.start + x.length]
        assert bytes(x.ids) == array("I", part).tobytes()
        assert (x.ids_crc32, x.doc_tokens, len(part)) == (zlib.crc32(bytes(x.ids)), len(ids), x.length)
        covered[x.doc_id] += x.length
    assert covered == Counter({i: len(want[i, t]) * sum(1 for y in rows if y[0] == i)
                               for i, t, _ in rows})
    seqs = {}
    for x in got:
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        assert sum(n for _, n in s) <= 256
    total = sum(covered.values())
    assert len(seqs) * 256 <= 1.05 * total + 256
    assert packing.pack(docs.limit(0), PATH).count() == 0
