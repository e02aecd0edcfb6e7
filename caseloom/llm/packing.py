"""Packing token sequences: shortest-pack-first over the histogram of lengths.

Texts are tokenised once. A text longer than a sequence is cut into full sequences and
a rest; the rests' lengths are counted, packed as counts (longest first, each into the
emptiest open pack), and the resulting patterns are dealt back to the pieces by their
rank among the pieces of that length. Only the histogram, one row per length, is on
the driver.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.staging import staged
from .base import query, table
from .bpe import segments
from .texts import arrow_map, by_bytes

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 2048
END = 1                 # the id behind each document


def _ranked(tok: tokenizers.Tokenizer, model: dict, special: dict) -> tiktoken.Encoding | None:
    """An encoder by ranks that gives the ids of ``tok``, or None if there is none.

    Merging by the order of merges and by the ids of what they make is the same if ids
    rise with the merges and each entry is what its own bytes merge to: until an entry's
    turn comes, its bytes have then merged to the one pair that makes it, in any text.
    """
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                     "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if odd or any(x >= y for x, y in zip(made, made[1:])) \
            or any(len(tok.model.tokenize(a + b)) != 1 for a, b in merges):
        return None
    # the public byte alphabet: printable bytes stand for themselves, the others follow from 256
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of.update((chr(256 + i), b) for i, b in enumerate(sorted(set(range(256)) - set(plain))))
    ranks = {bytes(map(byte_of.__getitem__, w)): i for w, i in model["vocab"].items() if w not in special}
    if len(ranks) != len(merges) + 256:
        return None
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


class Encoder:
    """Ids as the tokenizers library gives them, by a faster encoder where it gives the same.

    Special tokens in a text are recognised, as by the library's default. Long texts are
    encoded in segments.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tok = tokenizers.Tokenizer.from_file(path)
        spec = json.loads(tok.to_str())
        pre = spec["pre_tokenizer"]
        if (spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]
                or not pre["use_regex"]):
            raise ValueError("texts of this tokenizer cannot be split before encoding")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") \
            if self.special else None
        ranked = _ranked(tok, spec["model"], self.special)
        self.ids = ranked.encode_ordinary if ranked else \
            lambda text: tok.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> array:
        ids = array("I")
        for part in (self.cut.split(text) if self.cut else [text]):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for s in segments(part):
                    ids.extend(self.ids(s))
        return ids


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, text: str = "text", keep: tuple = ("doc_id",),
           length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: ``keep``, start, length, ids (binary), ids_crc32, doc_tokens.

    ``part`` and ``place`` number the pieces of each length within one input partition.
    A null or empty text is the end id alone.
    """
    keep = list(keep)
    fields = "start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, part int, place bigint"
    schema = T.StructType([docs.schema[k] for k in keep] + T.StructType.fromDDL(fields).fields)
    names = [f.name for f in schema.fields]

    def run(batches):
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for b in by_bytes(batches, "__text"):
            row, start, size, ids, crc, total, place = [], [], [], [], [], [], []
            for i, t in enumerate(b.column("__text").to_pylist()):
                doc = enc.encode(t or "")
                doc.append(end)
                for s in range(0, len(doc), length):
                    raw = doc[s:s + length].tobytes()
                    n = len(raw) // 4
                    row.append(i)
                    start.append(s)
                    size.append(n)
                    ids.append(raw)
                    crc.append(zlib.crc32(raw))
                    total.append(len(doc))
                    place.append(seen[n])
                    seen[n] += 1
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(k).take(at) for k in range(len(keep))]
                + [pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                   pa.array(ids, pa.binary()), pa.array(crc, pa.int64()),
                   pa.array(total, pa.int64()), pa.array([part] * len(row), pa.int32()),
                   pa.array(place, pa.int64())], names=names)

    return arrow_map(docs.select(*keep, F.col(text).alias("__text")), run, schema)


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple]]:
    """(number of sequences, lengths in them) for each pattern.

    Lengths go longest first; each piece goes to the pack with the least in it, a new
    one if none has room. Packs with the same content are one entry with a count.
    """
    room: dict[int, list] = defaultdict(list)      # free places -> [count, content] entries
    widest: list[int] = []
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            widest = max((g for g, e in room.items() if e), default=0)
            if widest < size:
                room[length - size].append([n, (size,)])
                break
            entry = room[widest].pop()
            k = min(n, entry[0])
            n -= k
            room[widest - size].append([k, entry[1] + (size,)])
            if entry[0] > k:
                room[widest].append([entry[0] - k, entry[1]])
    merged: Counter = Counter()
    for entries in room.values():
        for c, content in entries:
            merged[content] += c
    return sorted(((c, p) for p, c in merged.items()), key=lambda x: x[1], reverse=True)


def slots(patterns: list[tuple[int, tuple]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, pieces per sequence, offset)."""
    out, used, base = defaultdict(list), Counter(), 0
    for count, content in patterns:
        at = 0
        for size, m in sorted(Counter(content).items(), reverse=True):
            out[size].append((used[size], base, m, at))
            used[size] += count * m
            at += size * m
        base += count
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(docs: DataFrame, path: str, text: str = "text", keep: tuple = ("doc_id",),
         length: int = LENGTH, end: int = END, ids: bool = True) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every id is in exactly one piece.

    Pieces of a sequence fill it gapless from offset 0, longest first. ``ids`` keeps the
    ids themselves.
    """
    made = pieces(docs, path, text, keep, length, end)
    made = staged(made if ids else made.drop("ids"))
    per_part = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = staged(per_part.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))))
    # a row per length: bounded by the length of a sequence
    counts = {r.length: r.n for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(pack_histogram(counts, length))
    ranked = made.join(before.select("length", "part", "before"), ["length", "part"])
    columns = [*keep, "start", "length", *(["ids"] if ids else []), "ids_crc32", "doc_tokens"]
    ranked = ranked.select(*columns, (F.col("place") + F.col("before")).alias("rank"))
    schema = T.StructType(ranked.schema.fields[:-1] + T.StructType.fromDDL(
        "sequence_id bigint, offset bigint").fields)

    def run(batches):
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                s = where[int(n)]
                e = s[np.searchsorted(s[:, 0], rank[at], side="right") - 1]
                r = rank[at] - e[:, 0]
                seq[at] = e[:, 1] + r // e[:, 2]
                off[at] = e[:, 3] + r % e[:, 2] * n
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(seq), pa.array(off)], names=schema.names)

    return arrow_map(ranked, run, schema)


@query("op8_packing")
def op8_packing(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return pack(table(spark, d, "documents"), public_tokenizers.path(TOKENIZER), ids=False)
