"""Toxicity: a weighted lexicon found by one Aho-Corasick pass over folded text.

Folding sends look-alike letters and digit substitutions to plain letters, in the
lexicon and in the text. A text's score is the weight of its hits, damped by the
root of its length, through a logistic curve. Hits inside an exception phrase do not
count. Weights come from labelled documents; a short fixed list stands in where
labels are few.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import staged
from .base import query, table
from .texts import arrow_map, by_bytes, with_columns

#: Labelled documents the lexicon is learned from, at most (about: chosen by hash).
SAMPLE = 30_000
#: Entries of the learned lexicon, at most.
LEXICON = 20_000
SHORTEST, LONGEST = 4, 12       # letters of a learned word beginning
LIFT = 20.0                     # how much likelier in toxic documents
SUPPORT, LEAST = 0.002, 6       # share of toxic documents, and so many of them at least
FOLDS = 5

#: Fixed: insults that count before any label is seen.
SEED = ("idiot moron imbecile stupid loser scum trash pathetic worthless disgusting clown "
        "bastard dummkopf trottel abschaum crétin ordure imbécile estúpido basura").split()
SEED_WEIGHT = 3.0

#: Fixed: phrases in which such a word means no harm.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "circus clown", "clown fish",
              "sore loser", "scum line")

#: Fixed: characters that stand in for another, and what they stand for.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s",
    "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "ı": "i", "ɑ": "a", "ɡ": "g", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t",
    "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
GONE = "­​‌‍⁠﻿"      # invisible characters

TABLE = {**{ord(k): v for k, v in LOOKALIKES.items()}, **dict.fromkeys(map(ord, GONE)),
         **{0xFF41 + i: "i" if i == 11 else chr(97 + i) for i in range(26)}}


def fold(text: str) -> str:
    return text.lower().translate(TABLE)


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    """True for the rows no label of which is used (a null id is not held out)."""
    h = F.crc32(F.col(doc_id).cast("string")) % folds
    return F.coalesce(h == 0, F.lit(False))


@dataclass
class Model:
    """Folded word beginnings and weights; the curve's middle and slope."""
    weights: dict
    exceptions: tuple = EXCEPTIONS
    middle: float = 1.0
    slope: float = 4.0

    def automaton(self):
        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (w, len(term)))
        for p in {fold(x) for x in self.exceptions} - self.weights.keys():
            a.add_word(p, (None, len(p)))
        a.make_automaton()
        return a

    def strength(self, texts: list, automaton=None) -> list[float]:
        """Weight of the hits at word beginnings over sqrt(1 + words / 100)."""
        a = automaton or self.automaton()
        out = []
        for t in texts:
            f = fold(t) if t else ""
            hits, excused = {}, []
            for end, (w, n) in (a.iter(f) if f and len(a) else ()):
                start = end + 1 - n
                if start and f[start - 1].isalnum():
                    continue
                if w is None:
                    excused.append((start, end))
                elif w > hits.get(start, (0.0, 0))[0]:
                    hits[start] = (w, end)
            if excused:     # phrases come in order of their ends
                hits = {s: v for s, v in hits.items()
                        if not any(a0 <= s and v[1] <= b0 for a0, b0 in excused)}
            total = sum(w for w, _ in hits.values())
            out.append(total / math.sqrt(1 + len(f.split()) / 100) if total else 0.0)
        return out

    def score(self, strength: float) -> float:
        z = self.slope * (strength - self.middle)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _beginnings(text: str) -> set:
    out = set()
    for w in set(fold(text).split()):
        w = w.lstrip("\"'([{«¿¡-.,").rstrip(".,;:!?\"')]}»-")
        out.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def _counts(batches):
    """Partial counts of word beginnings in toxic and other documents."""
    toxic, other = Counter(), Counter()
    for b in by_bytes(batches, "text"):
        for t, x in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            (toxic if x else other).update(_beginnings(t or ""))
        if len(toxic) + len(other) > 500_000:
            yield _rows(toxic, other)
            toxic, other = Counter(), Counter()
    yield _rows(toxic, other)


def _rows(toxic, other):
    terms = list(toxic.keys() | other.keys())
    return pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()),
         pa.array([other[t] for t in terms], pa.int64())], ["term", "toxic", "other"])


def _lexicon(rows, n_toxic: int, n_other: int) -> dict:
    """Word beginnings that tell most: the longest of those found in the same documents."""
    chosen: dict = {}
    for term, t, c in sorted(rows, key=lambda r: (-r[1], -len(r[0]), r[0])):
        longer = max((x[1] for k, x in chosen.items() if k.startswith(term)), default=0)
        if longer >= 0.9 * t or any(term.startswith(k) for k in chosen):
            continue
        w = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_other + 1))
        chosen[term] = (w, t)
    return {k: w for k, (w, _) in chosen.items()}


def _curve(model: Model, pairs) -> Model:
    """The middle that separates best; with a gap between the kinds, the gap's middle."""
    pairs = sorted(pairs)
    if len({x for _, x in pairs}) < 2:
        return model
    pos = sum(x for _, x in pairs)
    neg = len(pairs) - pos
    best, cut, p, n = -1.0, model.middle, pos, neg      # p, n: rows above the cut
    for i, (s, x) in enumerate(pairs):
        p, n = p - x, n - (1 - x)
        nxt = pairs[i + 1][0] if i + 1 < len(pairs) else s + 1
        if nxt > s:
            quality = p / pos + (neg - n) / neg
            if quality > best + 1e-12:
                best, cut = quality, (s + nxt) / 2
    model.middle = max(cut, 0.05)
    model.slope = 4 / max(model.middle, 0.25)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled rows that are not held out, at most about ``sample`` of them.

    A document labelled twice is toxic if any label says so; null labels count for
    nothing. Without labels the fixed words remain.
    """
    lab = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                         & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = lab.count()
    if n > sample:
        lab = lab.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * sample / n))
    # bounded by ``sample`` ids: safe to broadcast, and the documents stay where they are
    known = staged(docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")
                   .select("text", F.col("toxic").cast("int").alias("toxic")))
    size = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    n_toxic, n_other = size.get(1, 0), size.get(0, 0)
    model = Model({fold(w): SEED_WEIGHT for w in SEED})
    if not n_toxic or not n_other:
        return model
    terms = (arrow_map(known, _counts, "term string, toxic long, other long")
             .groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("other").alias("c"))
             .filter((F.col("t") >= max(LEAST, SUPPORT * n_toxic))
                     & (F.col("t") / n_toxic >= LIFT * (F.col("c") + 1) / n_other))
             .orderBy(F.col("t").desc(), "term").limit(LEXICON))
    learned = _lexicon([tuple(r) for r in terms.collect()], n_toxic, n_other)
    model.weights = {**{k: v for k, v in model.weights.items()
                        if not any(k.startswith(x) for x in learned)}, **learned}

    def strengths():
        a = model.automaton()
        return lambda texts: [model.strength(texts, a)]
    pairs = with_columns(known, "text", ["toxic"], "s double", strengths).collect()  # bounded
    return _curve(model, [(r.s, r.toxic) for r in pairs])


def score(docs: DataFrame, model: Model, text: str = "text",
          keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null and empty texts have no hit and get the lowest score.
    """
    def make():
        a = model.automaton()
        return lambda texts: [[model.score(s) for s in model.strength(texts, a)]]
    out = with_columns(docs, text, list(keep), "score double", make)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all documents by a lexicon learned from the labels that may be used."""
    docs = table(spark, d, "documents")
    return score(docs, fit(docs, table(spark, d, "labels"))).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted")
