"""Language identification by unigrams over a fixed public vocabulary.

Each language has a probability per vocabulary piece, fitted by expectation
maximisation on word counts. A word's likelihood is the sum over all its
segmentations (the forward algorithm); a text's is the product over its words.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import staged
from .base import query, table
from .texts import FORGET, Memo, arrow_map, by_bytes, with_columns

VOCABULARY = "piece_bpe_32k.model"
#: Documents a language is learned from, at most (about: chosen by hash).
SAMPLE = 4_000
ROUNDS = 3
LONGEST_WORD = 48       # letters; longer runs are cut
FLOOR = 1e-7            # probability of a letter or piece never seen
FOLDS, FOLD = 3, 1
MEMO = 300_000          # words
BLOCK = 8_192           # words of one length that are worked on at once
UNKNOWN = "und"

RUNS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    h = F.crc32(F.col(doc_id).cast("string")) % FOLDS
    return F.coalesce(h == FOLD, F.lit(False))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> dict:
    """Lower-case pieces of letters, with or without the mark of a word's beginning."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        body = p.removeprefix("▁")
        if (body.isalpha() and p == p.lower()) or p == "▁":
            out.setdefault(p, len(out))
    return out


def letters(text: str) -> list[str]:
    """Letter runs of a lower-cased text, cut at ``LONGEST_WORD``."""
    out = RUNS.findall(text.lower())
    if max(map(len, out), default=0) > LONGEST_WORD:
        out = [w[i:i + LONGEST_WORD] for w in out for i in range(0, len(w), LONGEST_WORD)]
    return out


class Trie:
    """Prefixes of the pieces as numbered nodes; many nodes take a letter in one step."""

    def __init__(self, pieces: dict):
        alphabet = sorted(set("".join(pieces)))
        self.width = len(alphabet) + 1
        self.code = np.zeros(0x110000, np.int64)        # 0: a letter of no piece
        self.code[[ord(c) for c in alphabet]] = range(1, self.width)
        nodes, edges, self.longest = {"": 0}, {}, max(map(len, pieces))
        for p in pieces:
            for m in range(1, len(p) + 1):
                if p[:m] not in nodes:
                    nodes[p[:m]] = len(nodes)
                    edges[nodes[p[:m - 1]] * self.width + int(self.code[ord(p[m - 1])])] = nodes[p[:m]]
        self.keys = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.full(len(nodes), -1, np.int32)
        for p, i in pieces.items():
            self.piece[nodes[p]] = i

    def codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes that the letters lead to, 0 where no piece goes on so."""
        key = node * self.width + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], 0)


@functools.lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    return Trie(vocabulary(path))


def _lattice(words: list[str], pieces: Trie, letter: int):
    """Per length: the words' places and, for each start and piece length, the piece id.

    Id ``letter`` is a letter outside the vocabulary, ``letter + 1`` no piece. Words come
    in blocks, so that memory is bounded.
    """
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w) + 1].append(i)
    for n, every in groups.items():
        for s in range(0, len(every), BLOCK):
            at = every[s:s + BLOCK]
            codes = pieces.codes("".join("▁" + words[i] for i in at)).reshape(len(at), n)
            ids = np.full((len(at), n, min(n, pieces.longest)), letter + 1, dtype=np.int32)
            ids[:, :, 0] = letter
            row, start = (x.ravel() for x in np.indices(codes.shape))
            node = np.zeros(len(row), np.int64)
            for m in range(ids.shape[2]):
                node = pieces.step(node, codes[row, start + m])
                piece = pieces.piece[node]
                has = piece >= 0
                ids[row[has], start[has], m] = piece[has]
                alive = (node > 0) & (start + m + 1 < n)
                row, start, node = row[alive], start[alive], node[alive]
            yield n, np.array(at), ids


def forward(ids: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Sums over segmentations up to each place: (words, n + 1, languages)."""
    w, n, k = ids.shape
    a = np.zeros((w, n + 1, probs.shape[1]))
    a[:, 0] = 1.0
    for j in range(n):
        for m in range(1, min(k, n - j) + 1):
            a[:, j + m] += a[:, j] * probs[ids[:, j, m - 1]]
    return a


def backward(ids, probs):
    w, n, k = ids.shape
    b = np.zeros((w, n + 1, probs.shape[1]))
    b[:, n] = 1.0
    for j in range(n - 1, -1, -1):
        for m in range(1, min(k, n - j) + 1):
            b[:, j] += b[:, j + m] * probs[ids[:, j, m - 1]]
    return b


class Model:
    """Languages and probabilities: one row per piece, letter row, row of zeros."""

    def __init__(self, path: str, langs: list[str], counts: np.ndarray | None = None):
        self.path, self.langs = path, langs
        size = len(vocabulary(path))
        if counts is None:      # before the first round: all pieces alike
            counts = np.ones((size + 1, len(langs)))
        p = counts / np.maximum(counts.sum(0, keepdims=True), 1e-300)
        self.probs = np.vstack([np.maximum(p, FLOOR), np.zeros((1, len(langs)))])

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        for n, at, ids in _lattice(words, trie(self.path), len(self.probs) - 2):
            out[at] = np.log(np.maximum(forward(ids, self.probs)[:, n], 1e-300))
        return out

    def expected(self, words: list[str], lang: int, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in so many occurrences of the words."""
        p = self.probs[:, lang:lang + 1]
        total = np.zeros(len(self.probs))
        for n, at, ids in _lattice(words, trie(self.path), len(self.probs) - 2):
            a, b = forward(ids, p)[..., 0], backward(ids, p)[..., 0]
            scale = counts[at] / np.maximum(a[:, n], 1e-300)
            for j in range(n):
                for m in range(1, min(ids.shape[2], n - j) + 1):
                    use = a[:, j] * p[ids[:, j, m - 1], 0] * b[:, j + m] * scale
                    total += np.bincount(ids[:, j, m - 1], use, len(total))
        return total[:-1]


class Scorer:
    """Scores texts; likelihoods of words seen lately are kept in bounded memory.

    A word's row holds its log-likelihood in each language and its number of letters.
    """

    def __init__(self, model: Model):
        self.model, self.memo = model, Memo(MEMO)
        self.table, self.used = np.zeros((1024, len(model.langs) + 1)), 1

    def _rows(self, words: list[str]) -> np.ndarray:
        return np.column_stack([self.model.likelihoods(words), np.fromiter(map(len, words), float, len(words))])

    def _add(self, rows: np.ndarray):
        end = self.used + len(rows)
        if end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(end, len(self.table)), rows.shape[1]))])
        self.table[self.used:end] = rows
        self.used = end

    def _learn(self, new: list[str]):
        alpha = [w for w in new if w.isalpha()]
        for w in new:       # a run that holds other signs counts by its letters, if any
            if not w.isalpha():
                rest = "".join(c for c in w if c.isalpha())
                if rest:
                    self._add(self._rows([rest]))
                self.memo[w] = self.used - 1 if rest else 0
        self.memo.update(zip(alpha, range(self.used, self.used + len(alpha))))
        self._add(self._rows(alpha))

    def predict(self, texts: list) -> list[list]:
        if len(self.memo) > self.memo.limit:
            self.memo.clear()
            self.used = 1
        split = [letters(t) if t else [] for t in texts]
        new = [w for w in set().union(*split) if w not in self.memo] if split else []
        if new:
            self._learn(new)
        langs, scores, letter = [], [], []
        for words in split:
            at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
            if not at.any() or not self.model.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                letter.append(None)
                continue
            total = self.table[at].sum(0)
            total, size = total[:-1], total[-1]
            best = int(total.argmax())
            langs.append(self.model.langs[best])
            scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            letter.append(float(total[best] / size))
        return [langs, scores, letter]


_SCORERS: dict = {}


FORGET += [_SCORERS.clear, vocabulary.cache_clear, trie.cache_clear]


def scorer(model: Model) -> Scorer:
    """The scorer of a model in this worker process: its words serve later tasks, too."""
    key = (model.path, tuple(model.langs), hashlib.sha256(model.probs.tobytes()).digest())
    if key not in _SCORERS:
        _SCORERS.clear()        # one model at a time: bounded memory
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def _word_counts(batches):
    seen: Counter = Counter()

    def rows():
        keys = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([seen[k] for k in keys], pa.int64())], ["lang", "word", "n"])
    for b in by_bytes(batches, "text"):
        for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            seen.update((lang, w) for w in letters(t) if w.isalpha())
        if len(seen) > 300_000:
            yield rows()
            seen.clear()
    yield rows()


def fit(docs: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Learn from rows with text and language that are not held out.

    Each language is learned from about ``sample`` documents at most. Ties between
    languages go to the first in alphabetical order.
    """
    known = docs.select("doc_id", "text", "lang").filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
        & ~held_out())
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    model = Model(path, langs)
    if not langs:
        return model
    share = F.create_map(*[F.lit(x) for k in langs
                           for x in (k, min(1_000_000, int(1e6 * sample / sizes[k]) + 1))])
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")])
    words = staged(arrow_map(known.select("text", "lang"), _word_counts,
                             "lang string, word string, n long")
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    index = {k: i for i, k in enumerate(langs)}
    size = len(model.probs) - 1
    for _ in range(rounds):
        now = model

        def expect(batches):
            total = np.zeros((size, len(langs)))
            for b in batches:
                lang = b.column("lang").to_pylist()
                text, n = b.column("word").to_pylist(), b.column("n").to_numpy()
                for name in set(lang):
                    at = [i for i, x in enumerate(lang) if x == name]
                    total[:, index[name]] += now.expected([text[i] for i in at], index[name], n[at])
            piece, col = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece.astype(np.int32)), pa.array(col.astype(np.int32)),
                 pa.array(total[piece, col])], ["piece", "col", "n"])
        # a row per piece and language: bounded by the vocabulary
        got = (arrow_map(words, expect, "piece int, col int, n double")
               .groupBy("piece", "col").agg(F.sum("n").alias("n")).toPandas())
        counts = np.zeros((size, len(langs)))
        counts[got["piece"].to_numpy(), got["col"].to_numpy()] = got["n"].to_numpy()
        model = Model(path, langs, counts)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text",
            keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``lang_pred``, ``score``, the posterior of that language, and
    ``per_letter``, the log-likelihood of the text in it, a letter.

    Texts that are null or hold no letter get ``und``, score 0 and no ``per_letter``.
    """
    def make():
        return scorer(model).predict
    return with_columns(docs, text, list(keep), "lang_pred string, score double, per_letter double", make)


@query("op10_language_id")
def op10_language_id(spark: SparkSession, d: str) -> DataFrame:
    """Language of all documents."""
    docs = table(spark, d, "documents")
    return predict(docs, fit(docs, public_tokenizers.path(VOCABULARY))).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
