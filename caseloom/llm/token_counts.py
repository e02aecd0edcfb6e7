"""Token counts of whole texts under a sentencepiece vocabulary.

Arrow batches are cut by bytes; a text is split at boundaries no token can cross, so
a very long text is worked through in segments. Equal pieces of a batch are encoded
once, in one call to the library, and only lengths come back.
"""

from __future__ import annotations

import functools
import re

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import query, table
from .texts import Memo, with_columns

MODEL = "piece_bpe_32k.model"
LIMIT = 4096            # tokens
SEGMENT = 1 << 18       # characters
MEMO = 400_000          # entries

#: A run of spaces with what follows, the start of a line, or a line feed. No piece of
#: the vocabulary holds a line feed, or a space after another character.
PIECES = re.compile("[ ▁]+[^ ▁\n]*|\n[^ ▁\n]*|[^ ▁\n]+")
EDGE = re.compile("(?<=[^ ▁\n])(?=[ ▁\n])")


def segments(text: str, size: int = SEGMENT):
    """Cut a text behind a word once ``size`` characters are reached."""
    at = 0
    while len(text) - at > size:
        m = EDGE.search(text, at + size)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


class Counter:
    """Counts tokens; the lengths of pieces seen are kept in bounded memory."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if "\n" in piece or re.search("[^▁]▁", piece):
                raise ValueError(f"this vocabulary has a piece across a boundary: {piece!r}")
        self.memo = Memo(MEMO)

    def _learn(self, new: list[str]):
        # a piece that begins with a space stands behind the space that the library adds;
        # one that begins with a line feed has that space and the feed too much
        asked = [p[1:] if p[0] in " ▁" else p for p in new]
        for p, ids in zip(new, self.model.encode(asked, num_threads=1)):
            self.memo[p] = len(ids) - 1 if p[0] == "\n" else len(ids) if len(p) > 1 else 1

    def count(self, texts: list) -> list[int]:
        self.memo.room()
        out = []
        for t in texts:
            n = 0
            if t:
                for part in segments(" " + t):
                    pieces = PIECES.findall(part)
                    try:
                        n += sum(map(self.memo.__getitem__, pieces))
                    except KeyError:
                        self._learn([p for p in set(pieces) if p not in self.memo])
                        n += sum(map(self.memo.__getitem__, pieces))
            out.append(n)
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple = ("doc_id",),
                 limit: int = LIMIT) -> DataFrame:
    """``keep`` plus ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` per row.

    Tokens are those the library gives for the whole text, without begin and end tokens.
    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each.
    """
    def make():
        c = counter(path)
        return lambda texts: [[len(t.encode()) if t else 0 for t in texts], c.count(texts)]

    out = with_columns(docs, text, list(keep), "n_bytes bigint, n_tokens bigint", make)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, d, "documents"), public_tokenizers.path(MODEL))
