"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash resolves a pre-token that is a vocabulary entry as
it stands: one displacement, one slot, one comparison. Other pre-tokens are merged
with a heap over linked bytes, n log n in their length. Pre-tokens seen lately are
kept in bounded memory.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from array import array
from itertools import chain

import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .base import query, table
from .texts import Memo, with_columns

RANKS = "byte_bpe_multi_50k.tiktoken"
SEGMENT = 1 << 18       # characters
MEMO = 600_000          # entries
LONGEST_KEPT = 64       # characters of a pre-token that is remembered

#: Between a letter and a space before a letter every pre-token ends.
EDGE = regex.compile(r"(?<=\p{L})(?= \p{L})")


def segments(text: str, size: int = SEGMENT):
    """Cut a text where no pre-token crosses, once ``size`` characters are reached."""
    at = 0
    while len(text) - at > size:
        m = EDGE.search(text, at + size)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
#: Anything but ASCII, Latin letters and common punctuation, for which the faster of two
#: pattern matchers knows all classes.
_RARE = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e¡-©«-±´¶-¸»¿-ſ‐-‧€]")
_COMMON = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_ANY = regex.compile(public_tokenizers.PATTERN)


def pretokens(text: str) -> list[str]:
    """The matches of the public pattern."""
    return (_ANY if _RARE.search(text) else _COMMON).findall(text)


class PerfectHash:
    """A minimal perfect hash over fixed keys, by hash and displace.

    Keys are dealt into buckets. Large buckets first, each takes the first displacement
    that sends its keys to free slots; there are as many slots as keys. A bucket of one
    key names a free slot outright (as a negative number).
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // per_bucket)
        groups: dict[int, list[bytes]] = {}
        for k in keys:
            groups.setdefault(xxhash.xxh3_64_intdigest(k) % self.buckets, []).append(k)
        self.shift = array("i", bytes(4 * self.buckets))
        self.slots: list = [None] * n
        lone = []
        for b, group in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(group) == 1:
                lone.append((b, group[0]))
                continue
            d = 0
            while True:
                at = [xxhash.xxh3_64_intdigest(k, d) % n for k in group]
                if len(set(at)) == len(at) and all(self.slots[i] is None for i in at):
                    break
                d += 1
            self.shift[b] = d
            for i, k in zip(at, group):
                self.slots[i] = k
        free = (i for i in range(n) if self.slots[i] is None)
        for (b, k), i in zip(lone, list(free)):
            self.shift[b], self.slots[i] = -i - 1, k

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 if it is not one of the keys."""
        d = self.shift[xxhash.xxh3_64_intdigest(key) % self.buckets]
        i = xxhash.xxh3_64_intdigest(key, d) % self.n if d >= 0 else -d - 1
        return i if self.slots[i] == key else -1


class Codec:
    """Encoder and decoder for a table of byte strings and ranks."""

    def __init__(self, path: str):
        self.ranks = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.hash = PerfectHash(list(self.ranks))
        self.id_at = [self.ranks[k] for k in self.hash.slots]
        self.bytes_of = {r: k for k, r in self.ranks.items()}
        self.memo = Memo(MEMO)

    def merge(self, word: bytes) -> tuple:
        """Ids of a pre-token: the pair of lowest rank merges first, the leftmost of equals."""
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))         # where the part that begins here ends
        before = list(range(-1, n - 1))     # where the part to the left begins
        heap = [(r, i, i + 2) for i in range(n - 1)
                if (r := ranks.get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            mid = end[i]
            # stale if a part has gone or grown since
            if mid <= i or mid >= n or end[mid] != to:
                continue
            end[i], end[mid] = to, -1
            if to < n:
                before[to] = i
                r = ranks.get(word[i:end[to]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            j = before[i]
            if j >= 0:
                r = ranks.get(word[j:to])
                if r is not None:
                    heapq.heappush(heap, (r, j, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i:end[i]]])
            i = end[i]
        return tuple(out)

    def token(self, piece: str) -> tuple:
        word = piece.encode()
        i = self.hash.slot(word)
        return (self.id_at[i],) if i >= 0 else self.merge(word)

    def encode(self, text: str) -> array:
        ids, memo = array("I"), self.memo
        memo.room()
        for part in segments(text):
            pieces = pretokens(part)
            try:
                ids.extend(list(chain.from_iterable(map(memo.__getitem__, pieces))))
                continue
            except KeyError:
                pass
            extra = {}
            for p in set(pieces):
                if p not in memo:
                    (memo if len(p) <= LONGEST_KEPT else extra)[p] = self.token(p)
            get = memo.__getitem__ if not extra else lambda p: extra.get(p) or memo[p]
            ids.extend(list(chain.from_iterable(map(get, pieces))))
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _digests(path):
    def make():
        c = codec(path)

        def run(texts):
            n, ids_hash, back_hash = [], [], []
            for t in texts:
                ids = c.encode(t or "")
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
            return [n, ids_hash, back_hash]
        return run
    return make


def encode_column(docs: DataFrame, path: str, text: str = "text",
                  keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``ids``: the token ids as little-endian unsigned 32-bit integers.

    A null text is encoded as an empty one: no ids. Special tokens do not exist here;
    their strings in a text are ordinary text.
    """
    def make():
        c = codec(path)
        return lambda texts: [[c.encode(t or "").tobytes() for t in texts]]
    return with_columns(docs, text, list(keep), "ids binary", make)


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document and the text decoded from them, as digests."""
    return with_columns(
        table(spark, d, "documents"), "text", ["doc_id"],
        "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        _digests(public_tokenizers.path(RANKS)))
