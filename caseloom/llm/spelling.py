"""Spelling variants: words one edit apart, found by pivotal grams.

A word's bigrams are put into one global order, rare ones first; its prefix is the three
rarest (and further places of the third). Of the prefix two disjoint bigrams, the left
and the right pivot, are chosen by dynamic programming so that their frequencies sum up
to the least. One edit spoils at most one of two disjoint bigrams, so of two words one
edit apart, the one whose prefix ends first has a pivot that the other has in its prefix.

Position limits make that a plain equi-join. An edit right of the left pivot leaves
everything up to that pivot in place; an edit left of the right pivot leaves everything
from that pivot on in place. The other end of the word has the edit either in its first
or in its second half, so one half of it is in place, too. A key is the hash of the
equal end, the equal half and the other word's length: pivots ask for lengths l - 1, l
and l + 1, prefixes are filed under their own.

Keys that very many words share (``CROWDED``) are not joined word by word but on the
words with one letter left out, where only words that are really near meet. All candidates
are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import sized, staged
from .base import query, table
from .texts import arrow_map, by_bytes

WORD = "[A-Za-zÀ-ÿ]+"     # fixed: a word is a longest run of these
SLOTS = 1 << 16                     # bigrams are counted in so many slots
CROWDED = 256                       # words filed under a key, from which it is crowded
HELD = 150_000                      # words a task counts before it hands them on

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _lower(w: str) -> str:
    return w.lower() if w.isascii() else w.translate(_LOWER)


def _count(pattern: str, least: int, change):
    def run(batches):
        find = re.compile(pattern).findall
        held: Counter = Counter()

        def told():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()),
                                              pa.array(list(held.values()), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out
        for b in by_bytes(batches, "text"):
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if not t:
                    continue
                own: dict = {}
                for w, n in Counter(find(t)).items():
                    if len(w) >= least:
                        w = _lower(w)
                        own[w] = own.get(w, 0) + n
                for w, n in own.items():
                    w = change(i, w) if change else w
                    if len(w) >= least:
                        held[w] += n
                if len(held) > HELD:
                    yield told()
        if held:
            yield told()
    return run


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", pattern: str = WORD,
                least: int = 7, change=None) -> DataFrame:
    """(word, n): how often each word of at least ``least`` letters occurs.

    A to Z are lower-cased, other letters stay. ``change(id, word)``, if given, makes
    another word of a document's word. Null and empty texts have no words.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return arrow_map(rows, _count(pattern, least, change), "word string, n bigint") \
        .groupBy("word").agg(F.sum("n").alias("n"))


def _slot(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram.encode()) % SLOTS


def _slots(batches):
    """How many words have a bigram in each slot, by batch."""
    memo: dict = {}
    for b in batches:
        seen = np.zeros(SLOTS, np.int64)
        for w in b.column("word").to_pylist():
            for g in {w[i:i + 2] for i in range(len(w) - 1)}:
                s = memo.get(g)
                if s is None:
                    if len(memo) > SLOTS:
                        memo.clear()
                    s = memo[g] = _slot(g)
                seen[s] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["slot", "n"])


def prefix(grams: list, order: dict) -> list[int]:
    """Places of the three first bigrams in the order, with all places of the third."""
    first = sorted(range(len(grams)), key=lambda i: (order[grams[i]], i))
    end = order[grams[first[min(2, len(first) - 1)]]]
    return [i for i in first if order[grams[i]] <= end]


def pivots(places: list[int], weight) -> tuple[int, int] | None:
    """Two places at least 2 apart with the least sum of weights; None if there are none.

    By place: the best pair is the place itself and the best of those 2 or more to its left.
    """
    best, left, pair = None, None, None
    places = sorted(places)
    behind = 0
    for p in places:
        while places[behind] <= p - 2:
            w = weight(places[behind])
            if left is None or w < left[0]:
                left = (w, places[behind])
            behind += 1
        if left is not None:
            w = left[0] + weight(p)
            if best is None or w < best:
                best, pair = w, (left[1], p)
    return pair


def _half(rest: str, length: int) -> tuple[str, str]:
    """The first half of ``rest`` and its second half, cut as a rest of ``length`` is."""
    return rest[:length // 2], rest[len(rest) - (length - length // 2):]


_hash = xxhash.xxh3_64_intdigest


def _key(side: str, half: str, length: int, same: str, part: str) -> int:
    return _hash(f"{side}{half}{length} {len(same)} {same}{part}".encode()) - (1 << 63)


def filed_keys(word: str, places: list[int]) -> set[int]:
    """Keys a word is filed under, by its prefix."""
    out, n = set(), len(word)
    for p in places:
        for side, same, rest in (("l", word[:p + 2], word[p + 2:]), ("r", word[p:], word[:p])):
            a, b = _half(rest, len(rest))
            out.add(_key(side, "a", n, same, a))
            out.add(_key(side, "b", n, same, b))
    return out


def asked_keys(word: str, pair: tuple[int, int]) -> set[int]:
    """Keys a word asks for, by its pivots: for other words of lengths l - 1, l, l + 1."""
    out, n = set(), len(word)
    left, right = pair
    for side, same, rest in (("l", word[:left + 2], word[left + 2:]), ("r", word[right:], word[:right])):
        for d in (-1, 0, 1):
            length = len(rest) + d
            if length < 0:
                continue
            first, second = length // 2, length - length // 2
            if first <= len(rest):
                out.add(_key(side, "a", n + d, same, rest[:first]))
            if second <= len(rest):
                out.add(_key(side, "b", n + d, same, rest[len(rest) - second:]))
    return out


def _keys(counts: dict):
    """Per word: (key, word, n, asks), filed and asked."""
    def run(batches):
        memo: dict = {}

        def place(g):
            o = memo.get(g)
            if o is None:
                if len(memo) > SLOTS:
                    memo.clear()
                s = _slot(g)
                o = memo[g] = (counts.get(s, 0), s, g)
            return o
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                key, row, asks = [], [], []
                for r, w in enumerate(part.column("word").to_pylist()):
                    grams = [w[i:i + 2] for i in range(len(w) - 1)]
                    order = {g: place(g) for g in set(grams)}
                    places = prefix(grams, order)
                    pair = pivots(places, lambda p: order[grams[p]][0])
                    filed, asked = filed_keys(w, places), asked_keys(w, pair)
                    key += filed
                    key += asked
                    row += [r] * (len(filed) + len(asked))
                    asks += [False] * len(filed) + [True] * len(asked)
                at_rows = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pc.take(part.column("word"), at_rows),
                     pc.take(part.column("n"), at_rows), pa.array(asks, pa.bool_())],
                    names=["key", "word", "n", "asks"])
    return run


def _one_out(w) -> F.Column:
    """(place, word without the letter there) of every place, and (0, word) itself."""
    places = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.struct(
        i.alias("place"), F.concat(F.substring(w, F.lit(1), i - 1),
                                   F.substring(w, i + 1, F.length(w))).alias("rest")))
    return F.concat(F.array(F.struct(F.lit(0).alias("place"), w.alias("rest"))), places)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), each pair of words one edit apart in both directions.

    ``words`` has columns word (distinct, at least 4 letters) and n.
    """
    words = staged(words.select("word", "n"))
    # at most SLOTS rows, whatever the words
    counts = {r[0]: r[1] for r in arrow_map(words.select("word"), _slots, "slot bigint, n bigint")
              .groupBy("slot").agg(F.sum("n")).collect()}
    keys = staged(arrow_map(words, _keys(counts), "key bigint, word string, n bigint, asks boolean"))
    filed = keys.filter("not asks")
    crowded = staged(filed.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
                     .filter(F.col("k") > CROWDED).select("key"))
    other = filed.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    asked = keys.filter("asks").select("key", "word", "n")
    met = asked.join(crowded, "key", "left_anti").join(other.join(crowded, "key", "left_anti"), "key")
    # in a crowded key: b lacks a letter of a, or a one of b, or both lack one at one place
    a = asked.join(crowded, "key", "left_semi").withColumn("v", F.explode(_one_out(F.col("word"))))
    b = other.join(crowded, "key", "left_semi").withColumn("v", F.explode(_one_out(F.col("other"))))
    a = a.select("key", "word", "n", F.col("v.rest").alias("rest"), F.col("v.place").alias("place"))
    b = b.select("key", "other", "other_n", F.col("v.rest").alias("rest"), F.col("v.place").alias("other_place"))
    kind = F.col("place")
    a = a.withColumn("kinds", F.when(kind == 0, F.array(F.lit(-1))).otherwise(F.array(F.lit(0), kind)))
    b = b.withColumn("kinds", F.when(F.col("other_place") == 0, F.array(F.lit(0)))
                     .otherwise(F.array(F.lit(-1), F.col("other_place"))))
    dense = a.withColumn("kind", F.explode("kinds")).join(
        b.withColumn("kind", F.explode("kinds")), ["key", "rest", "kind"])
    cols = ("word", "n", "other", "other_n")
    found = met.select(*cols).union(dense.select(*cols)).filter(
        (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    both = found.select(F.explode(F.array(
        F.struct(*[F.col(c) for c in cols]),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"),
                 F.col("n").alias("other_n")))).alias("p")).select("p.*")
    return both.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain word, its form, its form's form, and so on.

    ``forms`` has columns word and form; chains have no cycles. Each round doubles the
    way that is looked ahead.
    """
    at = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(at.join(ahead, "root", "left")
                      .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def group(words: DataFrame, times: int = 10) -> DataFrame:
    """word, n, form, root, n_near, form_n of every row of ``words`` (word, n).

    Two words are near if one inserted, deleted or replaced letter makes one the other. A
    word's form is the near word of the largest n, of equal ones the first in code-point
    order, if that n is at least ``times`` times its own; else null. The root is where
    the forms end, the word itself if it has none. Other columns of ``words`` are left
    out; null words and words of under 4 letters take no part, and of rows that repeat a
    word the largest n counts. ``times`` is above 1, so that forms make no circles.
    """
    words = sized(words.filter(F.length("word") >= 4).groupBy("word").agg(F.max("n").alias("n")), 0)
    near = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.max("n").alias("n"),
        F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("w"))).alias("best"))
    enough = -F.col("best.less") >= F.lit(times) * F.col("n")
    near = staged(near.select("word", "n_near", F.when(enough, F.col("best.w")).alias("form"),
                              F.when(enough, -F.col("best.less")).alias("form_n")))
    ends = roots(near.filter("form is not null"))
    return words.join(near, "word", "left").join(ends, "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def with_slips(one_in: int):
    """A change that deletes a letter of about one in ``one_in`` words, by (id, word)."""
    def change(i, w):
        h = zlib.crc32(f"{i}:{w}".encode())
        if i is None or h % one_in:
            return w
        k = h % len(w)
        return w[:k] + w[k + 1:]
    return change


@query("op13_spelling_variants", r"""
with recursive t as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),
o as (select doc_id, w, count(*) as n from t where length(w) >= 7 group by all),
h as (select doc_id, w, n, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
        string_split(doc_id::varchar || ':' || w, ''), lambda c: case when unicode(c) < 128
        then [unicode(c)::bigint] else [(192 + unicode(c) // 64)::bigint, (128 + unicode(c) % 64)::bigint] end))),
    lambda x, b: list_reduce([xor(x, b), 1, 2, 3, 4, 5, 6, 7, 8],
        lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) as h from o),
c as (select case when h % 31 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2)
    else w end as word, n from h),
words as (select word, sum(n)::bigint as n from c where length(word) >= 7 group by word having sum(n) >= 2),
d as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as v from
    (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (select a.word, a.n, b.word as other, b.n as other_n from d a join d b
        on a.i = b.i and a.v = b.v and a.word <> b.word
    union select a.word, a.n, b.word, b.n from d a join words b on a.v = b.word
    union select b.word, b.n, a.word, a.n from d a join words b on a.v = b.word),
best as (select word, count(*) as n_near, any_value(n) as n,
    min(struct_pack(less := -other_n, w := other)) as m from near group by word),
f as (select word, n_near, case when -m.less >= 10 * n then m.w end as form,
    case when -m.less >= 10 * n then -m.less end as form_n from best),
chain as (select word, form as root, 1 as step from f where form is not null
    union all select c.word, f.form, step + 1 from chain c join f on f.word = c.root where f.form is not null),
ends as (select word, arg_max(root, step) as root from chain group by word)
select word, n, form, coalesce(root, word) as root, coalesce(n_near, 0)::bigint as n_near,
    form_n::bigint as form_n
from words left join f using (word) left join ends using (word)""")
def op13_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    """Forms and roots of the frequent long words, with a slip in about one of 31."""
    words = count_words(table(spark, d, "documents"), change=with_slips(31))
    return group(words.filter("n >= 2"))
