"""Quality rules: a threshold table compiled into Spark projections.

Every measure is a built-in expression over one row, so the scan, the measures and
the verdict are one stage without a shuffle and without user functions. Arrays are
compared with shifted copies of themselves (``zip_with``), never indexed inside a
lambda, so the cost is n log n in the words of a text, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import WORD, fresh, query, table

#: Fixed: the symbols that are counted.
SYMBOLS = "#*$%&|<>"

#: Fixed: frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for with on as was at by be this are from or an not "
    "der die das und ist von zu mit den des im ein eine auf für nicht sich auch es dem "
    "le la les des et un une du en est que qui pour dans sur au par avec ce pas "
    "el los las de que y en un una por con para se su del lo como más al").split()

#: A stop word counts in lower case or with a capital at its start.
FORMS = tuple(dict.fromkeys(x for w in STOP_WORDS for x in (w, w.capitalize())))

SPACE = r"[\x20\x09-\x0D]"
BULLETS = ("-", "*", "•")
ELLIPSES = ("...", "…")


@dataclass(frozen=True)
class Rule:
    """``low <= part / whole <= high``; a whole of zero satisfies the rule."""
    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        part, whole = F.col(self.part).cast("double"), F.col(self.whole)
        ok = [F.lit(True)]
        if self.low is not None:
            ok.append(part >= self.low * whole)
        if self.high is not None:
            ok.append(part <= self.high * whole)
        return reduce(lambda a, b: a & b, ok)


#: The threshold table.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("exclamations_per_word", "n_exclaim", "n_words", high=0.5),
    Rule("stop_word_share", "n_stop", "n_words", low=0.02),
    Rule("letter_word_share", "n_letter_words", "n_words", low=0.7),
    Rule("capital_share", "n_capitals", "word_chars", high=0.5),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", high=0.5),
    Rule("bullet_line_share", "n_bullets", "n_lines", high=0.9),
    Rule("ellipsis_line_share", "n_ellipsis", "n_lines", high=0.3),
)


def _pairs(left: Column, right: Column, fn) -> Column:
    return F.zip_with(left, right, fn)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of the rules.

    A null or empty text has no words and no lines: all counts are 0. Rows are
    measured one by one, so repeated rows give repeated results. A column of ``docs``
    that has the name of a count is replaced.

    ``n_repeat_words``: words inside a window of three words that stands two or more
    times in the text. Equal windows are found by sorting 64-bit hashes of a text's
    own windows.
    """
    t, words, hashes, order = fresh(docs, "t", "words", "hashes", "order")
    keep = [c for c in docs.columns if c not in COUNTS]
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(WORD))
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(t))
    df = df.select("*", F.filter(F.split(F.col(t), SPACE + "+"), lambda w: w != "").alias(words),
                   lines.alias("n_lines"))
    n = F.size(words)
    second = F.slice(F.col(words), 2, F.greatest(n, F.lit(1)))
    third = F.slice(F.col(words), 3, F.greatest(n, F.lit(1)))
    two = _pairs(F.col(words), second, lambda a, b: F.xxhash64(a, b))
    three = _pairs(two, third, lambda a, b: F.xxhash64(a, b))
    df = df.select("*", F.slice(three, 1, F.greatest(n - 2, F.lit(0))).alias(hashes))
    # most short texts repeat no window: only the others are sorted
    df = df.select("*", F.when(
        F.size(F.array_distinct(F.col(hashes))) < F.size(hashes),
        F.sort_array(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .alias(order))
    m = F.size(order)       # null if there is nothing to sort
    # neighbours in sorted order with the same hash: both windows are repeated
    twin = _pairs(F.slice(F.col(order), 1, F.greatest(m - 1, F.lit(0))),
                  F.slice(F.col(order), 2, F.greatest(m - 1, F.lit(0))),
                  lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.array_distinct(F.flatten(F.filter(twin, lambda x: x.isNotNull())))
    covered = F.array_distinct(F.flatten(F.transform(
        starts, lambda i: F.array(i, i + 1, i + 2))))
    count = lambda pattern: F.regexp_count(F.col(t), F.lit(pattern)).cast("long")
    some = lambda c, fn: F.size(F.filter(c, fn)).cast("long")      # noqa: E731
    long = lambda c: c.cast("long")     # noqa: E731
    either = lambda test, ends: reduce(lambda a, b: a | b, [test(e) for e in ends])
    return df.select(
        *keep,
        long(n).alias("n_words"),
        (F.length(t) - count(SPACE)).alias("word_chars"),
        count(f"[{SYMBOLS}]").alias("n_symbols"),
        long(F.size("n_lines") - F.size(F.array_distinct("n_lines"))).alias("n_dup_lines"),
        F.coalesce(long(F.size(covered)), F.lit(0).cast("long")).alias("n_repeat_words"),
        count("!").alias("n_exclaim"),
        some(words, lambda w: w.isin(*FORMS)).alias("n_stop"),
        some(words, lambda w: w.rlike(r"\p{L}")).alias("n_letter_words"),
        count(r"\p{Lu}").alias("n_capitals"),
        long(F.size("n_lines")).alias("n_lines"),
        some("n_lines", lambda x: either(F.ltrim(x).startswith, BULLETS)).alias("n_bullets"),
        some("n_lines", lambda x: either(F.rtrim(x).endswith, ELLIPSES)).alias("n_ellipsis"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaim",
          "n_stop", "n_letter_words", "n_capitals", "n_lines", "n_bullets", "n_ellipsis",
          "base_failed", "kept")


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``measures`` plus ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated windows.
    ``kept``: not base_failed, and every rule of the table holds. A null or empty
    text is base_failed.
    """
    m = measures(docs, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = reduce(lambda a, b: a & b, [r.holds() for r in rules], ~failed)
    return m.select("*", failed.alias("base_failed"), good.alias("kept"))


def _sql_rule(r: Rule) -> str:
    parts = []
    if r.low is not None:
        parts.append(f"{r.part}::double >= {r.low} * {r.whole}")
    if r.high is not None:
        parts.append(f"{r.part}::double <= {r.high} * {r.whole}")
    return " and ".join(parts)


def _sql() -> str:
    quoted = ", ".join(f"'{w}'" for w in FORMS)
    return rf"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(t, chr(10)),
            lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
tri as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from
        (select rid, w, unnest(range(1, len(w) - 1)) as i from w)),
rep as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from
        (select rid, i, count(*) over (partition by rid, g) as c from tri) where c > 1) group by rid),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
        coalesce(rep.n, 0)::bigint as n_repeat_words,
        length(regexp_replace(t, '[^!]', '', 'g'))::bigint as n_exclaim,
        len(list_filter(w, lambda x: x in ({quoted})))::bigint as n_stop,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::bigint as n_letter_words,
        length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g'))::bigint as n_capitals,
        len(l)::bigint as n_lines,
        len(list_filter(l, lambda x: ltrim(x)[1] in ('-', '*', '•')))::bigint as n_bullets,
        len(list_filter(l, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$')))::bigint as n_ellipsis
      from w left join rep using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, not base_failed and {" and ".join(_sql_rule(r) for r in RULES)} as kept from f"""


@query("op4_quality_rules", _sql())
def op4_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Counts and verdict for every document."""
    return judge(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")
