"""Small column helpers.

Timestamps in a log are ``TIMESTAMP_NTZ`` holding UTC wall-clock time, so no
result depends on the session time zone; working-hour operators convert to a
local zone explicitly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels and separators of the result contract.
ARROW = " → "
START = "__START__"
CASE_END = "__CASE_END__"
END = "__END__"
UNKNOWN = "__UNKNOWN__"
TERMINALS = ("complete", "ate_abort", "withdraw")
LOCAL_ZONE = "Europe/Amsterdam"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_between(start, end) -> Column:
    """Elapsed seconds as a double, with microsecond resolution."""
    micros = F.timestamp_diff("MICROSECOND", col(start), col(end))
    return micros.cast("double") / F.lit(1e6)


def micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def fractional_hour(ts) -> Column:
    ts = col(ts)
    return (F.hour(ts) + F.minute(ts) / F.lit(60.0)
            + F.floor(F.second(ts)) / F.lit(3600.0))


def monday_dow(ts) -> Column:
    """Weekday number with Monday = 0."""
    return F.weekday(col(ts))


def starts_with_any(c, prefixes) -> Column:
    tests = [F.coalesce(col(c), F.lit("")).startswith(p) for p in prefixes]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def has_text(c) -> Column:
    c = col(c)
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def ratio(num, den) -> Column:
    """num / den as a double; null when the denominator is zero or null."""
    num, den = col(num).cast("double"), col(den).cast("double")
    return F.when(den != 0, num / den)


def finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def rounded(df: DataFrame, digits: int = 6, **special) -> DataFrame:
    """Round every double column; ``special`` names a column's own digits."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # + 0.0 turns a negative zero into zero
            c = (F.round(c, special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)


def total(df: DataFrame, expr: Column) -> Column:
    """One aggregate of ``df`` as a scalar-subquery column (no cross join)."""
    return df.agg(expr.alias("v")).scalar()
