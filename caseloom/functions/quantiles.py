"""Exact, linearly interpolated quantiles per group.

Values are counted, ranked with running totals that are split over tasks however large a
group is, and the two order statistics around each quantile are picked out and
interpolated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import along, total_before

#: Splits a double into two halves of 26 bits.
_SPLIT = 134217729.0


def _between(rows: DataFrame, lo: str, hi: str, f: str, name: str) -> DataFrame:
    """Add ``name``: lo * (1 - f) + hi * f, the first product not rounded before it is added.

    So does DuckDB, and a value that lies on a quantile is compared with it: between two equal
    values this may be a last digit above them. The product's rounding error comes from its
    halves, the sum's from the sum.
    """
    p, e, q, s, b = (F.col(f"__{x}") for x in "peqsb")
    rows = rows.withColumns({"__w": 1.0 - F.col(f), "__q": F.col(hi) * F.col(f)})
    for x, y in ((lo, "__x"), ("__w", "__y")):
        rows = rows.withColumn(y, F.col(x) * _SPLIT)
        rows = rows.withColumn(y, F.col(y) - (F.col(y) - F.col(x)))
    x, y = F.col("__x"), F.col("__y")
    rows = rows.withColumns({"__p": F.col(lo) * F.col("__w"), "__u": F.col(lo) - x, "__v": F.col("__w") - y})
    u, v = F.col("__u"), F.col("__v")
    rows = rows.withColumns({"__e": x * y - p + x * v + u * y + u * v, "__s": p + q})
    rows = rows.withColumn("__b", s - p)
    exact = s + ((p - (s - b)) + (q - b) + e)
    return rows.withColumn(name, F.when(F.col(f) == 0, F.col(lo)).when(F.isnan(exact), s).otherwise(exact)) \
        .drop(*[f"__{x}" for x in "wqxypuvesb"])


def quantiles(df: DataFrame, keys: list[str], value: str,
              probs: dict[str, float]) -> DataFrame:
    """keys + one double column per entry of ``probs``; null values are ignored."""
    df = df.select(*keys, F.col(value).cast("double").alias("__v")) \
           .filter(F.col("__v").isNotNull())
    counted = df.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    placed = along(counted, keys, ["__v"], {"__before": total_before("__c")})
    size = placed.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    if keys:
        size = size.select(*[F.col(k).alias(f"__q{i}") for i, k in enumerate(keys)], "__n")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__q{i}"))
        placed = placed.join(size, same)
    else:
        placed = placed.withColumn("__n", size.scalar())
    aggs = []
    for i, (n, p) in enumerate(probs.items()):
        h = F.lit(float(p)) * (F.col("__n") - 1)
        for tag, r in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            inside = (F.col("__before") <= r) & (r < F.col("__before") + F.col("__c"))
            aggs.append(F.max(F.when(inside, F.col("__v"))).alias(f"__{tag}{i}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"__f{i}"))
    out = placed.groupBy(*keys).agg(*aggs)
    for i, n in enumerate(probs):
        out = _between(out, f"__lo{i}", f"__hi{i}", f"__f{i}", f"__r{i}")
    return out.select(*keys, *[F.col(f"__r{i}").alias(n) for i, n in enumerate(probs)])
