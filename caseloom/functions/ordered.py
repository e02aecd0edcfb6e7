"""Ordered computations that survive a hot key.

``along`` adds lead/lag, row numbers and running values over ``keys`` ordered by
``order``: a plain window, which Catalyst shuffles and sorts once for all steps over the
same keys and order. Keys with more rows than their share of a partition (``crowded``:
there can be no more of them than partitions) are cut instead: their rows are range-split
on keys *and* the whole order, tie-breaker included, so a burst, a tie or an outlier fills
no block; the window runs inside (keys, block), and one summary row per block carries
values across. A block has at most the keys that begin in it and one that goes on, so
the summary has at most two rows a block and is broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .columns import col
from .staging import staged


#: Rows that one task orders without being cut, at least.
LEAST = 1 << 17


@dataclass(frozen=True)
class Step:
    kind: str
    value: Column | None = None
    before: bool = False


def nth() -> Step:
    """Row number from 0."""
    return Step("nth")


def following(c) -> Step:
    """Value of the next row."""
    return Step("following", col(c))


def preceding(c) -> Step:
    """Value of the previous row."""
    return Step("preceding", col(c))


def total_upto(c) -> Step:
    """Running sum including this row."""
    return Step("total", col(c))


def total_before(c) -> Step:
    """Running sum of the earlier rows (0 on the first row)."""
    return Step("total", col(c), True)


def latest_upto(c) -> Step:
    """Last non-null value including this row."""
    return Step("latest", col(c))


def latest_before(c) -> Step:
    """Last non-null value of the earlier rows."""
    return Step("latest", col(c), True)


def lowest_upto(c) -> Step:
    """Running minimum including this row."""
    return Step("lowest", col(c))


def lowest_before(c) -> Step:
    """Running minimum of the earlier rows."""
    return Step("lowest", col(c), True)


def highest_upto(c) -> Step:
    """Running maximum including this row."""
    return Step("highest", col(c))


def in_blocks(df: DataFrame, keys: list[str], order: list[str],
              blocks: int | None = None) -> DataFrame:
    """``df`` with ``__b``, the block of a range split on keys and order, written once."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *keys, *order)
                  .withColumn("__b", F.spark_partition_id()))


_WORK = re.compile(r"^[\s:+-]*(Join|Aggregate|Window|Repartition|RebalancePartitions|Distinct|Sort|"
                   r"Map\w+|FlatMap\w+|ArrowEvalPython)\b", re.M)


def settled(df: DataFrame) -> DataFrame:
    """``df`` if it is read, filtered and projected only; else written once and read back."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return staged(df) if _WORK.search(plan) else df


def crowded(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int] | None:
    """The keys with over twice a partition's mean share of the rows, and how many blocks
    they are cut into; None if there are none.

    A key that is not among the ``n`` largest has at most 1/n of the rows, so no more
    than ``n``, the number of shuffle partitions, have to be looked at.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 2 * LEAST)
    large = counts.orderBy(F.col("__n").desc()).limit(n).collect()
    if not large:
        return None
    block = max(LEAST, df.count() // n)
    large = [r for r in large if r["__n"] > 2 * block]
    if not large:
        return None
    blocks = min(n, -(-sum(r["__n"] for r in large) // block))
    return spark.createDataFrame([tuple(r) for r in large], counts.schema).drop("__n"), blocks


def along(df: DataFrame, keys: list[str], order: list[str],
          steps: dict[str, Step]) -> DataFrame:
    """Add one column per step, computed over ``keys`` in ``order``.

    ``order`` must break all ties.
    """
    df = settled(df)
    return _along(df, keys, order, steps, crowded(df, keys))


def by_part(df: DataFrame, keys: list[str], body) -> DataFrame:
    """Run a computation of several ordered passes over the same keys.

    ``body(rows, run)`` calls ``run(rows, steps, order)`` for each pass. Crowded keys are
    looked for once.
    """
    df = settled(df)
    hot = crowded(df, keys)
    return body(df, lambda d, order, steps: _along(d, keys, order, steps, hot))


def _along(df, keys, order, steps, hot):
    columns = df.columns
    vals = {n: f"__v{i}" for i, n in enumerate(steps)}

    def valued(d):
        return d.select("*", *[s.value.alias(vals[n]) for n, s in steps.items() if s.value is not None])
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return valued(df).select(*columns, *[
            _window_value(Step(s.kind, F.col(vals[n]) if s.value is not None else None, s.before), w)
            .alias(n) for n, s in steps.items()])
    large, blocks = hot
    df = settled(df)
    if not keys:
        return _carried(in_blocks(valued(df), keys, order, blocks), columns, vals, keys, order, steps)
    large = F.broadcast(large.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)]))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__h{i}")) for i, k in enumerate(keys)])
    cut = in_blocks(valued(df.join(large, same, "left_semi")), keys, order, blocks)
    return _along(df.join(large, same, "left_anti"), keys, order, steps, None).unionByName(
        _carried(cut, columns, vals, keys, order, steps))


def _window_value(step: Step, w) -> Column:
    if step.kind == "nth":
        return F.row_number().over(w).cast("bigint") - F.lit(1)
    if step.kind == "following":
        return F.lead(step.value).over(w)
    if step.kind == "preceding":
        return F.lag(step.value).over(w)
    over = w.rowsBetween(Window.unboundedPreceding, -1 if step.before else 0)
    if step.kind == "total":
        return F.coalesce(F.sum(step.value).over(over), F.lit(0))
    if step.kind == "latest":
        return F.last(step.value, ignorenulls=True).over(over)
    if step.kind == "lowest":
        return F.min(step.value).over(over)
    return F.max(step.value).over(over)


def _carried(df, columns, vals, keys, order, steps):
    w = Window.partitionBy(*keys, "__b").orderBy(*order)
    inner = df.select(
        "*", (F.row_number().over(w).cast("bigint") - F.lit(1)).alias("__rn"),
        *[_window_value(Step(s.kind, F.col(vals[n]) if s.value is not None else None,
                             s.before), w).alias(f"__l_{n}")
          for n, s in steps.items()])

    at = F.struct(*[F.col(o) for o in order])
    aggs = [F.count(F.lit(1)).alias("__n")]
    for n, s in steps.items():
        v = F.col(vals[n]) if s.value is not None else None
        if s.kind == "following":
            aggs.append(F.min_by(F.struct(v.alias("v")), at).alias(f"__s_{n}"))
        elif s.kind == "preceding":
            aggs.append(F.max_by(F.struct(v.alias("v")), at).alias(f"__s_{n}"))
        elif s.kind == "total":
            aggs.append(F.sum(v).alias(f"__s_{n}"))
        elif s.kind == "latest":
            aggs.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(f"__s_{n}"))
        elif s.kind == "lowest":
            aggs.append(F.min(v).alias(f"__s_{n}"))
        elif s.kind == "highest":
            aggs.append(F.max(v).alias(f"__s_{n}"))
    summary = df.groupBy(*keys, "__b").agg(*aggs)
    bw = Window.partitionBy(*keys).orderBy("__b")
    prior = bw.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.col("__n").alias("__c_n")]
    for n, s in steps.items():
        c = F.col(f"__s_{n}") if s.kind != "nth" else None
        made = {
            "nth": lambda: F.coalesce(F.sum("__n").over(prior), F.lit(0)),
            "following": lambda: F.lead(c).over(bw)["v"],
            "preceding": lambda: F.lag(c).over(bw)["v"],
            "total": lambda: F.coalesce(F.sum(c).over(prior), F.lit(0)),
            "latest": lambda: F.last(c, ignorenulls=True).over(prior),
            "lowest": lambda: F.min(c).over(prior),
            "highest": lambda: F.max(c).over(prior),
        }[s.kind]()
        carry.append(made.alias(f"__c_{n}"))
    summary = summary.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                             F.col("__b").alias("__kb"), *carry)
    cond = F.col("__b") == F.col("__kb")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    j = inner.join(F.broadcast(summary), cond)      # a row or two per block
    out = []
    for n, s in steps.items():
        local, c = F.col(f"__l_{n}"), F.col(f"__c_{n}")
        if s.kind in ("nth", "total"):
            v = local + c
        elif s.kind == "following":
            v = F.when(F.col("__rn") == F.col("__c_n") - 1, c).otherwise(local)
        elif s.kind == "preceding":
            v = F.when(F.col("__rn") == 0, c).otherwise(local)
        elif s.kind == "latest":
            v = F.coalesce(local, c)
        elif s.kind == "lowest":
            v = F.least(local, c)
        else:
            v = F.greatest(local, c)
        out.append(v.alias(n))
    return j.select(*columns, *out)
