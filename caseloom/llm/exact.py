"""Exact dedup: copies are combined locally, then per salt, then over all salts.

1. Each task combines its own copies of a text.
2. What tasks found is merged by (digest, content) in ``SALTS`` shares: a text that a
   third of all rows hold reaches a share once per task, never once per row.
3. The winners of the shares, at most ``SALTS`` rows a text, are combined.

Every one of these groupings has the whole content in its key, so two texts meet only
if they are equal, whatever their digests. Answers go back to the rows by digest alone
once it is known that no digest stands for two texts; the rows of a digest that does
are answered by content. Rows of frequent texts are spread over salts on the way back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import staged
from .base import partitions, query, table

SALTS = 32          # shares in which one text's copies are merged
FREQUENT = 1000     # a text with more than 1/FREQUENT of the rows is spread: fewer than 1000 texts


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _combined(rows: DataFrame) -> DataFrame:
    """(digest, content, keep, n) of each distinct content, over salts."""
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    shares = salted.groupBy("digest", "content", "salt").agg(
        F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    return shares.groupBy("digest", "content").agg(
        F.max("keep").alias("keep"), F.sum("n").alias("n"))


def _answered(rows: DataFrame, groups: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` with keep and n of their group; frequent groups are met in several salts."""
    spread = partitions(rows.sparkSession)
    often = F.col("n") * FREQUENT > F.lit(total)
    frequent = F.broadcast(groups.filter(often).select(*on, F.lit(True).alias("often")))
    rows = rows.join(frequent, on, "left").withColumn("salt", F.when(
        F.col("often"), F.pmod(F.spark_partition_id(), F.lit(spread))).otherwise(0)).drop("often")
    groups = groups.withColumn("salt", F.explode(F.when(
        often, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))))
    return rows.join(groups, [*on, "salt"]).drop("salt")


def decide(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
           keep: tuple = ("doc_id",), normalise: Callable[[Column], Column] | None = None,
           digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """``keep`` plus keep_id, group_size, kept and text_sha256, one row per row of ``docs``.

    Texts are equal if they are the same after ``normalise`` (by default: no change); null
    counts as empty. Of equal texts the largest id stays. A row without an id is counted
    in its group and stays only if no row of the group has an id. Rows that repeat one id
    and text are one document: all are marked kept or none is, and ``distinct`` leaves one.
    Other columns may have any name; if ``keep`` names one of the four, the new column is
    called the same with underscores in front.
    """
    names, taken = [], {c.lower() for c in keep}
    for n in ("keep_id", "group_size", "kept", "text_sha256"):
        while n in taken:
            n = "_" + n
        names.append(n)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    content = normalise(content) if normalise else content
    inner = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(i) for c, i in zip(keep, inner)],
                       F.col(doc_id).cast("long").alias("id"), content.alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content")))
    groups = staged(_combined(rows.select("id", "content", "digest"))
                    .withColumn("sha", F.sha2("content", 256)).drop("content"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    clash = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("digest")
    if clash.isEmpty():
        told = _answered(rows.drop("content"), groups, ["digest"], total)
    else:       # one digest for several texts: those are told apart by content
        clash = staged(clash)
        twins = rows.join(clash, "digest", "left_semi")
        by_text = _combined(twins.select("id", "content", "digest")) \
            .withColumn("sha", F.sha2("content", 256))
        told = _answered(rows.join(clash, "digest", "left_anti").drop("content"),
                         groups.join(clash, "digest", "left_anti"), ["digest"], total) \
            .unionByName(_answered(twins, staged(by_text), ["digest", "content"], total).drop("content"))
    return told.select(
        *[F.col(i).alias(c) for c, i in zip(keep, inner)], F.col("keep").alias(names[0]),
        F.col("n").alias(names[1]), F.col("id").eqNullSafe(F.col("keep")).alias(names[2]),
        F.col("sha").alias(names[3]))


def distinct(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
             normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row of each text, with the columns of ``docs``: that of the largest id."""
    told = decide(docs.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(docs.columns)]),
                  f"d{docs.columns.index(text)}", f"d{docs.columns.index(doc_id)}",
                  tuple(f"d{i}" for i in range(len(docs.columns))), normalise)
    one = told.filter("kept").dropDuplicates(["text_sha256"])
    return one.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(docs.columns)])


@query("op11_exact_dedup", """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))""")
def op11_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Which row of equal texts stays, for every document."""
    return decide(table(spark, d, "documents"))
