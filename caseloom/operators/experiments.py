"""Statistics over run-level result tables.

A result table has one row per (policy, seed[, scenario]) and metric columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.columns import ratio
from ..functions.special import lgamma, student_two_sided

LOOSE = 0.05        # fixed value: relative half-width above which an interval is loose
LEVEL = 0.05        # fixed value: two-sided level of the intervals


def flatten(df: DataFrame, prefix: str = "", sep: str = "_") -> DataFrame:
    """Nested structs as plain columns; maps and arrays become JSON text."""
    def walk(schema, path, name):
        for f in schema.fields:
            p, n = [*path, f.name], f"{name}{sep}{f.name}" if name else f.name
            c = F.col(".".join(f"`{x}`" for x in p))
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, p, n)
            elif isinstance(f.dataType, (T.MapType, T.ArrayType)):
                yield F.to_json(c).alias(n)
            else:
                yield c.alias(n)
    return df.select(*walk(df.schema, [], prefix))


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """keys, metric, value."""
    wide = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def t_quantile(df, level: float = LEVEL, steps: int = 8):
    """Two-sided Student quantile t with P(|T| > t) = level, by Newton steps from an expansion."""
    v = F.greatest(F.col(df) if isinstance(df, str) else df, F.lit(1.0))
    z = 1.959963984540054      # fixed value: normal quantile at 0.975
    start = F.lit(z) + F.lit((z ** 3 + z) / 4) / v + F.lit(
        (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96) / (v * v)

    def step(t, _):
        pdf = F.exp(lgamma((v + 1.0) / 2.0) - lgamma(v / 2.0)
                    - (v + 1.0) / 2.0 * F.log(1.0 + t * t / v)) / F.sqrt(v * F.lit(3.141592653589793))
        return t + (student_two_sided(t, v) - level) / (2.0 * pdf)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def with_interval(summary: DataFrame) -> DataFrame:
    """Add half_width, rel_width and loose to (n, mean, sd); one value has no interval."""
    n = F.col("n").cast("double")
    half = F.when(F.col("n") >= 2, F.col("sd") / F.sqrt(n) * t_quantile(n - 1.0))
    out = summary.withColumn("half_width", half)
    out = out.withColumn("rel_width", ratio("half_width", F.abs("mean")))
    return out.withColumn("loose", F.coalesce(F.col("rel_width") > LOOSE, F.lit(False)))


def mean_interval(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and 95 % half-width of each metric per group."""
    m = long_metrics(df, keys, metrics).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    s = m.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
                                       F.stddev_samp("value").alias("sd"))
    return with_interval(s)


def paired_by_seed(df: DataFrame, metrics: Sequence[str], baseline: str) -> DataFrame:
    """policy, seed, metric, base, value: every other policy next to the baseline of its seed."""
    m = long_metrics(df, ["policy", "seed"], metrics)
    base = m.filter(F.col("policy") == baseline).select("seed", "metric", F.col("value").alias("base"))
    return m.filter(F.col("policy") != baseline).join(base, ["seed", "metric"])


def _deltas(df, metrics, baseline):
    p = paired_by_seed(df, metrics, baseline).withColumn("d", F.col("value") - F.col("base"))
    return p.groupBy("policy", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))


def paired_tests(df: DataFrame, metrics: Sequence[str], baseline: str = "random") -> DataFrame:
    """Paired t-test of every policy against the baseline, by metric."""
    s = _deltas(df, metrics, baseline).filter("n >= 2")
    n = F.col("n").cast("double")
    s = s.withColumn("t_stat", ratio("mean", F.col("sd") / F.sqrt(n)))
    return s.select("policy", "metric", F.col("n").alias("n_paired_seeds"),
                    F.col("mean").alias("mean_delta"), "t_stat",
                    student_two_sided(F.col("t_stat"), n - 1.0).alias("p_value"))


def paired_deltas(df: DataFrame, metrics: Sequence[str], baseline: str = "random") -> DataFrame:
    """Mean difference to the baseline by seed, with its 95 % half-width."""
    return with_interval(_deltas(df, metrics, baseline)).select(
        "policy", "metric", F.col("n").alias("n_pairs"), F.col("mean").alias("delta"), "half_width")


def summarize(df: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """Mean and half-width of many metrics per group."""
    return mean_interval(df, [group], metrics).select(
        group, "metric", F.col("n").alias("n_replications"), "mean", "half_width")


def relative_impact(summary: DataFrame, key: str, baseline: str,
                    metrics: Sequence[str]) -> DataFrame:
    """Percent change of each metric against the baseline row."""
    m = long_metrics(summary, [key], metrics)
    base = m.filter(F.col(key) == baseline).select("metric", F.col("value").alias("base"))
    j = m.filter(F.col(key) != baseline).join(base, "metric")
    return j.select(key, "metric", ((ratio("value", "base") - 1.0) * 100.0).alias("impact_pct"))


def policy_order(policy="policy"):
    """Sort key: random, piled, k-batch by its number, then the rest by name."""
    p = F.col(policy)
    k = F.regexp_extract(p, r"^kbatch(\d+)$", 1)
    return F.struct(
        F.when(p == "random", 0).when(p == "piled", 1).when(k != "", 2).otherwise(3).alias("a"),
        F.coalesce(k.try_cast("int"), F.lit(0)).alias("b"),
        F.when((p == "random") | (p == "piled") | (k != ""), "").otherwise(p).alias("c"))


def ordered_policies(df: DataFrame) -> DataFrame:
    """policy, place from 1."""
    w = Window.orderBy(policy_order())
    return df.select("policy").distinct().withColumn("place", F.row_number().over(w))


def scenario_means(df: DataFrame, metric: str, scenarios: Sequence[str]) -> DataFrame:
    """Mean of a metric per policy, one column per scenario, 0 where missing."""
    return df.groupBy("policy").pivot("scenario", list(scenarios)).agg(F.avg(metric)).na.fill(0.0)


def inconsistent_seeds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """seed, column, n_values for settings that differ between runs of the same seed."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"))
                      for c in columns])
    return df.select("seed", F.explode(cells).alias("c")).groupBy("seed", "c.column").agg(
        F.countDistinct("c.v").alias("n_values")).filter("n_values <> 1")


def ranking(summary: DataFrame, cost: str, gain: str, leave_out: Sequence[str] = ()) -> DataFrame:
    """Rank by cost ascending, then gain descending, optionally without some policies."""
    s = summary.filter(~F.col("policy").isin(list(leave_out))) if leave_out else summary
    w = Window.orderBy(F.col(cost).asc(), F.col(gain).desc(), "policy")
    return s.withColumn("place", F.row_number().over(w))


def union_results(*tables: DataFrame) -> DataFrame:
    """Stack result tables whose columns differ; missing cells are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def failing_rows(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Rows that break a rule, with the rule's name. A null result breaks it."""
    broken = F.array(*[F.when(~F.coalesce(F.expr(e), F.lit(False)), F.lit(n))
                       for n, e in checks.items()])
    return df.withColumn("broken", F.explode(F.filter(broken, lambda x: x.isNotNull())))


VALIDATION = ("mode string, configuration struct<completed_cases:bigint,completion_share:double>, "
              "general_metrics struct<processing_times:struct<mean_rel_err:double>,"
              "case_stats:struct<case_duration_rel_err:double>,branching:struct<mean_tvd:double>,"
              "lifecycle:struct<suspend_counts:struct<mean_abs_error:double>>>, "
              "lifecycle struct<resume_ownership:struct<same_resource_rate:double>>")


def mode_table(spark: SparkSession, path: str) -> DataFrame:
    """Validation documents as one row per sampler mode, with the best mode marked."""
    d = spark.read.schema(VALIDATION).json(path).select(
        "mode", "configuration.completed_cases", "configuration.completion_share",
        F.col("general_metrics.processing_times.mean_rel_err").alias("processing_time_error"),
        F.col("general_metrics.lifecycle.suspend_counts.mean_abs_error").alias("suspend_count_mae"),
        F.col("lifecycle.resume_ownership.same_resource_rate").alias("same_resource_rate"),
        F.col("general_metrics.case_stats.case_duration_rel_err").alias("case_duration_error"),
        F.col("general_metrics.branching.mean_tvd").alias("branching_mean_tvd"))
    best = d.agg(F.min_by("mode", F.struct("processing_time_error", "mode"))).scalar()
    return d.withColumn("best", F.col("mode") == best)
