"""Distribution fitting by maximum likelihood, per group, with location 0.

Exponential, normal and log-normal fits follow from five sums per group. The
gamma shape comes from the same sums. The Weibull shape needs a few more passes
over the values: they are written once as a compact table, and each pass is a
grouped sum with map-side combine.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import finite, ratio
from ..functions.ordered import along, settled, total_upto
from ..functions.quantiles import quantiles
from ..functions.special import digamma, kolmogorov_tail, lgamma, trigamma
from ..functions.staging import sized, staged
from .stats import arrival_profile

MIN_POINTS = 5          # fixed value: fewer points get an exponential on the mean
Z99 = 2.326347874       # fixed value: 0.99 quantile of the standard normal
GAMMA_STEPS = 8
WEIBULL_PASSES = 3
MOMENTS = 8             # orders kept around the shape of a pass
NEWTON_STEPS = 4
# Families in order of preference at equal AIC.
FAMILIES = ("expon", "norm", "lognorm", "gamma", "weibull_min")


def sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sd (population), mean square, mean and sd of the logs; positive values only."""
    x = F.col(value).cast("double")
    pos = df.select(*keys, x.alias("__x")).filter(finite("__x") & (F.col("__x") > 0))
    return pos.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__x").alias("mean_s"),
        F.stddev_pop("__x").alias("std_s"),
        F.avg(F.col("__x") * F.col("__x")).alias("mean_sq"),
        F.avg(F.log("__x")).alias("mean_log"), F.stddev_pop(F.log("__x")).alias("sd_log"))


def closed_forms(s: DataFrame) -> DataFrame:
    """Add scale/shape and AIC of the exponential, normal and log-normal families."""
    n, m, log_m = F.col("n"), F.col("mean_s"), F.col("mean_log")
    spread = F.col("sd_log") > 1e-12
    sd2 = F.col("sd_log") * F.col("sd_log")
    two_pi = F.lit(2 * math.pi)
    return s.withColumns({
        "expon_aic": 4.0 + 2.0 * (n * F.log(m) + n),
        "norm_scale": F.sqrt("mean_sq"),
        "norm_aic": 4.0 + n * (F.log(two_pi * F.col("mean_sq")) + 1.0),
        "lognorm_shape": F.when(spread, F.col("sd_log")),
        "lognorm_scale": F.exp(log_m),
        "lognorm_aic": F.when(spread, 6.0 + 2.0 * n * log_m + n * (F.log(two_pi * sd2) + 1.0))})


def gamma_form(s: DataFrame) -> DataFrame:
    """Add the gamma shape, scale and AIC: solves ln a - digamma(a) = ln(mean) - mean(ln)."""
    gap = F.log("mean_s") - F.col("mean_log")
    s = s.withColumn("__s", F.when(gap > 1e-12, gap))
    g = F.col("__s")

    def step(a, _):
        move = (F.log(a) - digamma(a) - g) / (a * a * (1.0 / a - trigamma(a)))
        return 1.0 / (1.0 / a + move)
    start = (3.0 - g + F.sqrt((g - 3.0) * (g - 3.0) + 24.0 * g)) / (12.0 * g)
    s = s.withColumn("__a", F.aggregate(_turns(GAMMA_STEPS), start, step))
    a, n = F.col("__a"), F.col("n")
    scale = F.col("mean_s") / a
    loglik = ((a - 1.0) * n * F.col("mean_log") - n * F.col("mean_s") / scale
              - n * a * F.log(scale) - n * lgamma(a))
    return s.withColumns({"gamma_shape": a, "gamma_scale": scale,
                          "gamma_aic": 6.0 - 2.0 * loglik}).drop("__s", "__a")


def _turns(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def _series(delta: str, first: int) -> str:
    """SQL text of the Taylor sum of the weighted moments from ``first`` on, ``delta``
    away from the shape of the pass."""
    out = "0D"
    for k in range(MOMENTS - first, 0, -1):      # Horner form
        out = f"({out} + __m{first + k}) * {delta} / {k}"
    return f"({out} + __m{first})"


def weibull_form(values: DataFrame, s: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add the Weibull shape, scale and AIC.

    Each pass sums exp(c u) u^k over the log values u; the sums describe the
    likelihood equation around c well enough to take several Newton steps on the
    aggregated row, so three passes reach full precision. Rows carry only the
    current shape and mean log of their group.
    """
    logs = values.select(*keys, F.log(F.col(value).cast("double")).alias("__u"))
    cur = s.select(*keys, "mean_log", F.when(
        F.col("sd_log") > 1e-12, F.lit(math.pi / math.sqrt(6)) / F.col("sd_log")).alias("__c"))
    for turn in range(WEIBULL_PASSES):
        j = logs.join(cur, keys)
        u = F.col("__u") - F.col("mean_log")     # centred: no overflow for usual shapes
        w = F.exp(F.col("__c") * u)
        j = j.select(*keys, "__c", "mean_log", u.alias("u"), w.alias("w"))
        moments = [F.expr(f"sum(w * pow(u, {k}))").alias(f"__m{k}") for k in range(MOMENTS + 1)]
        cur = j.groupBy(*keys).agg(*moments, F.max("__c").alias("__c"),
                                   F.max("mean_log").alias("mean_log"))

        c, r = "(__c + d)", f"{_series('d', 1)} / {_series('d', 0)}"
        slope = f"({_series('d', 2)} / {_series('d', 0)} - pow({r}, 2) + 1 / pow({c}, 2))"
        newton = f"d - ({r} - 1 / {c}) / {slope}"
        cur = cur.withColumn("__d", F.expr(
            f"aggregate(sequence(1, {NEWTON_STEPS}), 0D, (d, i) -> "
            f"least(greatest({newton}, -0.5D * __c), 0.5D * __c))"))
        cur = cur.select(*keys, "mean_log", (F.col("__c") + F.col("__d")).alias("__c"),
                         F.expr(_series("__d", 0)).alias("__w0"))
        if turn < WEIBULL_PASSES - 1:
            # one row per group; its true size decides whether the next join shuffles
            cur = sized(cur.drop("__w0"))
    t = s.join(cur.drop("mean_log"), keys)
    c, n, log_m = F.col("__c"), F.col("n"), F.col("mean_log")
    scale = F.exp(log_m) * F.pow(F.col("__w0") / n, 1.0 / c)
    loglik = n * F.log(c) - n * c * F.log(scale) + (c - 1.0) * n * log_m - n
    return t.withColumns({"weibull_min_shape": c, "weibull_min_scale": scale,
                          "weibull_min_aic": 6.0 - 2.0 * loglik}).drop("__c", "__w0")


def best_fit(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, distribution, params, mean_s, std_s: smallest AIC of the five families.

    ``params`` is (scale) with leading shape and location 0, in the usual order.
    """
    if not keys:
        return best_fit(df.withColumn("__g", F.lit(0)), ["__g"], value).drop("__g")
    x = F.col(value).cast("double")
    vals = staged(df.select(*keys, x.alias("__x")).filter(finite("__x") & (F.col("__x") > 0)))
    s = gamma_form(closed_forms(staged(sums(vals, keys, "__x"))))
    s = weibull_form(vals, s, keys, "__x")
    zero = F.lit(0.0)
    params = {
        "expon": F.array(zero, F.col("mean_s")),
        "norm": F.array(zero, F.col("norm_scale")),
        **{f: F.array(F.col(f"{f}_shape"), zero, F.col(f"{f}_scale"))
           for f in ("lognorm", "gamma", "weibull_min")}}
    options = F.array(*[F.struct(F.col(f"{f}_aic").alias("aic"), F.lit(i).alias("i"),
                                 F.lit(f).alias("distribution"), params[f].alias("params"))
                        for i, f in enumerate(FAMILIES)])
    usable = F.filter(options, lambda o: o["aic"].isNotNull() & ~F.isnan(o["aic"])
                      & (F.abs(o["aic"]) < float("inf")))
    best = F.array_min(usable)
    few = F.col("n") < MIN_POINTS
    return s.withColumn("__b", best).select(
        *keys, "n", F.when(few, "expon").otherwise(F.col("__b.distribution")).alias("distribution"),
        F.when(few, params["expon"]).otherwise(F.col("__b.params")).alias("params"),
        "mean_s", "std_s")


def delay_fit(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Zero mass, overall mean, p99 and the best fit of the positive part."""
    if not keys:
        return delay_fit(df.withColumn("__g", F.lit(0)), ["__g"], value).drop("__g")
    v = F.col(value)
    ok = settled(df.select(*keys, value).filter(finite(value) & (v >= 0)))     # read three times
    base = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_delays"),
        F.avg((v == 0).cast("double")).alias("zero_prob"), F.avg(v).alias("overall_mean_s"))
    p99 = quantiles(ok, keys, value, {"p99_s": 0.99})
    out = base.join(p99, keys).join(best_fit(ok, keys, value), keys, "left")
    return out.withColumns({
        "n": F.coalesce("n", F.lit(0)), "mean_s": F.coalesce("mean_s", F.lit(0.0)),
        "std_s": F.coalesce("std_s", F.lit(0.0)),
        "distribution": F.coalesce("distribution", F.lit("expon")),
        "params": F.coalesce("params", F.array(F.lit(0.0), F.lit(0.0)))})


def zero_mass_fit(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of zeros over all rows, and the best fit of the non-zero values."""
    if not keys:
        return zero_mass_fit(df.withColumn("__g", F.lit(0)), ["__g"], value).drop("__g")
    z = df.groupBy(*keys).agg(F.avg(F.coalesce((F.col(value) == 0).cast("double"), F.lit(0.0)))
                              .alias("zero_prob"))
    return z.join(best_fit(df.filter(F.col(value) != 0), keys, value), keys, "left")


def _p(i: int) -> Column:
    return F.col("params")[i]


def analytic_mean(fits: DataFrame, default: float = 600.0) -> DataFrame:
    """Add ``expected_s``: mean of the fitted law (at least 1 s), else the default."""
    d = F.col("distribution")
    mean = (F.when(d == "lognorm", _p(1) + F.try_element_at("params", F.lit(3))
                   * F.exp(0.5 * _p(0) * _p(0)))
            .when(d == "gamma", _p(1) + F.try_element_at("params", F.lit(3)) * _p(0))
            .when(d == "weibull_min", _p(1) + F.try_element_at("params", F.lit(3))
                  * F.exp(lgamma(1.0 + 1.0 / _p(0)))))
    return fits.withColumn("expected_s", F.when(mean.isNotNull(), F.greatest(F.lit(1.0), mean))
                           .otherwise(F.lit(default)))


def analytic_p99(fits: DataFrame) -> DataFrame:
    """Add ``fit_p99_s``: closed-form 0.99 quantile (0 for families without one)."""
    d, q = F.col("distribution"), F.lit(-math.log(0.01))
    last = F.try_element_at("params", F.lit(-1))
    loc = F.try_element_at("params", F.lit(-2))
    return fits.withColumn("fit_p99_s", F.when(d == "expon", loc + last * q)
                           .when(d == "lognorm", loc + last * F.exp(_p(0) * Z99))
                           .when(d == "weibull_min", loc + last * F.pow(q, 1.0 / _p(0)))
                           .when(d == "norm", loc + last * Z99).otherwise(F.lit(0.0)))


def expected_duration(pairs: DataFrame, predictions: DataFrame, fits: DataFrame,
                      default: float = 600.0) -> DataFrame:
    """Expected seconds per (activity, resource): the model's prediction where there
    is one, else the mean of the activity's fit, else the default."""
    means = analytic_mean(fits, default).select("activity", F.col("expected_s").alias("__f"))
    p = predictions.select("activity", "resource", F.col("predicted_s").alias("__p"))
    j = pairs.join(p, ["activity", "resource"], "left").join(means, "activity", "left")
    return j.withColumn("expected_s", F.coalesce(
        F.when(F.col("__p").isNotNull(), F.greatest(F.lit(1.0), F.col("__p"))),
        F.col("__f"), F.lit(default))) \
        .withColumn("source", F.when(F.col("__p").isNotNull(), "model")
                    .when(F.col("__f").isNotNull(), "fit").otherwise("default")) \
        .drop("__p", "__f")


EXACT = 10_000      # fixed value: samples up to this size get the exact p-value


def exact_ks_tail(gap: int, m: int, n: int) -> float:
    """P(D >= gap / (m n)) of two samples of m and n values without ties.

    An order of all values is a lattice path from (0, 0) to (m, n); it counts if it meets
    a point with ``|i n - j m| >= gap``. The share of such paths among those to (i, j) is
    i / (i + j) of that at (i - 1, j) and j / (i + j) of that at (i, j - 1), which is
    worked out one anti-diagonal at a time in O(m) memory.
    """
    if gap <= 0:
        return 1.0
    row = np.zeros(m + 1)
    for s in range(1, m + n + 1):
        i = np.arange(max(0, s - n), min(m, s) + 1)
        left = np.where(i > 0, row[np.maximum(i - 1, 0)], 0.0)
        here = (i * left + (s - i) * np.where(s - i > 0, row[i], 0.0)) / s
        row[i] = np.where(np.abs(i * n - (s - i) * m) >= gap, 1.0, here)
    return float(row[m])


@F.pandas_udf(T.DoubleType())
def _exact_tail(gap, m, n):
    import pandas as pd
    return pd.Series([exact_ks_tail(int(g), int(a), int(b)) for g, a, b in zip(gap, m, n)], dtype=float)


def two_sample_ks(a: DataFrame, b: DataFrame, value: str, method: str = "auto") -> DataFrame:
    """One row: Kolmogorov-Smirnov distance of two samples, sizes, p-value and its method.

    ``method`` is exact, asymptotic, or auto: exact if both samples have from 1 to
    ``EXACT`` values. The exact tail is that of samples without ties. Values are counted
    first; the running counts see one row per distinct value.
    """
    both = a.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")) \
        .unionByName(b.select(F.col(value).cast("double").alias("v"), F.lit(0).alias("a"),
                              F.lit(1).alias("b"))).filter(F.col("v").isNotNull())
    c = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = along(c, [], ["v"], {"ca": total_upto("a"), "cb": total_upto("b")})
    n = both.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    na, nb = n.select("na").scalar(), n.select("nb").scalar()
    out = run.agg(F.max(F.abs(F.col("ca") / na - F.col("cb") / nb)).alias("statistic")) \
        .withColumns({"n_a": na, "n_b": nb})
    size = F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))
    far = kolmogorov_tail(F.sqrt(size) * F.col("statistic"))
    if method == "asymptotic":
        return out.withColumns({"p_value": far, "method": F.lit(method)})
    out = staged(out)
    small = out.filter(F.col("n_a").between(1, EXACT) & F.col("n_b").between(1, EXACT)) \
        if method == "auto" else out
    gap = F.round(F.col("statistic") * F.col("n_a") * F.col("n_b")).cast("long")
    if small.isEmpty():
        return out.withColumns({"p_value": far, "method": F.lit("asymptotic")})
    return out.withColumns({"p_value": _exact_tail(gap, "n_a", "n_b"), "method": F.lit("exact")})


def profile_mae(a: DataFrame, b: DataFrame) -> DataFrame:
    """profile (hod|dow), mae between the arrival profiles of two arrival sets."""
    p = arrival_profile(a).select("profile", "slot", F.col("share").alias("x"))
    q = arrival_profile(b).select("profile", "slot", F.col("share").alias("y"))
    return p.join(q, ["profile", "slot"]).groupBy("profile").agg(
        F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"))
