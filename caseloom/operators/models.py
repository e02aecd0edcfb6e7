"""Predictive models on tables: durations, quantiles, decision points."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import START, UNKNOWN, ratio, total
from ..functions.ordered import along, nth, total_before
from ..functions.quantiles import quantiles
from ..functions.staging import staged
from . import boosting
from .shape import encode, label_dictionary

# The feature contract of the duration model, in order.
FEATURES = ("activity_enc", "resource_enc", "previous_activity_enc", "day_of_week",
            "hour_of_day", "case_position", "case_age_seconds", "n_previous_activities")
# Quantile levels, model settings and decision-tree limits.
LEVELS = tuple(i / 20 for i in range(1, 20))
TREES, DEPTH, RATE, SUBSAMPLE, LEAF = 300, 6, 0.1, 0.8, 20
TREE_DEPTH, TREE_LEAF, MIN_ROWS = 5, 20, 30


def temporal_split(df: DataFrame, order: Sequence[str], share: float = 0.8) -> DataFrame:
    """Add ``is_train``: the oldest ``floor(share * n)`` rows in the given order."""
    out = along(df, [], list(order), {"__rn": nth()})
    cut = F.floor(total(df, F.count(F.lit(1))) * F.lit(share))
    return out.withColumn("is_train", F.col("__rn") < cut).drop("__rn")


def encoders(df: DataFrame) -> dict[str, DataFrame]:
    """Label dictionaries of the categorical features, with their sentinels."""
    return {"activity": label_dictionary(df, "activity", [UNKNOWN]),
            "resource": label_dictionary(df, "resource", [UNKNOWN]),
            "previous_activity": label_dictionary(df, "previous_activity", [START, UNKNOWN])}


def encoded(df: DataFrame, enc: dict[str, DataFrame]) -> DataFrame:
    """Add the encoded label columns; unseen labels take the sentinel's code."""
    df = encode(df, "activity", enc["activity"], UNKNOWN, "activity_enc")
    df = encode(df, "resource", enc["resource"], UNKNOWN, "resource_enc")
    return encode(df, "previous_activity", enc["previous_activity"], START, "previous_activity_enc")


def feature_matrix(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Add ``features`` in the fixed column order."""
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


def duration_rows(df: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(encoders, rows with ``is_train``, ``y`` and the encoded features).

    ``y`` is log1p(duration_s); the oldest 80 % train. Every column of the feature contract
    must be there, with ``timestamp`` and a tie-breaking ``row_key``.
    """
    enc = encoders(df)
    rows = temporal_split(df.withColumn("y", F.log1p("duration_s")), ["timestamp", "row_key"])
    return enc, encoded(rows, enc)


def train_duration(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> boosting.Boosted:
    """Boosted trees for the mean of ``y``, learned from the training rows of ``duration_rows``."""
    return boosting.fit(rows.filter("is_train"), FEATURES, "y", "row_key", trees, depth, RATE, SUBSAMPLE,
                        LEAF, seed=seed)


def train_quantiles(rows: DataFrame, levels: Sequence[float] = LEVELS, trees: int = TREES,
                    depth: int = DEPTH, seed: int = 42) -> boosting.Boosted:
    """Boosted trees for the quantiles of ``y``, all levels on shared splits."""
    return boosting.fit(rows.filter("is_train"), FEATURES, "y", "row_key", trees, depth, RATE, SUBSAMPLE,
                        LEAF, levels, seed=seed)


def with_learned_curve(df: DataFrame, model: boosting.Boosted) -> DataFrame:
    """Add ``levels`` and ``values``, the non-decreasing quantile curve of each row."""
    return boosting.predict(df, model, "values").withColumn(
        "levels", F.array(*[F.lit(float(q)) for q in model.levels]))


def feature_importances(model: boosting.Boosted, spark) -> DataFrame:
    """feature, importance (one row per feature): shares of the whole gain."""
    return spark.createDataFrame([(c, float(v)) for c, v in zip(model.features, model.importances())],
                                 "feature string, importance double")


def regression_metrics(df: DataFrame, y: str = "y", prediction: str = "prediction",
                       log_scale: bool = True) -> DataFrame:
    """One row: n, MAE, MSE, RMSE and R2 in seconds, and R2 on the log scale."""
    a, b = F.col(y), F.col(prediction)
    ra, rb = (F.expm1(a), F.expm1(b)) if log_scale else (a, b)
    e = df.select(a.alias("a"), b.alias("b"), ra.alias("ra"), rb.alias("rb"))
    err, raw = F.col("b") - F.col("a"), F.col("rb") - F.col("ra")
    out = e.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(raw)).alias("mae"),
                F.avg(raw * raw).alias("mse"), F.var_pop("ra").alias("__v"),
                F.avg(err * err).alias("__me"), F.var_pop("a").alias("__vl"))
    return out.withColumns({"rmse": F.sqrt("mse"), "r2": 1.0 - ratio("mse", "__v"),
                            "r2_log": 1.0 - ratio("__me", "__vl")}).drop("__v", "__me", "__vl")


def quantile_table(df: DataFrame, keys: Sequence[str], value: str = "y",
                   levels: Sequence[float] = LEVELS, min_rows: int = 30) -> DataFrame:
    """keys, level, q per group with enough rows; null keys hold the fallback over all rows."""
    keys = list(keys)
    probs = {f"q{i}": p for i, p in enumerate(levels)}
    # each row counts for its group and for the whole
    both = df.select(*keys, F.col(value).alias("__y"), F.explode(F.array(
        F.lit(True), F.lit(False))).alias("__own")).select(
        *[F.when(F.col("__own"), F.col(k)).otherwise(F.lit("").cast(df.schema[k].dataType)).alias(k)
          for k in keys], "__own", "__y")
    n = both.groupBy(*keys, "__own").agg(F.count(F.lit(1)).alias("__n")).filter(
        (F.col("__n") >= min_rows) | ~F.col("__own")).drop("__n")
    per = quantiles(both, [*keys, "__own"], "__y", probs).join(n, [*keys, "__own"], "left_semi")
    both = per.select(*[F.when(F.col("__own"), F.col(k)).alias(k) for k in keys], *probs)
    cells = F.array(*[F.struct(F.lit(p).alias("level"), F.col(f"q{i}").alias("q"))
                      for i, p in enumerate(levels)])
    return both.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def _curves(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, levels, values: one row per group, values made non-decreasing."""
    c = table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", "q"))).alias("c"))
    top = F.transform(F.sequence(F.lit(1), F.size("c")),
                      lambda i: F.array_max(F.transform(F.slice("c", F.lit(1), i), lambda x: x["q"])))
    return c.select(*keys, F.transform("c", lambda x: x["level"]).alias("levels"), top.alias("values"))


def with_curve(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the group's quantile curve (``levels``, ``values``), else the fallback's."""
    keys = list(keys)
    known = table.filter(F.col(keys[0]).isNotNull())
    spare = _curves(table.filter(F.col(keys[0]).isNull()).withColumn("__g", F.lit(0)), ["__g"])
    cur = _curves(known, keys).withColumnsRenamed({"levels": "__l", "values": "__v"})
    j = df.join(cur, keys, "left")
    return j.withColumns({"levels": F.coalesce("__l", spare.select("levels").scalar()),
                          "values": F.coalesce("__v", spare.select("values").scalar())}).drop("__l", "__v")


def quantile_scores(df: DataFrame, table: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """One row: mean pinball loss, 90 % and 50 % interval coverage, R2 of the median."""
    return curve_scores(with_curve(df, table, keys), y)


def curve_scores(df: DataFrame, y: str = "y") -> DataFrame:
    """The same for rows that have their curve (``levels``, ``values``)."""
    j = df.withColumn("__y", F.col(y))
    loss = F.aggregate(F.zip_with("levels", "values", lambda a, q: F.when(
        F.col("__y") >= q, a * (F.col("__y") - q)).otherwise((1.0 - a) * (q - F.col("__y")))),
        F.lit(0.0), lambda s, x: s + x) / F.size("levels")

    def at(p):
        pos = F.array_position(F.transform("levels", lambda x: F.round(x, 4)), round(p, 4))
        return F.element_at("values", pos.cast("int"))

    def inside(lo, hi):
        return ((F.col("__y") >= at(lo)) & (F.col("__y") <= at(hi))).cast("double")
    err = F.col("__y") - at(0.5)
    out = j.agg(F.avg(loss).alias("mean_pinball"), F.avg(inside(0.05, 0.95)).alias("coverage_90"),
                F.avg(inside(0.25, 0.75)).alias("coverage_50"),
                F.avg(err * err).alias("__e"), F.var_pop("__y").alias("__v"))
    return out.withColumn("r2_median", 1.0 - ratio("__e", "__v")).drop("__e", "__v")


def curve_at(df: DataFrame, u: str, name: str = "duration_s") -> DataFrame:
    """Read a log-scale curve (``levels``, ``values``) at ``u``: linear between the levels,
    flat outside; seconds, at least 1."""
    x = F.col(u)
    i = F.size(F.filter("levels", lambda a: a <= x))
    n = F.size("levels")
    lo = F.least(F.greatest(i, F.lit(1)), n - 1)
    l0, l1 = F.element_at("levels", lo), F.element_at("levels", lo + 1)
    v0, v1 = F.element_at("values", lo), F.element_at("values", lo + 1)
    inside = F.least(F.greatest((x - l0) / (l1 - l0), F.lit(0.0)), F.lit(1.0))
    return df.withColumn(name, F.greatest(F.lit(1.0), F.expm1(v0 + (v1 - v0) * inside)))


def _best_cut(leaf: int):
    """The split of one (dp_key, node) with the largest fall of the Gini impurity."""
    def run(t: pa.Table) -> pa.Table:
        out = {"dp_key": [], "node": [], "feature": [], "cut": []}
        bins, width = t.column("bin").to_numpy(), int(pc.max(t.column("feature")).as_py()) + 1
        label = t.column("label").combine_chunks().dictionary_encode()
        n = np.zeros((width, boosting.BINS, len(label.dictionary)))
        np.add.at(n, (t.column("feature").to_numpy(), bins, label.indices.to_numpy()), t.column("n").to_numpy())
        left = n.cumsum(1)
        whole = left[:, -1:]
        right = whole - left

        def purity(x):      # sum of squares over the count; its rise is the impurity's fall
            size = x.sum(2)
            return np.where(size > 0, (x * x).sum(2) / np.where(size > 0, size, 1), 0.0)
        rise = np.round(purity(left) + purity(right) - purity(whole), 9)
        rise = np.where((left.sum(2) >= leaf) & (right.sum(2) >= leaf), rise, 0.0).ravel()
        at = int(rise.argmax())
        if rise[at] > 0:
            out = {"dp_key": [t.column("dp_key")[0].as_py()], "node": [t.column("node")[0].as_py()],
                   "feature": [at // boosting.BINS], "cut": [at % boosting.BINS]}
        return pa.table({"dp_key": pa.array(out["dp_key"], pa.string()), "node": pa.array(out["node"], pa.int64()),
                         "feature": pa.array(out["feature"], pa.int32()), "cut": pa.array(out["cut"], pa.int32())})
    return run


def _stepped(rows: DataFrame, splits: list[DataFrame]) -> DataFrame:
    """``rows`` with ``node``, the heap number they reach by the splits of the levels."""
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    for s in splits:
        right = F.get("bins", F.col("feature")) > F.col("cut")
        rows = rows.join(s, ["dp_key", "node"], "left").withColumn("node", F.when(
            F.col("feature").isNull(), F.col("node")).otherwise(
            2 * F.col("node") + 1 + right.cast("long"))).drop("feature", "cut")
    return rows


def train_decisions(examples: DataFrame, features: Sequence[str], label: str = "label",
                    order: Sequence[str] = ("case_start", "case_id", "position"), min_rows: int = MIN_ROWS,
                    depth: int = TREE_DEPTH, leaf: int = TREE_LEAF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(splits, leaves, predictions on the newest 20 %): the trees of all decision points at once.

    Points with enough rows and at least two classes among the oldest 80 % get a tree.
    Trees grow level by level: one aggregate counts labels by (point, node, feature, bin),
    whatever the number of points, and each (point, node) picks its best cut from its
    counts. Features are cut into at most 64 bins, null counts as the least. ``splits`` is
    (dp_key, node, feature, cut), rows with bin > cut go to node 2 n + 2, others to 2 n + 1;
    ``leaves`` is (dp_key, node, scores, predicted), equal shares go to the first label.
    """
    x = examples.filter(F.col("dp_key").isNotNull() & F.col(label).isNotNull()).select(
        F.col("dp_key").cast("string").alias("dp_key"), F.col(label).cast("string").alias("label"),
        *order, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    size = x.groupBy("dp_key").agg(F.count(F.lit(1)).alias("points")).filter(F.col("points") >= min_rows)
    x = along(x.join(size, "dp_key"), ["dp_key"], list(order), {"rn": nth()})
    x = staged(x.withColumn("is_train", F.col("rn") < F.floor(F.col("points") * F.lit(0.8))))
    train = x.filter("is_train")
    known = train.groupBy("dp_key").agg(F.countDistinct("label").alias("classes")).filter("classes >= 2")
    edges = boosting.edges(train, [f"x{i}" for i in range(len(features))])

    def bin_of(i, e):
        if not len(e):
            return F.lit(0)
        below = F.size(F.filter(F.array(*[F.lit(float(v)) for v in e]), lambda v: v < F.col(f"x{i}")))
        return F.when(F.col(f"x{i}").isNull(), 0).otherwise(below)
    x = staged(x.join(known, "dp_key", "left_semi").select(
        "dp_key", "label", "is_train", F.array(*[bin_of(i, e) for i, e in enumerate(edges)]).alias("bins")))
    splits: list[DataFrame] = []
    for _ in range(depth):
        at = _stepped(x.filter("is_train"), splits).filter(F.col("node") >= (1 << len(splits)) - 1)
        counts = at.select("dp_key", "node", "label", F.posexplode("bins").alias("feature", "bin")).groupBy(
            "dp_key", "node", "feature", "bin", "label").agg(F.count(F.lit(1)).alias("n"))
        splits.append(staged(counts.groupBy("dp_key", "node").applyInArrow(
            _best_cut(leaf), "dp_key string, node long, feature int, cut int")))
    told = _stepped(x, splits)
    per = told.filter("is_train").groupBy("dp_key", "node", "label").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dp_key", "node")))
    classes = train.select("dp_key", "label").distinct().groupBy("dp_key").agg(
        F.map_from_entries(F.collect_list(F.struct("label", F.lit(0.0)))).alias("none"))
    leaves = per.groupBy("dp_key", "node").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "share"))).alias("some"),
        F.min(F.struct((-F.col("n")).alias("less"), "label")).alias("m")).join(classes, "dp_key")
    leaves = staged(leaves.select("dp_key", "node", F.map_zip_with(
        "none", "some", lambda k, a, b: F.coalesce(b, a)).alias("scores"), F.col("m.label").alias("predicted")))
    out = told.filter("not is_train").join(leaves, ["dp_key", "node"]).select(
        "dp_key", "label", "predicted", "scores")
    return reduce(DataFrame.unionByName, splits), leaves, out


def classification_metrics(p: DataFrame) -> DataFrame:
    """Per decision point: n, accuracy, macro precision and recall.

    ``p`` is (dp_key, label, predicted). Classes are those seen as label or prediction.
    """
    cells = p.groupBy("dp_key", "label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    acc = cells.groupBy("dp_key").agg(F.sum("n").alias("n"),
                                      (F.sum(hit) / F.sum("n")).alias("accuracy"))
    rec = cells.groupBy("dp_key", F.col("label").alias("c")).agg(
        F.sum(hit).alias("tp"), F.sum("n").alias("actual"))
    pre = cells.groupBy("dp_key", F.col("predicted").alias("c")).agg(F.sum("n").alias("said"))
    both = rec.join(pre, ["dp_key", "c"], "full").na.fill(0)
    macro = both.groupBy("dp_key").agg(
        F.avg(F.coalesce(ratio("tp", "said"), F.lit(0.0))).alias("precision_macro"),
        F.avg(F.coalesce(ratio("tp", "actual"), F.lit(0.0))).alias("recall_macro"))
    return acc.join(macro, "dp_key")


def one_vs_rest_auc(p: DataFrame) -> DataFrame:
    """Per decision point: macro AUC over classes with positives and negatives.

    ``p`` is (dp_key, label, scores map). Equal scores are counted once per value;
    the area follows from running counts.
    """
    long = p.select("dp_key", "label", F.explode("scores").alias("c", "s"))
    pos = F.col("label") == F.col("c")
    v = long.groupBy("dp_key", "c", "s").agg(
        F.sum(pos.cast("int")).alias("p"), F.sum((~pos).cast("int")).alias("q"))
    v = along(v, ["dp_key", "c"], ["s"], {"below": total_before("q")})
    auc = v.groupBy("dp_key", "c").agg(
        F.sum("p").alias("np"), F.sum("q").alias("nq"),
        F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("q"))).alias("a"))
    return auc.filter("np > 0 and nq > 0").groupBy("dp_key").agg(
        F.avg(F.col("a") / (F.col("np") * F.col("nq"))).alias("auc_macro"))


def majority_share(train: DataFrame, label: str = "label") -> DataFrame:
    """dp_key, majority_share: accuracy of always naming the commonest class."""
    c = train.groupBy("dp_key", label).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("dp_key").agg((F.max("n") / F.sum("n")).alias("majority_share"))
