"""Permissions and organisation mining.

A resource log is (case_type, activity_type, time_type, resource), with "" for a
dimension without opinion. An organisational model is members(grp, resource) and
capabilities(grp, ct, at, tt).

Who may work in a context is kept as the set of groups that hold it, not as a
list of people: contexts with the same groups share one answer, so no table of
contexts times members is built to count candidates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.blocks import dense, pairwise
from ..functions.columns import ratio, total
from ..functions.ordered import along, following
from ..functions.quantiles import quantiles
from ..functions.staging import sized, staged
from . import clusters
from .shape import order_of

CTX = ["case_type", "activity_type", "time_type"]
# Weekday time types, Monday first.
TIME_TYPES = ("TT.Monday", "TT.Tuesday", "TT.Wednesday", "TT.Thursday", "TT.Friday",
              "TT.Saturday", "TT.Sunday")
# Context methods whose case type is known when a case starts.
KNOWN_AT_START = ("activity", "attribute")
ANY = "*"       # stands for "not asked" in lookup keys


def pair_counts(df: DataFrame) -> DataFrame:
    """resource, activity, n."""
    return df.filter(F.col("resource").isNotNull()).groupBy("resource", "activity").agg(
        F.count(F.lit(1)).alias("n"))


def permission_matrix(df: DataFrame, activities: Sequence[str]) -> DataFrame:
    """One row per resource, one boolean column per activity: observed or not."""
    m = pair_counts(df).groupBy("resource").pivot("activity", list(activities)).agg(F.sum("n"))
    return m.select("resource", *[F.col(f"`{a}`").isNotNull().alias(a) for a in activities])


def observed_permissions(df: DataFrame) -> DataFrame:
    return pair_counts(df).select("resource", "activity")


def matrix_density(df: DataFrame, thresholds: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """One row: matrix size, granted cells, density, share of cells with little evidence."""
    p = pair_counts(df)
    out = p.agg(F.countDistinct("resource").alias("n_resources"),
                F.countDistinct("activity").alias("n_activities"),
                F.count(F.lit(1)).alias("granted"),
                *[F.avg((F.col("n") <= t).cast("double")).alias(f"share_at_most_{t}")
                  for t in thresholds])
    return out.withColumn("density", ratio("granted", F.col("n_resources") * F.col("n_activities")))


def holdout_gap(df: DataFrame, train_share: float = 0.7) -> DataFrame:
    """One row: later events, by known resources, whose pair the early log never saw.

    The log is cut at a quantile of time; each (resource, activity) pair is
    reduced to its event counts before and after the cut.
    """
    t = F.unix_micros(F.col("timestamp").cast("timestamp")).cast("double")
    e = df.filter(F.col("resource").isNotNull()).select("resource", "activity", t.alias("t"))
    cut = quantiles(e, [], "t", {"q": train_share}).scalar()
    p = e.withColumn("late", F.col("t") > cut).groupBy("resource", "activity").agg(
        F.sum((~F.col("late")).cast("int")).alias("early"), F.sum(F.col("late").cast("int")).alias("later"))
    known = p.groupBy("resource").agg(F.sum("early").alias("e")).filter("e > 0").select("resource")
    p = p.filter("later > 0").join(known, "resource", "left_semi")
    unseen = F.col("early") == 0
    out = p.agg(F.coalesce(F.sum("later"), F.lit(0)).alias("test_events"),
                F.coalesce(F.sum(F.when(unseen, F.col("later"))), F.lit(0)).alias("forbidden_events"),
                F.sum(unseen.cast("int")).alias("forbidden_pairs"))
    return out.withColumn("forbidden_rate", F.coalesce(ratio("forbidden_events", "test_events"),
                                                       F.lit(0.0)))


def resource_log(df: DataFrame, contexts: str = "activity", attribute: str | None = None,
                 clusters: DataFrame | None = None) -> DataFrame:
    """Label every event with its execution context.

    ``contexts``: activity | attribute (needs the case attribute column) |
    clusters (needs (case_id, cluster)).
    """
    at = F.concat(F.lit("AT."), F.col("activity"))
    e = df.filter(F.col("resource").isNotNull())
    if contexts == "activity":
        ct = tt = F.lit("")
    elif contexts in ("attribute", "clusters"):
        if contexts == "clusters":
            e = e.join(clusters.select("case_id", F.col("cluster").cast("string").alias("__c")), "case_id")
            attribute = "__c"
        ct = F.concat(F.lit("CT."), F.col(attribute).cast("string"))
        tt = F.concat(F.lit("TT."), F.date_format("timestamp", "EEEE"))
    else:
        raise ValueError(f"unknown context method {contexts!r}")
    return e.select(ct.alias("case_type"), at.alias("activity_type"), tt.alias("time_type"),
                    "resource", "case_id")


def counted_forms(df: DataFrame, attribute: str, clusters: DataFrame) -> dict[str, DataFrame]:
    """``context_counts`` of all three forms of contexts, the events read once.

    Counts per attribute, cluster, activity and weekday are kept; each form adds them up.
    """
    e = df.filter(F.col("resource").isNotNull()).join(
        clusters.select("case_id", F.col("cluster").alias("__c")), "case_id", "left")
    fine = staged(e.groupBy(F.col(attribute).alias("__a"), "__c", "activity", F.weekday("timestamp").alias("__d"),
                            "resource").agg(F.count(F.lit(1)).alias("n")))
    fine = fine.withColumns({"activity_type": F.concat(F.lit("AT."), "activity"), "time_type": F.get(
        F.array(*[F.lit(t) for t in TIME_TYPES]), F.col("__d"))})
    none = F.lit("")
    return {"activity": context_counts(fine.withColumns({"case_type": none, "time_type": none})),
            **{f: context_counts(fine.filter(rows).withColumn("case_type", F.concat(F.lit("CT."), F.col(c).cast("string"))))
               for f, c, rows in (("attribute", "__a", F.lit(True)),
                                  ("clusters", "__c", F.col("__c").isNotNull()))}}


def case_profiles(df: DataFrame) -> DataFrame:
    """case_id, activity, weight: TF-IDF weights with unit length per case."""
    tf = staged(df.groupBy("case_id", "activity").agg(F.count(F.lit(1)).alias("tf")))
    n = total(tf, F.countDistinct("case_id"))
    idf = tf.groupBy("activity").agg(F.count(F.lit(1)).alias("d")).select(
        "activity", (F.log((n + 1.0) / (F.col("d") + 1.0)) + 1.0).alias("idf"))
    w = tf.join(sized(idf), "activity").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("case_id")))
    return w.select("case_id", "activity", (F.col("w") / norm).alias("weight"))


def trace_clusters(df: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """case_id, cluster from k-means on the case profiles."""
    v = dense(case_profiles(df), "case_id", "activity", "weight").withColumn(
        "features", array_to_vector("vec"))
    model = KMeans(k=k, seed=seed, maxIter=30).fit(v)
    return model.transform(v).select("case_id", F.col("prediction").alias("cluster"))


def profile_clusters(df: DataFrame, k: int = 10) -> DataFrame:
    """case_id, cluster: spherical k-means on the case profiles, each distinct one once.

    Cases with the same activity counts are one vector with a weight, so the work grows
    with the distinct profiles; the start is deterministic.
    """
    v = dense(case_profiles(df), "case_id", "activity", "weight")
    v = staged(v.withColumn("vec", F.transform("vec", lambda x: F.round(x, 9))))
    kinds = v.groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("case_id").alias("case_id"))
    told = clusters.spherical(kinds, k, "case_id", "n")
    of = kinds.select("vec", F.col("case_id").cast("string").alias("k")).join(
        told.withColumnRenamed("case_id", "k"), "k").drop("k")
    return v.join(of, "vec").select("case_id", "cluster")


def hierarchical_groups(rl: DataFrame, n_groups: int = 10, linkage: str = "complete") -> DataFrame:
    """grp, resource: disjoint groups by agglomeration of the resource profiles."""
    v = dense(resource_profiles(rl), "resource", "context", "weight")
    return clusters.hierarchical(v, n_groups, "resource", linkage)


def overlapping_groups(rl: DataFrame, n_groups: int = 10, restarts: int = 3) -> DataFrame:
    """grp, resource, share: groups in which a resource may appear more than once."""
    v = dense(resource_profiles(rl), "resource", "context", "weight")
    return clusters.overlapping(v, n_groups, "resource", restarts)


def _events(rl: DataFrame):
    """Events of a resource log; rows with ``n`` (``context_counts``) stand for so many."""
    return F.sum("n") if "n" in rl.columns else F.count(F.lit(1))


def resource_profiles(rl: DataFrame) -> DataFrame:
    """resource, context, weight = ln(1 + events)."""
    return rl.groupBy("resource", F.concat_ws("|", *CTX).alias("context")).agg(
        F.log1p(_events(rl).cast("double")).alias("weight"))


def discover_groups(rl: DataFrame, n_groups: int = 10, seed: int = 42) -> DataFrame:
    """grp, resource: disjoint groups by top-down splitting of the resource profiles."""
    v = dense(resource_profiles(rl), "resource", "context", "weight").withColumn(
        "features", array_to_vector("vec"))
    model = BisectingKMeans(k=n_groups, seed=seed, maxIter=20).fit(v)
    return model.transform(v).select(F.col("prediction").alias("grp"), "resource")


def context_counts(rl: DataFrame) -> DataFrame:
    """Contexts, resource, n: a resource log in which equal rows are one."""
    return rl.groupBy(*CTX, "resource").agg(_events(rl).alias("n"))


def _profiles(members: DataFrame) -> DataFrame:
    """profile (set of groups), n people, one of them (the smallest name)."""
    per = members.groupBy("resource").agg(F.sort_array(F.collect_set("grp")).alias("profile"))
    return per


def _sizes(sets: DataFrame, members: DataFrame) -> DataFrame:
    """For distinct group sets ``sig``: k people in any of the groups, and the smallest name."""
    prof = _profiles(members).groupBy("profile").agg(
        F.count(F.lit(1)).alias("n"), F.min("resource").alias("one"))
    s = sets.select("sig").distinct().select("sig", F.explode("sig").alias("grp"))
    p = prof.select("profile", "n", "one", F.explode("profile").alias("grp"))
    hit = s.join(p, "grp").select("sig", "profile", "n", "one").distinct()
    return hit.groupBy("sig").agg(F.sum("n").alias("k"), F.min("one").alias("one"))


def conformance(rl: DataFrame, members: DataFrame, capabilities: DataFrame,
                by: Sequence[str] = ()) -> DataFrame:
    """fitness, precision, f1 of a model on a resource log, per value of ``by``."""
    by = list(by)
    return _conformance(staged(context_counts(rl)), members, capabilities, by)


def _conformance(counts, members, capabilities, by, whole=None):
    """``whole`` (some of ``by``, whole): events to be explained, if not those of ``counts``."""
    caps = capabilities.select(*by, "grp", F.coalesce("ct", F.lit("")).alias("case_type"),
                               F.col("at").alias("activity_type"),
                               F.coalesce("tt", F.lit("")).alias("time_type"))
    seen = counts.select(*CTX).distinct()
    sig = caps.join(seen, CTX, "left_semi").groupBy(*by, *CTX).agg(
        F.sort_array(F.collect_set("grp")).alias("sig"))
    k = _sizes(sig, members).drop("one")
    every = sig.select(*by, F.explode("sig").alias("g")).groupBy(*by).agg(
        F.sort_array(F.collect_set("g")).alias("sig"))
    n_all = every.join(_sizes(every, members).select("sig", F.col("k").alias("n_all")), "sig") \
        .drop("sig")
    prof = _profiles(members)
    j = counts.join(sig, CTX).join(k, "sig").join(prof, "resource", "left")
    if by:
        j = j.join(n_all, by)
    else:
        j = j.withColumn("n_all", n_all.scalar())
    ok = F.coalesce(F.arrays_overlap("profile", "sig"), F.lit(False))
    share = (F.col("n_all") - F.col("k") + 1) / F.col("n_all")
    t = j.groupBy(*by).agg(
        F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("__c"), F.sum("n").alias("__a"),
        F.sum(F.when(ok, F.col("n") * share).otherwise(0.0)).alias("__p"))
    t = t.withColumn("whole", total(counts, F.sum("n"))) if whole is None else \
        t.join(whole, [c for c in whole.columns if c != "whole"])
    t = t.withColumns({"fitness": F.coalesce(ratio("__c", "whole"), F.lit(0.0)),
                       "precision": F.coalesce(ratio("__p", "__a"), F.lit(0.0))})
    f, p = F.col("fitness"), F.col("precision")
    return t.withColumn("f1", F.coalesce(ratio(2.0 * f * p, f + p), F.lit(0.0))) \
            .drop("__c", "__a", "__p", "whole")


def stake_and_coverage(rl: DataFrame, members: DataFrame) -> DataFrame:
    """grp, context, stake (share of the context's events), coverage (share of members)."""
    return _stake(context_counts(rl), members)


def _stake(counts, members):
    size = members.groupBy("grp").agg(F.countDistinct("resource").alias("size"))
    whole = counts.groupBy(*CTX).agg(F.sum("n").alias("whole"))
    own = counts.join(members.select("grp", "resource").distinct(), "resource").groupBy(
        "grp", *CTX).agg(F.sum("n").alias("own"), F.count(F.lit(1)).alias("people"))
    j = own.join(whole, CTX).join(size, "grp")
    return j.select("grp", *CTX, (F.col("own") / F.col("whole")).alias("stake"),
                    (F.col("people") / F.col("size")).alias("coverage"))


def full_recall(rl: DataFrame, members: DataFrame) -> DataFrame:
    """A group may do whatever any of its members did."""
    done = rl.select(*CTX, "resource").distinct()
    return done.join(members.select("grp", "resource"), "resource").select(
        "grp", F.col("case_type").alias("ct"), F.col("activity_type").alias("at"),
        F.col("time_type").alias("tt")).distinct()


GRID = [x / 10 for x in range(1, 10)]      # fixed values: weights and thresholds tried


def overall_score_grid(rl: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores per (w1, lam), capabilities per (w1, lam)) over the 9 x 9 grid.

    Stake and coverage are computed once; the grid only thresholds them.
    """
    counts = staged(context_counts(rl))     # read by every score below
    grid = F.array(*[F.struct(F.lit(w).alias("w1"), F.lit(x).alias("lam"))
                     for w in GRID for x in GRID])
    s = staged(_stake(counts, members)).withColumn("g", F.explode(grid)).select("*", "g.*")
    ok = s.filter(F.col("w1") * F.col("stake") + (1 - F.col("w1")) * F.col("coverage")
                  >= F.col("lam"))
    caps = ok.select("w1", "lam", "grp", F.col("case_type").alias("ct"),
                     F.col("activity_type").alias("at"), F.col("time_type").alias("tt"))
    return _conformance(counts, members, caps, ["w1", "lam"]), caps


def overall_score(rl: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(best grid row, its capabilities); full recall if no threshold leaves a model.

    The first of equal scores wins, by w1 and then lam.
    """
    scores, caps = overall_score_grid(rl, members)
    best = scores.orderBy(F.col("f1").desc(), "w1", "lam").limit(1)
    found = total(best, F.count(F.lit(1)))
    chosen = caps.join(F.broadcast(best.select("w1", "lam")), ["w1", "lam"]).drop("w1", "lam")
    spare = full_recall(rl, members).filter(found == 0)
    return best, chosen.unionByName(spare)


# ── lookups ─────────────────────────────────────────────────────────────────

def _keys(c, wild: str):
    """Lookup keys of an asked value: itself and the wildcard, or 'not asked'."""
    return F.when(F.col(c).isNull(), F.array(F.lit(ANY))).otherwise(
        F.array_distinct(F.array(F.lit(wild), F.col(c))))


def match_contexts(contexts: DataFrame, capabilities: DataFrame) -> DataFrame:
    """contexts (activity, case_type, time_type) with the groups that may do them.

    A wildcard capability admits every value and an unknown (null) asked value
    denies nothing. Both sides list the keys they match under, so the join is an
    equality on (activity, case key, time key).
    """
    ask = contexts.select("activity", "case_type", "time_type").distinct()
    ask = ask.withColumn("__ct", F.explode(_keys("case_type", ""))) \
             .withColumn("__tt", F.explode(_keys("time_type", "")))
    cap = capabilities.select("grp", F.regexp_replace("at", "^AT\\.", "").alias("activity"),
                              F.coalesce("ct", F.lit("")).alias("c"),
                              F.coalesce("tt", F.lit("")).alias("t"))
    cap = cap.withColumn("__ct", F.explode(F.array(F.col("c"), F.lit(ANY)))) \
             .withColumn("__tt", F.explode(F.array(F.col("t"), F.lit(ANY))))
    hit = ask.join(cap.select("grp", "activity", "__ct", "__tt").distinct(),
                   ["activity", "__ct", "__tt"])
    return hit.select("activity", "case_type", "time_type", "grp").distinct()


def _null_safe(a: DataFrame, b: DataFrame, cols, how: str) -> DataFrame:
    on = None
    for c in cols:
        e = a[c].eqNullSafe(b[c])
        on = e if on is None else on & e
    return a.join(b, on, how)


def backed_off_matches(contexts: DataFrame, capabilities: DataFrame) -> DataFrame:
    """``match_contexts``, with a second try without the case type for contexts whose
    (case type, activity) pair no weekday knows."""
    cols = ["activity", "case_type", "time_type"]
    ask = contexts.select(*cols).distinct()
    first = match_contexts(ask, capabilities)
    pairs = ask.select("activity", "case_type", F.lit(None).cast("string").alias("time_type")).distinct()
    known = match_contexts(pairs, capabilities).select("activity", "case_type").distinct()
    lost = _null_safe(ask, known, ["activity", "case_type"], "left_anti")
    again = match_contexts(lost.select("activity", F.lit(None).cast("string").alias("case_type"),
                                       "time_type"), capabilities)
    a, b = lost.alias("l"), again.alias("r")
    more = a.join(b, (F.col("l.activity") == F.col("r.activity"))
                  & F.col("l.time_type").eqNullSafe(F.col("r.time_type"))).select(
        "l.activity", "l.case_type", "l.time_type", "r.grp")
    return first.unionByName(more)


def candidates(contexts: DataFrame, members: DataFrame, capabilities: DataFrame) -> DataFrame:
    """activity, case_type, time_type, resource: who may work in each asked context."""
    m = backed_off_matches(contexts, capabilities)
    return m.join(members.select("grp", "resource"), "grp").select(
        "activity", "case_type", "time_type", "resource").distinct()


def candidate_counts(contexts: DataFrame, members: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Number of candidates per asked context (0 if none), and a sole candidate's name."""
    cols = ["activity", "case_type", "time_type"]
    sig = backed_off_matches(contexts, capabilities).groupBy(*cols).agg(
        F.sort_array(F.collect_set("grp")).alias("sig"))
    got = sig.join(_sizes(sig, members), "sig")
    ask = contexts.select(*cols).distinct()
    a, b = ask.alias("a"), got.alias("b")
    on = (F.col("a.activity") == F.col("b.activity")) & F.col("a.case_type").eqNullSafe(
        F.col("b.case_type")) & F.col("a.time_type").eqNullSafe(F.col("b.time_type"))
    j = a.join(b, on, "left")
    return j.select("a.activity", "a.case_type", "a.time_type",
                    F.coalesce("b.k", F.lit(0)).alias("n"),
                    F.when(F.col("b.k") == 1, F.col("b.one")).alias("sole"))


def permits(asked: DataFrame, members: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Add ``permitted`` to (resource, activity, case_type, time_type) rows."""
    cols = ["activity", "case_type", "time_type"]
    sig = backed_off_matches(asked, capabilities).groupBy(*cols).agg(
        F.collect_set("grp").alias("__sig"))
    prof = members.groupBy("resource").agg(F.collect_set("grp").alias("__prof"))
    a, b = asked.alias("a"), sig.alias("b")
    on = (F.col("a.activity") == F.col("b.activity")) & F.col("a.case_type").eqNullSafe(
        F.col("b.case_type")) & F.col("a.time_type").eqNullSafe(F.col("b.time_type"))
    j = a.join(b, on, "left").select("a.*", "b.__sig").join(prof, "resource", "left")
    return j.withColumn("permitted", F.coalesce(F.arrays_overlap("__sig", "__prof"), F.lit(False))) \
            .drop("__sig", "__prof")


def static_permits(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same for a flat (resource, activity) model."""
    p = pairs.select("resource", "activity").distinct().withColumn("__p", F.lit(True))
    return asked.join(p, ["resource", "activity"], "left").withColumn(
        "permitted", F.coalesce("__p", F.lit(False))).drop("__p")


def time_type(ts="timestamp"):
    """Weekday time type of a timestamp."""
    return F.concat(F.lit("TT."), F.date_format(ts, "EEEE"))


def groups_of(members: DataFrame) -> DataFrame:
    return members.groupBy("resource").agg(F.sort_array(F.collect_set("grp")).alias("groups"))


def model_activities(capabilities: DataFrame) -> DataFrame:
    return capabilities.select(F.regexp_replace("at", "^AT\\.", "").alias("activity")).distinct()


def vocabulary_overlap(capabilities: DataFrame) -> DataFrame:
    """One row: time types the model uses, and how many of them are weekday types."""
    t = capabilities.select("tt").filter("tt <> ''").distinct()
    return t.agg(F.count(F.lit(1)).alias("n_time_types"),
                 F.coalesce(F.sum(F.col("tt").isin(*TIME_TYPES).cast("int")), F.lit(0))
                 .alias("n_recognised"))


def self_check(capabilities: DataFrame) -> None:
    """Raise if the model has time types but none that a timestamp can produce."""
    row = vocabulary_overlap(capabilities).first()      # one aggregated row
    if row["n_time_types"] > 0 and row["n_recognised"] == 0:
        raise ValueError("the model's time types match no weekday: it would permit nothing")


def pool_comparison(df: DataFrame, members: DataFrame, capabilities: DataFrame,
                    case_type: str | None, time_type_: str | None) -> DataFrame:
    """Per activity: observed pool, model pool, novel and withheld pairs in one context."""
    obs = observed_permissions(df)
    ask = obs.select("activity").distinct().withColumns({
        "case_type": F.lit(case_type).cast("string"), "time_type": F.lit(time_type_).cast("string")})
    model = candidates(ask, members, capabilities).select("activity", "resource").withColumn(
        "m", F.lit(1))
    j = obs.withColumn("o", F.lit(1)).join(model, ["activity", "resource"], "full")
    o, m = F.col("o").isNotNull(), F.col("m").isNotNull()
    return j.groupBy("activity").agg(
        F.sum(o.cast("int")).alias("observed"), F.sum(m.cast("int")).alias("model"),
        F.sum((m & ~o).cast("int")).alias("novel"), F.sum((o & ~m).cast("int")).alias("withheld"))


def work_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: total-variation distance of the work over (resource, activity) pairs."""
    def share(df, name):
        p = pair_counts(df)
        return p.select("resource", "activity", ratio("n", total(p, F.sum("n"))).alias(name))
    j = share(a, "x").join(share(b, "y"), ["resource", "activity"], "full").na.fill(0.0, ["x", "y"])
    return j.agg((F.sum(F.abs(F.col("x") - F.col("y"))) * 0.5).alias("tvd"),
                 F.sum((F.col("x") > 0).cast("int")).alias("pairs_a"),
                 F.sum((F.col("y") > 0).cast("int")).alias("pairs_b"))


def group_work(df: DataFrame, members: DataFrame) -> DataFrame:
    """grp, activity, n, of_activity (share of the activity), of_group (share of the group)."""
    p = pair_counts(df).join(members.select("grp", "resource"), "resource").groupBy(
        "grp", "activity").agg(F.sum("n").alias("n"))
    return p.withColumns({
        "of_activity": ratio("n", F.sum("n").over(Window.partitionBy("activity"))),
        "of_group": ratio("n", F.sum("n").over(Window.partitionBy("grp")))})


def group_anatomy(df: DataFrame, members: DataFrame, share: float = 0.25, top: int = 4,
                  fallback: int = 3) -> DataFrame:
    """grp, n_events, n_members, signature: activities the group holds a commanding share
    of, else its busiest ones."""
    g = group_work(df, members)
    w1 = Window.partitionBy("grp").orderBy(F.col("of_activity").desc(), "activity")
    w2 = Window.partitionBy("grp").orderBy(F.col("n").desc(), "activity")
    g = g.withColumns({"r1": F.row_number().over(w1), "r2": F.row_number().over(w2)})
    sig = F.when((F.col("of_activity") >= share) & (F.col("r1") <= top),
                 F.struct("r1", "activity"))
    busy = F.when(F.col("r2") <= fallback, F.struct("r2", "activity"))
    out = g.groupBy("grp").agg(F.sum("n").alias("n_events"),
                               F.sort_array(F.collect_list(sig)).alias("s"),
                               F.sort_array(F.collect_list(busy)).alias("b"))
    size = members.groupBy("grp").agg(F.countDistinct("resource").alias("n_members"))
    names = F.when(F.size("s") > 0, F.transform("s", lambda x: x["activity"])).otherwise(
        F.transform("b", lambda x: x["activity"]))
    return out.join(size, "grp").select("grp", "n_events", "n_members",
                                        F.array_join(names, ", ").alias("signature"))


def group_distances(df: DataFrame, members: DataFrame) -> DataFrame:
    """grp, peer, score: total-variation distance (0-100) of two groups' work mixes."""
    g = group_work(df, members).withColumn("pct", F.col("of_group") * 100.0)
    return pairwise(dense(g, "grp", "activity", "pct"), "grp", "tv")


def group_handoffs(df: DataFrame, members: DataFrame) -> DataFrame:
    """grp, next_grp, n, pct of the group's hand-offs (row share)."""
    e = df.join(members.select("grp", "resource"), "resource")
    e = along(e, ["case_id"], [*order_of(df), "grp"], {"next_grp": following("grp")})
    c = e.filter(F.col("next_grp").isNotNull()).groupBy("grp", "next_grp").agg(
        F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", ratio(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy("grp"))))


def similar_peers(df: DataFrame, top: int = 5) -> DataFrame:
    """resource, peer, score, rank: cosine similarity of log-scaled activity profiles."""
    p = pair_counts(df).withColumn("w", F.log1p(F.col("n").cast("double")))
    return pairwise(dense(p, "resource", "activity", "w"), "resource", "cosine", top).filter(
        "score > 0")


def context_grid(capabilities: DataFrame) -> DataFrame:
    """Every activity with every case type and weekday the model distinguishes."""
    acts = model_activities(capabilities)
    types = capabilities.agg(F.collect_set(F.when(F.col("ct") != "", F.col("ct")))).scalar()
    g = acts.withColumn("__ct", types)
    g = g.withColumn("case_type", F.explode(F.when(F.size("__ct") > 0, F.col("__ct"))
                                            .otherwise(F.array(F.lit(None).cast("string")))))
    return g.select("activity", "case_type", F.explode(F.array(*[F.lit(t) for t in TIME_TYPES]))
                    .alias("time_type"))


def criticality(humans: DataFrame, members: DataFrame, capabilities: DataFrame,
                occupation: DataFrame, throughput: DataFrame) -> DataFrame:
    """Per human: occupation, throughput share, permission breadth, contexts where nobody
    else may work, and a weighted min-max score."""
    h = humans.select("resource").distinct()
    capabilities = staged(capabilities)     # the model is looked up from several sides
    staff = staged(members.join(h, "resource", "left_semi"))
    counts = candidate_counts(context_grid(capabilities), staff, capabilities)
    sole = counts.filter("n = 1").groupBy(F.col("sole").alias("resource")).agg(
        F.count(F.lit(1)).alias("sole_candidate_contexts"))
    acts = capabilities.select("grp", "at").distinct()
    prof = staff.groupBy("resource").agg(F.sort_array(F.collect_set("grp")).alias("p"))
    sets = prof.select("p").distinct()
    breadth = sets.select("p", F.explode("p").alias("grp")).join(acts, "grp").groupBy("p").agg(
        F.countDistinct("at").alias("permission_breadth"))
    j = (h.join(prof.join(breadth, "p").drop("p"), "resource", "left")
         .join(sole, "resource", "left")
         .join(occupation.select("resource", "occupation"), "resource", "left")
         .join(throughput.select("resource", F.col("share").alias("throughput_share")),
               "resource", "left")).na.fill(0)
    measures = (("occupation", 0.4), ("throughput_share", 0.4), ("permission_breadth", 0.2))
    ends = j.agg(*[f(c).alias(f"{t}_{c}") for c, _ in measures
                   for t, f in (("lo", F.min), ("hi", F.max))])
    score = F.lit(0.0)
    for c, weight in measures:
        lo, hi = ends.select(f"lo_{c}").scalar(), ends.select(f"hi_{c}").scalar()
        score = score + weight * F.coalesce(ratio(F.col(c) - lo, hi - lo), F.lit(0.0))
    return j.withColumn("criticality_score", score)


def sweep_row(rl: DataFrame, members: DataFrame, contexts: str, discovery: str,
              profiling: str) -> DataFrame:
    """One row of the model sweep: sizes and conformance of one configuration."""
    caps = full_recall(rl, members) if profiling == "FullRecall" else overall_score(rl, members)[1]
    n_ctx = rl.select(*CTX).distinct().agg(F.count(F.lit(1))).scalar()
    n_grp = total(caps, F.countDistinct("grp"))
    return conformance(rl, members, caps).select(
        F.lit(contexts).alias("contexts"), F.lit(discovery).alias("discovery"),
        F.lit(profiling).alias("profiling"), n_ctx.alias("n_contexts"), n_grp.alias("n_groups"),
        "fitness", "precision", "f1")


def best_models(rows: DataFrame, known: Sequence[str] = KNOWN_AT_START) -> DataFrame:
    """The best row by F1, and the best among contexts known at case start."""
    r = rows.withColumn("ok", F.col("contexts").isin(list(known)))
    order = [F.col("f1").desc(), "contexts", "discovery", "profiling"]
    a = rows.orderBy(*order).limit(1).withColumn("choice", F.lit("best"))
    b = r.filter("ok").drop("ok").orderBy(*order).limit(1).withColumn("choice", F.lit("deployable"))
    return a.unionByName(b)


def sweep(logs: dict[str, DataFrame], groups: dict[tuple[str, str], DataFrame],
          known: Sequence[str] = KNOWN_AT_START) -> DataFrame:
    """One row per (contexts, discovery, profiling): sizes, conformance and choices.

    ``logs`` holds a resource log (or its ``context_counts``) per form of contexts, ``groups``
    the members (grp, resource) per form and discovery. The counts of all forms are one table with the form
    as a part of its contexts, so all models, with the 81 thresholds of the overall score,
    are measured in one plan. Of equal scores the first thresholds win; without any model
    left the overall score falls back to full recall. ``best`` marks the row of the largest
    F1, ``deployable`` that among the forms ``known`` when a case starts; ties by name.
    """
    counts = reduce(DataFrame.unionByName, [
        context_counts(rl).withColumn("contexts", F.lit(f)) for f, rl in logs.items()])
    counts = staged(counts.withColumn("case_type", F.concat_ws(":", "contexts", "case_type")))
    members = staged(reduce(DataFrame.unionByName, [
        m.select(F.lit(f).alias("contexts"), F.lit(how).alias("discovery"),
                 F.concat_ws("/", F.lit(f), F.lit(how), F.col("grp").cast("string")).alias("grp"), "resource")
        for (f, how), m in groups.items()]).distinct())
    size = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    whole = counts.groupBy(*CTX).agg(F.sum("n").alias("of"))
    own = staged(counts.join(members, ["contexts", "resource"]).groupBy("contexts", "discovery", "grp", *CTX).agg(
        F.sum("n").alias("own"), F.count(F.lit(1)).alias("people")).join(whole, CTX).join(size, "grp"))
    grid = F.array(*[F.struct(F.lit(w).alias("w1"), F.lit(x).alias("lam")) for w in GRID for x in GRID])
    score = F.col("w1") * F.col("own") / F.col("of") + (1 - F.col("w1")) * F.col("people") / F.col("size")
    tried = own.withColumn("g", F.explode(grid)).select("*", "g.*").filter(score >= F.col("lam")) \
        .withColumn("profiling", F.lit("OverallScore"))
    every = own.withColumns({"w1": F.lit(0.0), "lam": F.lit(0.0), "profiling": F.lit("FullRecall")})
    by = ["contexts", "discovery", "profiling", "w1", "lam"]
    caps = staged(tried.select(*by, "grp", *CTX).unionByName(every.select(*by, "grp", *CTX)))
    scores = staged(_conformance(
        counts.drop("contexts"), members, caps.withColumnsRenamed({"case_type": "ct", "activity_type": "at",
                                                                   "time_type": "tt"}),
        by, counts.groupBy("contexts").agg(F.sum("n").alias("whole"))))
    model = ["contexts", "discovery", "profiling"]
    spare = scores.filter("profiling = 'FullRecall'")
    spare = spare.join(scores.filter("profiling = 'OverallScore'").select("contexts", "discovery").distinct(),
                       ["contexts", "discovery"], "left_anti").withColumn("profiling", F.lit("OverallScore"))
    sizes = caps.groupBy(*by).agg(F.countDistinct("grp").alias("n_groups"))
    spare_size = sizes.filter("profiling = 'FullRecall'").withColumn("profiling", F.lit("OverallScore"))
    rows = scores.join(sizes, by).unionByName(spare.join(spare_size, by))
    best = rows.groupBy(*model).agg(F.min(F.struct(
        (-F.col("f1")).alias("less"), "w1", "lam", "n_groups", "fitness", "precision", "f1")).alias("m")) \
        .select(*model, "m.n_groups", "m.fitness", "m.precision", "m.f1", "m.w1", "m.lam")
    n = counts.select("contexts", *CTX).distinct().groupBy("contexts").agg(F.count(F.lit(1)).alias("n_contexts"))
    out = staged(best.join(n, "contexts"))
    name = F.struct((-F.col("f1")).alias("less"), *model)
    lead = out.agg(F.min(name).alias("a"), F.min(F.when(F.col("contexts").isin(list(known)), name)).alias("b")).first()

    def is_row(m):
        return reduce(lambda x, y: x & y, [F.col(c) == m[c] for c in model]) if m else F.lit(False)
    return out.withColumns({"best": is_row(lead.a), "deployable": is_row(lead.b)}).select(
        *model, "n_contexts", "n_groups", "fitness", "precision", "f1", "w1", "lam", "best", "deployable")
