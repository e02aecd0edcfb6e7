"""Fitted models as JSON documents and as long tables.

A document holds parameters, not events, so its size follows the number of
activities and resources; it is read with a fixed schema and taken apart with
``explode``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import staged

FIT = ("struct<distribution:string,params:array<double>,mean_s:double,std_s:double,"
       "n:bigint,zero_prob:double,p99_s:double,overall_mean_s:double>")
REFERENCE = (
    "activity_counts map<string,bigint>, "
    f"processing_times map<string,{FIT}>, "
    "branching_probs map<string,map<string,double>>, "
    "branching_probs_by_visit map<string,map<string,map<string,double>>>, "
    "process_variants struct<total_variants:bigint,"
    "top_20:array<struct<rank:int,frequency:bigint,pct:double,trace:string>>>, "
    f"lifecycle struct<processing_times:map<string,{FIT}>,"
    "session_end_probs:map<string,double>,suspend_end_probs:map<string,double>,"
    f"resume_gap_params:map<string,{FIT}>,withdraw_hazard:map<string,{FIT}>>")
CALENDAR = ("windows map<string,map<string,array<double>>>, p_work map<string,map<string,double>>,"
            " holidays array<string>, vacations map<string,array<string>>, system array<string>")
ORG_MODEL = ("kind string, groups array<struct<members:array<string>,"
             "capabilities:array<array<string>>>>")
STATIC = "kind string, permissions map<string,array<string>>"


def nested(df: DataFrame, keys: list[str], value: str, name: str, kept: int = 0) -> DataFrame:
    """Fold a long table (keys..., value) into one row with one nested map column, or one
    row for each value of the first ``kept`` keys."""
    left = list(keys)
    cur = df.select(*left, F.col(value).alias("__v"))
    while len(left) > kept:
        k = left.pop()
        entry = F.struct(F.col(k).cast("string").alias("k"), F.col("__v").alias("v"))
        cur = cur.groupBy(*left).agg(
            F.map_from_entries(F.array_sort(F.collect_list(entry), _by_key)).alias("__v"))
    return cur.withColumnRenamed("__v", name)


def _by_key(a, b):
    return F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)


def write_json(df: DataFrame, path: str) -> None:
    """Write documents as JSON, each row in a file of its own."""
    df.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def _doc(spark, path, schema):
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_reference(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A mined reference document as long tables.

    If the document has a lifecycle block, its active-session processing times
    replace the top-level ones.
    """
    doc = _doc(spark, path, REFERENCE)
    times = F.coalesce(F.col("lifecycle.processing_times"), F.col("processing_times"))
    t = doc.select(F.explode(times).alias("activity", "f"))
    b = doc.select(F.explode("branching_probs").alias("activity", "d"))
    v = (doc.select(F.explode("branching_probs_by_visit").alias("activity", "m"))
         .select("activity", F.explode("m").alias("bucket", "d")))
    return {
        "processing_times": t.select("activity", "f.*"),
        "branching": b.select("activity", F.explode("d").alias("next_activity", "p")),
        "branching_by_visit": v.select(
            "activity", "bucket", F.explode("d").alias("next_activity", "p")),
        "variants": doc.select(F.explode("process_variants.top_20").alias("v")).select("v.*"),
        "mode": doc.select(F.when(F.col("lifecycle").isNotNull(), "active")
                           .otherwise("legacy").alias("mode")),
        "document": doc,
    }


_FIT = (("distribution", "string"), ("params", "array<double>"), ("mean_s", "double"), ("std_s", "double"),
        ("n", "bigint"), ("zero_prob", "double"), ("p99_s", "double"), ("overall_mean_s", "double"))


def _fits(df: DataFrame, name: str) -> DataFrame:
    """Fits (activity, distribution, params, ...) as one map; what is not known is left out."""
    f = F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in _FIT])
    return nested(df.select("activity", f.alias("f")), ["activity"], "f", name)


def reference_document(activity_counts: DataFrame, processing_times: DataFrame, branching: DataFrame,
                       by_visit: DataFrame, variants: DataFrame, active_times: DataFrame | None = None,
                       session_end: DataFrame | None = None, suspend_end: DataFrame | None = None,
                       resume_gaps: DataFrame | None = None, withdraws: DataFrame | None = None) -> DataFrame:
    """All mined tables as one JSON-ready row that ``read_reference`` takes apart again.

    ``activity_counts`` is (activity, n), ``branching`` (activity, next_activity, p),
    ``by_visit`` the same with visit_bucket, ``variants`` (rank, frequency, pct, trace,
    total_variants), ``session_end`` (activity, p_complete), ``suspend_end`` (activity,
    p_resume); the others are fits by activity. The lifecycle block is written if
    ``active_times`` is given; its other tables may be missing.
    """
    top = variants.agg(
        F.max("total_variants").cast("bigint").alias("total_variants"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "frequency", "pct", "trace"))),
                    lambda v: v).alias("top_20"))
    out = nested(activity_counts, ["activity"], "n", "activity_counts").select(
        "activity_counts", _fits(processing_times, "f").scalar().alias("processing_times"),
        nested(branching.select("activity", "next_activity", "p"), ["activity", "next_activity"], "p", "m")
        .scalar().alias("branching_probs"),
        nested(by_visit.select("activity", "visit_bucket", "next_activity", "p"),
               ["activity", "visit_bucket", "next_activity"], "p", "m").scalar().alias("branching_probs_by_visit"),
        top.select(F.struct("total_variants", "top_20").alias("v")).scalar().alias("process_variants"))
    if active_times is None:
        return out
    blocks = {"processing_times": _fits(active_times, "f")}
    for name, df, p in (("session_end_probs", session_end, "p_complete"),
                        ("suspend_end_probs", suspend_end, "p_resume")):
        if df is not None:
            blocks[name] = nested(df.select("activity", p), ["activity"], p, "m")
    for name, df in (("resume_gap_params", resume_gaps), ("withdraw_hazard", withdraws)):
        if df is not None:
            blocks[name] = _fits(df, "f")
    return out.withColumn("lifecycle", F.struct(*[b.scalar().alias(n) for n, b in blocks.items()]))


def lifecycle_parameters(document: DataFrame) -> DataFrame:
    """Per activity: hazards, resume-gap and withdraw fits of the lifecycle block."""
    lf = document.select("lifecycle.*")
    parts = []
    for name, c in (("session_end_prob", "session_end_probs"),
                    ("suspend_end_prob", "suspend_end_probs")):
        parts.append(lf.select(F.explode(c).alias("activity", "value")).select(
            "activity", F.lit(name).alias("parameter"),
            F.lit(None).cast("string").alias("distribution"),
            F.lit(None).cast("array<double>").alias("params"), "value"))
    for name, c in (("processing_time", "processing_times"),
                    ("resume_gap", "resume_gap_params"), ("withdraw", "withdraw_hazard")):
        parts.append(lf.select(F.explode(c).alias("activity", "f")).select(
            "activity", F.lit(name).alias("parameter"),
            F.coalesce("f.distribution", F.lit("expon")).alias("distribution"),
            F.coalesce("f.params", F.array(F.lit(0.0), F.lit(600.0))).alias("params"),
            F.coalesce("f.zero_prob", F.lit(0.0)).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_calendar(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A fitted calendar, of one document or of many, as the tables windows, holidays,
    vacations, system."""
    doc = _doc(spark, path, CALENDAR)
    w = (doc.select(F.explode("windows").alias("resource", "m"), "p_work")
         .select("resource", F.explode("m").alias("d", "w"), "p_work"))
    return {
        "windows": w.select(
            "resource", F.col("d").cast("int").alias("dow"), F.col("w")[0].alias("open_h"),
            F.col("w")[1].alias("close_h"),
            F.col("p_work")[F.col("resource")][F.col("d")].alias("p_work")),
        "holidays": doc.select(F.explode("holidays").alias("d")).select(F.col("d").cast("date").alias("date")),
        "vacations": doc.select(F.explode("vacations").alias("resource", "d")).select(
            "resource", F.explode(F.col("d").cast("array<date>")).alias("date")),
        "system": doc.select(F.explode("system").alias("resource")),
    }


PART = 2048     # resources in one calendar document, about


def calendar_document(windows: DataFrame, holidays: DataFrame, vacations: DataFrame,
                      system: DataFrame) -> DataFrame:
    """The calendar tables as JSON-ready rows of some ``PART`` resources each.

    Few resources make one row. More are dealt by a hash of their names, so that no task
    holds the calendar of all; the first row has the holidays. ``write_json`` writes a
    document a row and ``read_calendar`` reads them all.
    """
    names = [df.select("resource") for df in (windows, vacations, system)]
    n = names[0].union(names[1]).union(names[2]).agg(F.countDistinct("resource").alias("n")).select(
        F.greatest(F.lit(1), F.ceil(F.col("n") / PART)).cast("int").alias("n"))
    n = staged(n).scalar()

    def dealt(df):
        return df.withColumn("__part", F.pmod(F.hash("resource"), n))

    def folded(df, value, name):
        return nested(dealt(df), ["__part", "resource", "dow"], value, name, 1)
    win = folded(windows.select("resource", "dow", F.array("open_h", "close_h").alias("w")), "w", "windows")
    pw = folded(windows.select("resource", "dow", "p_work"), "p_work", "p_work")
    vac = vacations.groupBy("resource").agg(
        F.sort_array(F.collect_set(F.col("date").cast("string"))).alias("d"))
    vac = nested(dealt(vac), ["__part", "resource"], "d", "vacations", 1)
    sys = dealt(system).groupBy("__part").agg(F.sort_array(F.collect_set("resource")).alias("system"))
    days = holidays.agg(F.sort_array(F.collect_set(F.col("date").cast("string")))).scalar()
    parts = windows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), n - 1)).alias("__part"))
    for df in (win, pw, vac, sys):
        parts = parts.join(df, "__part", "left")
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(CALENDAR).fields}

    def or_none(c):
        return F.coalesce(c, F.create_map().cast(kinds[c]) if isinstance(kinds[c], T.MapType)
                          else F.array().cast(kinds[c])).alias(c)
    return parts.select(
        or_none("windows"), or_none("p_work"),
        F.when(F.col("__part") == 0, days).otherwise(F.array().cast("array<string>")).alias("holidays"),
        or_none("vacations"), or_none("system"))


def read_org_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An organisational model as members(grp, resource) and capabilities(grp, ct, at, tt)."""
    g = _doc(spark, path, ORG_MODEL).select(F.posexplode("groups").alias("grp", "g"))
    cap = g.select("grp", F.explode("g.capabilities").alias("c"))
    return {
        "members": g.select("grp", F.explode("g.members").alias("resource")),
        "capabilities": cap.select("grp", F.col("c")[0].alias("ct"), F.col("c")[1].alias("at"),
                                   F.col("c")[2].alias("tt")),
    }


def org_model_document(members: DataFrame, capabilities: DataFrame) -> DataFrame:
    """members + capabilities as one JSON-ready row; activity labels lose their prefix."""
    m = members.groupBy("grp").agg(F.sort_array(F.collect_set("resource")).alias("members"))
    at = F.regexp_replace("at", "^AT\\.", "")
    c = capabilities.groupBy("grp").agg(F.sort_array(F.collect_set(F.array(
        F.coalesce("ct", F.lit("")), at, F.coalesce("tt", F.lit(""))))).alias("capabilities"))
    g = m.join(c, "grp", "left").select("grp", F.struct(
        "members", F.coalesce("capabilities", F.array().cast("array<array<string>>"))
        .alias("capabilities")).alias("g"))
    return g.agg(F.lit("org_model").alias("kind"),
                 F.transform(F.array_sort(F.collect_list(F.struct("grp", "g"))),
                             lambda x: x["g"]).alias("groups"))


def read_static(spark: SparkSession, path: str) -> DataFrame:
    """A resource -> activities map as (resource, activity)."""
    doc = _doc(spark, path, STATIC)
    return (doc.select(F.explode("permissions").alias("resource", "a"))
            .select("resource", F.explode("a").alias("activity")))


def static_document(pairs: DataFrame) -> DataFrame:
    acts = pairs.groupBy("resource").agg(F.sort_array(F.collect_set("activity")).alias("a"))
    return nested(acts, ["resource"], "a", "permissions").select(
        F.lit("static").alias("kind"), "permissions")


def read_permissions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Whichever kind of permission model is stored at ``path``."""
    kind = spark.read.schema("kind string").option("multiLine", True).json(path).first()
    if kind is not None and kind["kind"] == "org_model":
        return read_org_model(spark, path)
    return {"static": read_static(spark, path)}
