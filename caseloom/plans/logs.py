"""S: sources and sinks."""

from pyspark.sql import functions as F

from ..functions.columns import micros, rounded
from ..operators.shape import restrict_to_cases
from ..sources import fitted, logs
from .base import (lifecycle_log, presence_log, query, scratch, simple_log)

EPOCH = "epoch_us(\"timestamp\")"


def _summary(df):
    """Order-free content check of a log, per activity."""
    return df.groupBy("activity").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("case_id").alias("cases"),
        F.countDistinct("resource").alias("resources"),
        F.min(micros("timestamp")).alias("first_us"), F.max(micros("timestamp")).alias("last_us"))


SUMMARY = """select activity, count(*) as n, count(distinct case_id) as cases,
    count(distinct resource) as resources, min(epoch_us("timestamp")) as first_us,
    max(epoch_us("timestamp")) as last_us from {%s} group by activity"""


@query("S1_read_csv", SUMMARY % "lc")
def s1(spark, d):
    path = scratch(spark) + ".csv"
    logs.write_log(lifecycle_log(spark, d), path)
    return _summary(logs.load_log(spark, path))


@query("S2_read_xes", SUMMARY % "lc")
def s2(spark, d):
    path = scratch(spark) + ".xes"
    log = lifecycle_log(spark, d)

    def attr(key, c):
        return F.struct(F.lit(key).alias("_key"), F.col(c).alias("_value"))
    log = log.withColumn("iso", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    event = F.struct(
        F.array(attr("concept:name", "activity"), attr("org:resource", "resource"),
                attr("lifecycle:transition", "lifecycle")).alias("string"),
        F.array(attr("time:timestamp", "iso")).alias("date"))
    # a trace element per case and day keeps elements small for long cases
    traces = log.groupBy("case_id", F.to_date("timestamp").alias("day")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "event_order",
                                                         event.alias("e")))),
                    lambda x: x["e"]).alias("event"))
    traces = traces.select(F.array(attr("concept:name", "case_id")).alias("string"), "event")
    (traces.write.format("xml").option("rowTag", "trace").option("rootTag", "log")
     .mode("overwrite").save(path))
    return _summary(logs.load_log(spark, path))


@query("S3_read_arrivals", """select count(*) as n, min(epoch_us(t)) as first_us,
    max(epoch_us(t)) as last_us from (select min("timestamp") as t from {simple} group by case_id)""")
def s3(spark, d):
    path = scratch(spark) + ".parquet"
    simple_log(spark, d).groupBy("case_id").agg(F.min("timestamp").alias("arrival")) \
        .write.parquet(path)
    return logs.read_arrivals(spark, path).agg(
        F.count(F.lit(1)).alias("n"), F.min(micros("arrival")).alias("first_us"),
        F.max(micros("arrival")).alias("last_us"))


@query("S4_column_aliases", SUMMARY % "simple")
def s4(spark, d):
    raw = simple_log(spark, d).withColumnsRenamed({
        "case_id": "case:concept:name", "activity": "task", "timestamp": "time:timestamp",
        "resource": "org:group"})
    return _summary(logs.resolve_columns(raw))


@query("S5_pruned_csv", "select activity, lifecycle, count(*) as n from {lc} group by all")
def s5(spark, d):
    path = scratch(spark) + ".csv"
    logs.write_log(lifecycle_log(spark, d), path)
    df = logs.read_csv(spark, path, ["concept:name", "lifecycle:transition"])
    return logs.resolve_columns(df).groupBy("activity", "lifecycle").agg(
        F.count(F.lit(1)).alias("n"))


@query("S6_mixed_timestamps", """select event_order % 6 as layout, count(*) as n,
    min(epoch_us(t)) as first_us, max(epoch_us(t)) as last_us
    from (select event_order, case event_order % 6 when 2 then date_trunc('second', "timestamp")
          when 3 then date_trunc('minute', "timestamp") when 4 then date_trunc('day', "timestamp")
          else "timestamp" end as t from {simple} where event_order % 6 <> 5) group by 1""")
def s6(spark, d):
    t = F.col("timestamp")
    ahead = t + F.expr("interval 2 hours")
    text = (F.when(F.col("event_order") % 6 == 0,
                   F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
            .when(F.col("event_order") % 6 == 1,
                  F.date_format(ahead, "yyyy-MM-dd HH:mm:ss.SSSSSS'+02:00'"))
            .when(F.col("event_order") % 6 == 2, F.date_format(t, "yyyy/MM/dd HH:mm:ss"))
            .when(F.col("event_order") % 6 == 3, F.date_format(t, "MM/dd/yyyy HH:mm"))
            .when(F.col("event_order") % 6 == 4, F.date_format(t, "yyyy-MM-dd"))
            .otherwise(F.lit("not a time")))
    df = logs.parse_timestamps(simple_log(spark, d).withColumn("timestamp", text))
    return df.groupBy((F.col("event_order") % 6).alias("layout")).agg(
        F.count(F.lit(1)).alias("n"), F.min(micros("timestamp")).alias("first_us"),
        F.max(micros("timestamp")).alias("last_us"))


@query("S7_local_calendar", """select cast(cast(l as date) as varchar) as "date",
    cast(isodow(l) - 1 as int) as dow, count(*) as n,
    round(sum(hour(l) + minute(l) / 60.0 + second(l) / 3600.0), 3) as hours
    from (select timezone('Europe/Amsterdam', timezone('UTC', "timestamp")) as l from {simple})
    where year(l) >= 2016 group by 1, 2""")
def s7(spark, d):
    df = logs.local_calendar(simple_log(spark, d))
    return rounded(df.groupBy(F.col("date").cast("string").alias("date"), "dow").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hour").alias("hours")), 3)


BRANCH = """select activity, next_activity, round(count(*) / sum(count(*)) over
    (partition by activity), 6) as p from (select activity, lead(activity) over
    (partition by case_id order by "timestamp", event_order) as next_activity from {simple})
    where next_activity is not null group by 1, 2"""


def _reference_doc(spark, d):
    from ..operators import stats
    b = stats.branching(simple_log(spark, d))
    return fitted.nested(b, ["activity", "next_activity"], "p", "branching_probs")


@query("S8_read_reference", BRANCH)
def s8(spark, d):
    path = scratch(spark) + ".json"
    fitted.write_json(_reference_doc(spark, d), path)
    return rounded(fitted.read_reference(spark, path)["branching"])


@query("S9_write_model", """select activity, count(*) as targets, round(sum(p), 4) as mass
    from (""" + BRANCH + ") group by 1")
def s9(spark, d):
    path = scratch(spark) + ".json"
    fitted.write_json(_reference_doc(spark, d), path)
    back = spark.read.schema("branching_probs map<string,map<string,double>>").json(path)
    m = back.select(F.explode("branching_probs").alias("activity", "d")) \
        .select("activity", F.explode("d").alias("t", "p"))
    return rounded(m.groupBy("activity").agg(F.count(F.lit(1)).alias("targets"),
                                             F.sum("p").alias("mass")), 4)


@query("S10_write_log", """select activity, lifecycle, resource, count(*) as n
    from {lc} group by all""")
def s10(spark, d):
    path = scratch(spark) + ".csv"
    logs.write_log(lifecycle_log(spark, d), path, compression="none")
    back = logs.read_csv(spark, path)
    return back.groupBy(F.col("`concept:name`").alias("activity"),
                        F.col("`lifecycle:transition`").alias("lifecycle"),
                        F.col("`org:resource`").alias("resource")).agg(
        F.count(F.lit(1)).alias("n"))


@query("S11_completed_cases", """select activity, count(*) as n from {simple}
    where case_id in (select case_id from {simple} where activity = 'purchase'
    group by 1 having count(*) >= 10) group by 1""")
def s11(spark, d):
    path = scratch(spark) + ".txt"
    log = simple_log(spark, d)
    (log.filter("activity = 'purchase'").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
     .filter("n >= 10").select("case_id").write.text(path))
    done = logs.read_case_ids(spark, path)
    return restrict_to_cases(log, done).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@query("S12_load_models", """select resource, cast(isodow(day) - 1 as int) as dow,
    round(min(h), 6) as open_h, round(max(h), 6) as close_h from
    (select resource, cast("timestamp" as date) as day, hour("timestamp")
     + minute("timestamp") / 60.0 + second("timestamp") / 3600.0 as h from {seen})
    group by 1, 2""")
def s12(spark, d):
    from ..functions.columns import fractional_hour, monday_dow
    log = presence_log(spark, d)
    win = log.groupBy("resource", monday_dow("timestamp").alias("dow")).agg(
        F.min(fractional_hour("timestamp")).alias("open_h"),
        F.max(fractional_hour("timestamp")).alias("close_h"), F.lit(1.0).alias("p_work"))
    days = log.select("resource", F.to_date("timestamp").alias("date"))
    doc = fitted.calendar_document(win, days.select("date"), days, days.select("resource"))
    path = scratch(spark) + ".json"
    fitted.write_json(doc, path)
    back = fitted.read_calendar(spark, path)["windows"]
    return rounded(back.select("resource", "dow", "open_h", "close_h"))
