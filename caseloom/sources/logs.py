"""Event-log readers and writers (CSV, Parquet, XES) and log-level clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import LOCAL_ZONE, UNKNOWN, fractional_hour, monday_dow

# Column names a log may use, in order of preference.
ALIASES = {
    "case_id": ("case:concept:name", "case_id", "CaseID", "caseid"),
    "activity": ("concept:name", "activity", "Activity", "task"),
    "timestamp": ("time:timestamp", "timestamp", "Timestamp", "time"),
    "resource": ("org:resource", "resource", "Resource", "org:group"),
    "lifecycle": ("lifecycle:transition", "lifecycle", "Lifecycle"),
}
# Canonical name -> name in an exported log.
EXPORT_NAMES = {
    "case_id": "case:concept:name", "activity": "concept:name",
    "timestamp": "time:timestamp", "lifecycle": "lifecycle:transition",
    "resource": "org:resource",
}
# Text layouts tried after ISO 8601.
EXTRA_LAYOUTS = ("yyyy/MM/dd HH:mm:ss.SSSSSS", "yyyy/MM/dd HH:mm:ss",
                 "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm")


def resolve_columns(df: DataFrame) -> DataFrame:
    """Rename the first known alias of every log column to its canonical name."""
    renames = {}
    for name, options in ALIASES.items():
        for o in options:
            if o in df.columns:
                renames[o] = name
                break
    return df.withColumnsRenamed(renames)


def utc_wall_clock(instant: Column) -> Column:
    """A TIMESTAMP as TIMESTAMP_NTZ in UTC, whatever the session zone."""
    secs = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=secs)


def parsed_timestamp(text: Column) -> Column:
    """Text in any of the accepted layouts as UTC wall-clock time, else null.

    Text without an offset is read as UTC.
    """
    t = F.trim(text)
    zoned = F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & t.rlike(r"\d:\d"), t) \
             .when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(t, F.lit("T00:00:00Z"))) \
             .otherwise(F.concat(t, F.lit("Z")))
    tries = [utc_wall_clock(zoned.try_cast("timestamp"))]
    for layout in EXTRA_LAYOUTS:
        tries.append(utc_wall_clock(
            F.try_to_timestamp(F.concat(t, F.lit("Z")), F.lit(layout + "X"))))
    return F.coalesce(*tries)


def parse_timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Parse a text (or timestamp) column; rows that cannot be parsed are dropped."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        df = df.withColumn(column, parsed_timestamp(F.col(column)))
    elif isinstance(kind, T.TimestampType):
        df = df.withColumn(column, utc_wall_clock(F.col(column)))
    return df.filter(F.col(column).isNotNull())


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file or folder (plain or gzip) as text columns; only ``columns`` if given.

    No schema inference: that would read the data twice. The header row of the
    first file gives the names, so naming the columns prunes the parse.
    """
    df = (spark.read.option("header", True).option("escape", '"')
          .option("enforceSchema", True).csv(path))
    if columns is not None:
        df = df.select(*[f"`{c}`" for c in df.columns if c in columns])
    return df


XES_TYPES = ("string", "date", "int", "float", "boolean")
_ATTR = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()),
                                  T.StructField("_value", T.StringType())]))
_EVENT = T.StructType([T.StructField(t, _ATTR) for t in XES_TYPES])
XES_TRACE = T.StructType([T.StructField(t, _ATTR) for t in XES_TYPES]
                         + [T.StructField("event", T.ArrayType(_EVENT))])


def _attributes(prefix: str = "") -> Column:
    lists = [F.coalesce(F.col(prefix + t), F.array().cast(_ATTR)) for t in XES_TYPES]
    entries = F.filter(F.concat(*lists), lambda a: a["_key"].isNotNull())
    return F.map_from_entries(F.transform(
        entries, lambda a: F.struct(a["_key"], a["_value"])))


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """XES (plain or gzip) as one row per event, split by trace element.

    Trace attributes come out in the map ``case_attributes``, event attributes in
    ``event_attributes``; ``source_order`` is the place of the event in its trace.
    """
    traces = (spark.read.format("xml").option("rowTag", "trace")
              .option("mode", "PERMISSIVE").schema(XES_TRACE).load(path))
    ev = traces.select(_attributes().alias("case_attributes"),
                       F.posexplode("event").alias("source_order", "e"))
    ev = ev.select("case_attributes", "source_order", *[F.col(f"e.{t}").alias(t)
                                                        for t in XES_TYPES])
    ev = ev.select("case_attributes", "source_order", _attributes().alias("event_attributes"))
    at = F.col("event_attributes")
    return ev.select(
        F.col("case_attributes")["concept:name"].alias("case_id"),
        at["concept:name"].alias("activity"), at["time:timestamp"].alias("timestamp"),
        at["org:resource"].alias("resource"),
        F.lower(F.coalesce(at["lifecycle:transition"], F.lit("complete"))).alias("lifecycle"),
        F.col("source_order").cast("bigint").alias("source_order"),
        "case_attributes", "event_attributes")


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """Read a log by file type, name its columns and parse its timestamps.

    ``.xes``/``.xes.gz``, ``.parquet`` or CSV. The caller numbers events per case
    with ``operators.shape.number_events``.
    """
    low = path.lower().rstrip("/")
    if low.endswith((".xes", ".xes.gz")):
        df = read_xes(spark, path)
    elif low.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif low.endswith((".csv", ".csv.gz", ".gz")):
        df = read_csv(spark, path)
    else:
        raise ValueError(f"unsupported log type: {path}; use .xes, .xes.gz, .csv or .parquet")
    return parse_timestamps(resolve_columns(df))


def strict_log(df: DataFrame) -> DataFrame:
    """The trainer's contract: required columns checked, resource filled, types fixed."""
    df = resolve_columns(df)
    missing = [c for c in ("case_id", "activity", "timestamp", "lifecycle")
               if c not in df.columns]
    if missing:
        raise ValueError(f"log is missing required columns: {missing}")
    if "resource" not in df.columns:
        df = df.withColumn("resource", F.lit(UNKNOWN))
    keep = [c for c in ("event_order", "source_order") if c in df.columns]
    return parse_timestamps(df).select(
        F.col("case_id").cast("string").alias("case_id"),
        F.col("activity").cast("string").alias("activity"), "timestamp",
        F.coalesce(F.col("resource").cast("string"), F.lit(UNKNOWN)).alias("resource"),
        F.lower(F.col("lifecycle").cast("string")).alias("lifecycle"), *keep)


def local_calendar(df: DataFrame, zone: str = LOCAL_ZONE, first_year: int = 2016) -> DataFrame:
    """Wall-clock local time with ``date``, fractional ``hour`` and Monday-0 ``dow``.

    Events before ``first_year`` are epoch artefacts and are dropped.
    """
    df = df.withColumn("timestamp", F.convert_timezone(
        F.lit("UTC"), F.lit(zone), F.col("timestamp")))
    return (df.filter(F.year("timestamp") >= first_year)
            .withColumn("date", F.to_date("timestamp"))
            .withColumn("hour", fractional_hour("timestamp"))
            .withColumn("dow", monday_dow("timestamp")))


def read_arrivals(spark: SparkSession, path: str, column: str = "arrival") -> DataFrame:
    """One timestamp column from Parquet or CSV."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") \
        else read_csv(spark, path, [column])
    return parse_timestamps(df.select(F.col(f"`{column}`").alias("arrival")), "arrival")


def write_log(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write a log as CSV with the exported column names, ISO timestamps."""
    out = df.withColumn("timestamp", F.date_format(
        "timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    out = out.withColumnsRenamed({k: v for k, v in EXPORT_NAMES.items() if k in out.columns})
    (out.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("compression", compression).csv(path))


def write_results(df: DataFrame, path: str) -> None:
    """Write a result table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_case_ids(spark: SparkSession, path: str) -> DataFrame:
    """One case id per text line; blank lines are skipped."""
    ids = spark.read.text(path).select(F.trim("value").alias("case_id"))
    return ids.filter(F.col("case_id") != "").distinct()
