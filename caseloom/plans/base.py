"""Registry of named queries and the event logs they read.

Every log is derived from a whole given table; the SQL twin of each derivation
is a common table expression with the same name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import scratch  # noqa: F401

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ── logs ────────────────────────────────────────────────────────────────────

def _k():
    return F.get_json_object("props", "$.k").cast("int")


def simple_log(spark, d) -> DataFrame:
    """events as a log: case = user, activity = event type, order key = event id."""
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("case_id"),
        F.col("event_type").alias("activity"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("R"), (_k() % 20).cast("string")).alias("resource"),
        F.col("event_id").alias("event_order"),
        "value")


def lifecycle_log(spark, d) -> DataFrame:
    """events as a transactional log with W_/A_/O_ activities and seven transitions."""
    e = table(spark, d, "events").withColumn("k", _k())
    r = F.col("k") % 5
    t = F.col("event_type")
    return e.select(
        F.col("user_id").cast("string").alias("case_id"),
        F.when(r == 0, F.concat(F.lit("A_"), t)).when(r == 1, F.concat(F.lit("O_"), t))
         .otherwise(F.concat(F.lit("W_"), r.cast("string"))).alias("activity"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("R"), (F.col("k") % 20).cast("string")).alias("resource"),
        F.when(r.isin(0, 1), "complete").when(t == "signup", "schedule")
         .when(t == "click", "start").when(t == "error", "suspend")
         .when(t == "view", "resume").when(F.col("value") < 8, "withdraw")
         .when(F.col("value") < 20, "ate_abort").otherwise("complete").alias("lifecycle"),
        F.col("event_id").alias("event_order"),
        "value")


def item_log(spark, d) -> DataFrame:
    """The transactional log with a work-item id per case, activity and 8-day stretch."""
    return lifecycle_log(spark, d).withColumn(
        "work_item_id", F.concat_ws(
            "-", "case_id", "activity",
            F.floor(F.dayofmonth("timestamp") / F.lit(8)).cast("string")))


def orders_log(spark, d) -> DataFrame:
    """orders as a log: case = customer, activity = priority, daily timestamps."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("case_id"),
        F.col("o_orderpriority").alias("activity"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderkey").alias("event_order"),
        F.col("o_orderstatus").alias("application_type"),
        F.col("o_orderpriority").alias("loan_goal"),
        F.col("o_totalprice").alias("requested_amount"))


def chat_log(spark, d) -> DataFrame:
    """conversations as a log: case = conversation, activity = role, order = turn."""
    return table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("case_id"),
        F.col("role").alias("activity"),
        F.col("turn").alias("event_order"))


def presence_log(spark, d) -> DataFrame:
    """Events as presence signals: resource = user and event type."""
    return table(spark, d, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("resource"),
        F.col("ts").alias("timestamp"), F.col("event_id").alias("event_order"))


def ship_log(spark, d) -> DataFrame:
    """Shipments as presence signals: resource = supplier, daily dates."""
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("resource"),
        F.to_date("l_shipdate").alias("date"))


K = "cast(json_extract(props, '$.k') as int)"
LOGS = {
    "simple": f"""select cast(user_id as varchar) as case_id, event_type as activity,
        ts as "timestamp", 'R' || ({K} % 20) as resource, event_id as event_order, value
        from events""",
    "lc": f"""select cast(user_id as varchar) as case_id,
        case when k % 5 = 0 then 'A_' || event_type when k % 5 = 1 then 'O_' || event_type
             else 'W_' || (k % 5) end as activity,
        ts as "timestamp", 'R' || (k % 20) as resource,
        case when k % 5 in (0, 1) then 'complete'
             when event_type = 'signup' then 'schedule' when event_type = 'click' then 'start'
             when event_type = 'error' then 'suspend' when event_type = 'view' then 'resume'
             when value < 8 then 'withdraw' when value < 20 then 'ate_abort'
             else 'complete' end as lifecycle,
        event_id as event_order, value
        from (select *, {K} as k from events)""",
    "items": """select *, case_id || '-' || activity || '-'
        || cast(day("timestamp") // 8 as varchar) as work_item_id from lc""",
    "olog": """select cast(o_custkey as varchar) as case_id, o_orderpriority as activity,
        o_orderdate as "timestamp", o_orderkey as event_order,
        o_orderstatus as application_type, o_orderpriority as loan_goal,
        o_totalprice as requested_amount from orders""",
    "chat": """select cast(conv_id as varchar) as case_id, role as activity,
        turn as event_order from conversations""",
    "seen": """select cast(user_id as varchar) || '-' || event_type as resource, ts as "timestamp",
        event_id as event_order from events""",
    "ships": """select cast(l_suppkey as varchar) as resource,
        cast(l_shipdate as date) as "date" from lineitem""",
}
NEEDS = {"items": ["lc"]}
PARTS: dict[str, str] = {}      # further shared CTEs, registered by the query modules
PART_NEEDS: dict[str, list[str]] = {}


def part(name: str, sql: str, *needs: str):
    PARTS[name] = sql
    PART_NEEDS[name] = list(needs)


def with_logs(sql: str) -> str:
    """Prefix the CTEs a query names with ``{{log}}`` markers, dependencies first."""
    wanted, body = [], sql

    def visit(n):
        text = LOGS.get(n) or PARTS[n]
        for m in re.findall(r"\{(\w+)\}", text):
            visit(m)
        for m in NEEDS.get(n, []) + PART_NEEDS.get(n, []):
            visit(m)
        if n not in wanted:
            wanted.append(n)

    for n in re.findall(r"\{(\w+)\}", body):
        visit(n)
    body = re.sub(r"\{(\w+)\}", r"\1", body).strip()
    if not wanted:
        return body
    ctes = ",\n".join(
        f"{n} as ({re.sub(r'{(' + chr(92) + 'w+)}', chr(92) + '1', LOGS.get(n) or PARTS[n])})"
        for n in wanted)
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{body[len('with recursive'):].lstrip()}"
    if body.lower().startswith("with"):
        return f"with {ctes},\n{body[4:].lstrip()}"
    return f"with {ctes}\n{body}"


def secs(a: str, b: str) -> str:
    """SQL text: seconds from a to b."""
    return f"(date_diff('microsecond', {a}, {b}) / 1e6)"
