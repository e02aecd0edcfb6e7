"""Small hand-made logs as DataFrames."""

from datetime import datetime, timedelta

import pandas as pd

BASE = datetime(2016, 1, 4, 9)
SCHEMA = ("case_id string, activity string, resource string, lifecycle string, "
          "timestamp timestamp_ntz, event_order long")


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def frame(spark, rows, schema):
    """Rows through Arrow: Spark then knows the size of the table."""
    names = [p.strip().split()[0] for p in schema.split(",")] if "<" not in schema else None
    return spark.createDataFrame(pd.DataFrame(rows, columns=names), schema)


def log(spark, rows, extra=""):
    """rows: (case, activity, resource, lifecycle, seconds[, more])."""
    out = [(c, a, r, lc, at(s), i, *more) for i, (c, a, r, lc, s, *more) in enumerate(rows)]
    return frame(spark, out, SCHEMA + extra)


def paired(spark, rows):
    """rows: (case, activity, resource, start_s, duration_s) as start and complete events."""
    ev = []
    for c, a, r, s, n in rows:
        ev += [(c, a, r, "start", s), (c, a, r, "complete", s + n)]
    return log(spark, ev)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())
