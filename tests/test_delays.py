"""Delay fits read what they fit once."""

from helpers import frame
from pyspark.sql import functions as F
from pyspark.sql import Window

from caseloom.functions.ordered import _WORK
from caseloom.operators import fit


def test_delay_fit_works_its_delays_out_once(spark, monkeypatch):
    rows = [("ab"[i % 2], float(i * i % 37)) for i in range(60)] + [("a", -1.0), ("b", None)]
    plain = frame(spark, rows, "activity string, s double")
    worked = plain.withColumn("s", F.max("s").over(Window.partitionBy("activity", "s")))

    def told(df):
        return sorted((r.activity, r.n_delays, r.n, r.distribution, r.p99_s, round(r.mean_s, 9))
                      for r in fit.delay_fit(df, ["activity"], "s").collect())
    want = told(plain)
    seen = []
    for name in ("quantiles", "best_fit"):
        monkeypatch.setattr(fit, name, lambda df, *a, real=getattr(fit, name): seen.append(df) or real(df, *a))
    assert told(worked) == want and len(want) == 2
    assert len(seen) == 2
    assert not any(_WORK.search(df._jdf.queryExecution().optimizedPlan().toString()) for df in seen)


def test_members_are_worked_out_once(spark, tmp_path):
    from caseloom.plans import org
    frame(spark, [(i, i % 7, "click", '{"k": %d}' % i, float(i)) for i in range(50)],
          "event_id long, user_id long, event_type string, props string, value double").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    m = org.members(spark, str(tmp_path))
    assert not _WORK.search(m._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(map(tuple, m.collect())) == sorted(
        [(i % 4, f"R{i}") for i in range(20)] + [(9, f"R{i}") for i in range(5)])
