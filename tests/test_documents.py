"""Calendar documents of many resources."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from caseloom.sources import fitted


@pytest.mark.parametrize("part", [5, 1000])
def test_calendar_is_read_back_from_its_parts(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(fitted, "PART", part)
    res = [f"r{i}" for i in range(60)]
    win = spark.createDataFrame([(r, d, 8.0 + d, 16.0 + i / 8, d / 8) for i, r in enumerate(res) for d in range(i % 3 + 1)],
                                "resource string, dow int, open_h double, close_h double, p_work double")
    hol = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 15)], "date date")
    vac = spark.createDataFrame([(r, date(2024, 2, 1 + i % 9)) for i, r in enumerate(res[:30])] + [("only", date(2024, 3, 1))],
                                "resource string, date date")
    sys = spark.createDataFrame([("s1",), ("s2",)], "resource string")
    doc = fitted.calendar_document(win, hol, vac, sys)
    assert (doc.count() > 1) == (part == 5)
    assert doc.select(F.max(F.size("windows"))).first()[0] <= 20 or part > 5
    fitted.write_json(doc, str(tmp_path / "c.json"))
    back = fitted.read_calendar(spark, str(tmp_path / "c.json"))
    for name, df in (("windows", win), ("holidays", hol), ("vacations", vac), ("system", sys)):
        assert sorted(map(tuple, back[name].select(*df.columns).collect())) == sorted(map(tuple, df.collect())), name


def test_calendar_without_rows_is_one_document(spark, tmp_path):
    none = spark.createDataFrame([], "resource string, dow int, open_h double, close_h double, p_work double, date date")
    doc = fitted.calendar_document(none, none.select("date"), none.select("resource", "date"), none.select("resource"))
    assert [tuple(r) for r in doc.collect()] == [({}, {}, [], {}, [])]
