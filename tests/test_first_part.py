"""The part by time: as a plain sort gives it, also if nearly all rows are of one day, without a day in one task."""

import random
from datetime import date

import pytest

from tidecube.operators.ordering import first_part


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.75, 1.0])
@pytest.mark.parametrize("hot", [None, date(2020, 1, 3)])
def test_as_a_sort_gives_it(spark, share, hot):
    pick = random.Random(7)
    days = [None, *(date(2020, 1, d) for d in (1, 2, 3, 4))]
    rows = [(hot if i % 10 and i % 3 else pick.choice(days), i * 7919 % 3000 // 3, i) for i in range(3000)]
    got = first_part(spark.createDataFrame(rows, "date date, k long, i long").repartition(7), "date", ["k", "i"], share)
    order = sorted(rows, key=lambda r: (r[0] or date.min, r[1], r[2]))
    assert {r.i for r in got.where("is_first").collect()} == {r[2] for r in order[: int(share * len(rows))]}
    assert got.count() == len(rows)


def test_no_rows_and_one_row(spark):
    none = spark.createDataFrame([], "date date, k long")
    assert first_part(none, "date", ["k"], 0.5).count() == 0
    one = spark.createDataFrame([(date(2020, 1, 1), None)], "date date, k long")
    assert [first_part(one, "date", ["k"], s).first().is_first for s in (0.5, 1.0)] == [False, True]


def test_no_window_by_day(spark):
    df = spark.range(100).selectExpr("DATE'2020-01-01' AS date", "id AS k")
    plan = first_part(df, "date", ["k"], 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window" in line and "date#" in line for line in plan.splitlines())
