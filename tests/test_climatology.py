"""Means kept up year by year equal those of all rows at once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidecube.operators.aggregates import anomalies
from tidecube.plans.climatology import Climatology


def rows_of(d, *columns):
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(cell, r)) for r in d.select(*columns).collect()), key=str)


def test_years_are_added_and_corrected(spark, tmp_path):
    g = random.Random(2)
    rows = [(g.choice([1, 2, 3]), dt.date(y, 2, 27) + dt.timedelta(days=g.randrange(4)), g.choice([None, g.random(), g.random()]), g.random()) for y in range(1995, 2002) for _ in range(60)]
    d = spark.createDataFrame(rows, "h3 long, date date, sst double, chl double")
    c = Climatology(spark, f"{tmp_path}/c", ["sst", "chl"])
    with pytest.raises(ValueError):
        c.means()
    assert c.add(d, range(1995, 2001)) == list(range(1995, 2001))
    # years that are held are not read again: rows that would fail never run
    bad = d.withColumn("sst", F.when(F.year("date") < 2001, F.raise_error(F.lit("read")).cast("double")).otherwise(F.col("sst")))
    assert c.add(bad, range(1995, 2003)) == [2001, 2002] and c.years() == list(range(1995, 2003))
    assert rows_of(c.anomalies(d), "h3", "date", "sst_anom", "chl_anom") == rows_of(anomalies(d, ["sst", "chl"]), "h3", "date", "sst_anom", "chl_anom")
    fixed = d.where("year(date) <> 1997").unionByName(d.where("year(date) = 1997 AND h3 = 1").withColumn("sst", F.col("sst") * 2))
    assert c.add(fixed, [1997], correct=True) == [1997]
    assert rows_of(c.anomalies(fixed), "h3", "date", "sst_anom", "chl_anom") == rows_of(anomalies(fixed, ["sst", "chl"]), "h3", "date", "sst_anom", "chl_anom")
    gone = fixed.where("year(date) <> 1999")
    c.add(gone, [1999], correct=True)  # a year that has no rows any more
    assert rows_of(c.anomalies(gone), "h3", "date", "sst_anom", "chl_anom") == rows_of(anomalies(gone, ["sst", "chl"]), "h3", "date", "sst_anom", "chl_anom")
    assert c.means([1995]).count() == d.where("year(date) = 1995").select("h3", "date").distinct().count()
