"""Every query of the cube that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidecube.queries import ORACLES, QUERIES
from tidecube.queries.registry import _TABLES


def rows(df):
    cell = lambda v: "" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in _TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"L9_component_sweep", "L4_density_regressor", "L2_extra_trees", "L3_histogram_boosting", "K7_saved_model"}))
def test_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
