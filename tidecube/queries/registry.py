"""Registration of queries and of the SQL that they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The domain's tables over the driver's, the same text for both engines.
VIEWS = {
    "env": "SELECT l_suppkey AS h3, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS sst, avg(l_discount) AS chl, avg(l_extendedprice)/CAST(10000 AS DOUBLE) AS ssh, avg(l_quantity-25) AS wind_u10, avg(l_tax*100-4) AS wind_v10 FROM lineitem GROUP BY 1, 2",
    "pred": "SELECT l_suppkey AS h3, CAST(l_shipdate AS DATE) AS date, l_returnflag AS species, ln(1+10*avg(l_discount)) AS species_use_log_pred, least(avg(l_tax)*12.5e0, 1e0) AS plausibility FROM lineitem GROUP BY 1, 2, 3",
    "effort": "SELECT s.s_suppkey AS h3, CAST(o.o_orderdate AS DATE) AS date, o.o_orderpriority AS gear_type, o.o_orderstatus AS flag, o.o_totalprice/1e4 AS hours, o.o_custkey AS vessel_id FROM orders o JOIN (SELECT s_suppkey, count(*) OVER () AS n FROM supplier) s ON o.o_custkey % s.n = s.s_suppkey",
    "telemetry": "SELECT user_id % 10 AS h3, CAST(ts AS DATE) AS date, event_type AS species, user_id AS individual, user_id*100 + event_id % 7 AS trip FROM events",
    "regimes": "SELECT l_suppkey AS h3, CAST(l_shipdate AS DATE) AS date, min(l_partkey) % 30 AS seascape, avg(l_extendedprice)/1e5 AS seascape_distance, min(CAST(l_quantity AS BIGINT)) % 30 AS component, max(l_discount)*10 AS component_probability FROM lineitem GROUP BY 1, 2",
    "cells": "SELECT s_suppkey AS h3, s_suppkey % 8 AS q, CAST(floor(s_suppkey/8e0) AS BIGINT) AS r FROM supplier",
    "daily_effort": "SELECT h3, date, gear_type, flag, sum(hours) AS fishing_hours, count(DISTINCT vessel_id) AS vessel_count FROM effort GROUP BY 1, 2, 3, 4",
    "presence": "SELECT h3, date, species, count(*) AS presence_count, count(DISTINCT individual) AS individual_count, count(DISTINCT trip) AS trip_count FROM telemetry GROUP BY 1, 2, 3",
}
#: Views that Spark reads in another form, with the same rows: a key made of both sides' columns is no equi join there, so every order would meet every supplier.
_FORMS = {
    "effort": "SELECT s.s_suppkey AS h3, CAST(o.o_orderdate AS DATE) AS date, o.o_orderpriority AS gear_type, o.o_orderstatus AS flag, o.o_totalprice/1e4 AS hours, o.o_custkey AS vessel_id FROM (SELECT *, o_custkey % n AS cell FROM orders CROSS JOIN (SELECT nullif(count(*), 0) AS n FROM supplier) c) o JOIN supplier s ON o.cell = s.s_suppkey",
}
_NEEDS = {"daily_effort": ["effort"], "presence": ["telemetry"]}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """The tables of a folder, and the views over them, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in _TABLES:
            return self.spark.read.parquet(self.path(name))
        if name not in VIEWS:
            raise AttributeError(name)
        text, used = _FORMS.get(name, VIEWS[name]), {}
        for t in [*_TABLES, *VIEWS]:
            if re.search(rf"\b(FROM|JOIN) {t}\b", text):
                text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
                used[t] = getattr(self, t)
        return self.spark.sql(text, **used)


def finished(df: DataFrame) -> DataFrame:
    """Result types of the checks: whole numbers as long, others rounded to six places, days and times as text."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DateType, T.TimestampNTZType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def R(expr: str, name: str | None = None) -> str:
    """A double of the oracle, rounded; -0.0 becomes 0.0."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + CAST(0 AS DOUBLE))" + (f" AS {name}" if name else "")


def N(expr: str, name: str) -> str:
    """A whole number of the oracle."""
    return f"CAST({expr} AS BIGINT) AS {name}"


def with_views(views: str, body: str) -> str:
    names = list(dict.fromkeys(x for v in views.split() for x in [*_NEEDS.get(v, []), v]))
    body = body.strip()
    if not names:
        return body
    head = "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in names)
    return f"{head}, {body[4:].strip()}" if body[:5].upper() == "WITH " else f"{head} {body}"


def query(name: str, views: str = "", oracle: str | None = None, days: str = ""):
    """Register ``f(tables) -> DataFrame``; ``oracle`` may use the named views, and its columns named in ``days`` become text."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finished(f(Tables(spark, sf_dir)))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if oracle:
            sql = with_views(views, oracle)
            text = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in days.split())
            ORACLES[name] = f"SELECT * REPLACE ({text}) FROM ({sql}) checked" if days else sql
        return f

    return add
