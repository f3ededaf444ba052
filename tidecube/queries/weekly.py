"""Weekly products and risk by gear."""

from pyspark.sql import functions as F

from tidecube.plans import weekly
from tidecube.queries.joins import _PAIRS, pairs
from tidecube.queries.registry import N, R, query

_W = "w AS (SELECT h3, species, CAST(isoyear(date) AS BIGINT) AS iso_year, CAST(week(date) AS BIGINT) AS iso_week, count(*) AS n_days, avg(species_use_log_pred) AS use_mean, avg(species_use_log_pred + ln(1.5e0)) AS latent_mean FROM pred GROUP BY 1, 2, 3, 4 HAVING isoyear(date) BETWEEN 1995 AND 2001)"
_MEANS = f"{R('use_mean', 'use_mean')}, {R('latent_mean', 'latent_mean')}, {R('CASE WHEN use_mean > 0.2e0 THEN latent_mean END', 'display_mean')}"
_C = "c AS (SELECT h3, species, iso_week, count(DISTINCT iso_year) AS n_years, CAST(sum(n_days) AS BIGINT) AS n_days, avg(use_mean) AS use_mean, avg(latent_mean) AS latent_mean FROM w GROUP BY 1, 2, 3)"


def by_year(t):
    return weekly.weekly_by_year(t.pred, years=(1995, 2001), threshold=0.2)


@query("A11_weekly_by_year", "pred", f"WITH {_W.replace(' HAVING isoyear(date) BETWEEN 1995 AND 2001', '')} SELECT h3, species, iso_year, iso_week, n_days, {_MEANS} FROM w WHERE iso_year BETWEEN 1995 AND 2001")
def _(t):
    return by_year(t)


_W = _W.replace(" HAVING isoyear(date) BETWEEN 1995 AND 2001", "")


@query("A12_weekly_climatology", "pred", f"WITH {_W}, {_C} SELECT h3, species, iso_week, n_years, n_days, {_MEANS} FROM c")
def _(t):
    return weekly.climatology(by_year(t), 0.2)


@query("A13_week_summary", "pred", f"WITH {_W}, {_C} SELECT species, iso_week, count(*) AS cells, count(CASE WHEN use_mean > 0.2e0 THEN 1 END) AS displayed, {R('avg(latent_mean)', 'latent_mean')}, {R('max(latent_mean)', 'latent_max')} FROM c GROUP BY 1, 2")
def _(t):
    return weekly.week_summary(weekly.climatology(by_year(t), 0.2))


@query("A14_weekly_sequence", "pred", f"WITH {_W} SELECT h3, species, iso_year, iso_week, n_days, {_MEANS} FROM w WHERE iso_year = 1998")
def _(t):
    return weekly.sequence(by_year(t), 1998)


@query("A31_gear_risk", "pred daily_effort", f"SELECT p.h3, {N('isoyear(p.date)', 'iso_year')}, {N('week(p.date)', 'iso_week')}, p.species, e.gear_type, count(*) AS n_days, {R('avg(species_use_log_pred)', 'use_mean')}, {R('sum(fishing_hours * vessel_count)', 'activity')}, {R('coalesce(avg(CASE WHEN species_use_log_pred > 0 THEN species_use_log_pred + ln(1 + fishing_hours * vessel_count) END), 0)', 'risk_mean')} FROM pred p JOIN {_PAIRS} ON p.species = g.species JOIN daily_effort e ON p.h3 = e.h3 AND p.date = e.date AND g.gear_type = e.gear_type GROUP BY 1, 2, 3, 4, 5")
def _(t):
    return weekly.gear_risk(t.pred, t.daily_effort, pairs(t))


@query("A34_flag_activity", "daily_effort", f"SELECT flag, {N('isoyear(date)', 'iso_year')}, {N('week(date)', 'iso_week')}, {R('sum(fishing_hours)', 'fishing_hours')}, {N('sum(vessel_count)', 'vessel_count')} FROM daily_effort WHERE isoyear(date) = 1998 GROUP BY 1, 2, 3 HAVING sum(fishing_hours) > 0")
def _(t):
    return weekly.flag_activity(t.daily_effort, 1998)


@query("A36_daily_gear_risk", "pred daily_effort", f"WITH e AS (SELECT h3, date, sum(fishing_hours) AS h, sum(vessel_count) AS v FROM daily_effort WHERE gear_type = '2-HIGH' GROUP BY 1, 2) SELECT p.h3, p.date, {R('species_use_log_pred', 'use')}, {R('h', 'fishing_hours')}, {N('v', 'vessel_count')}, {R('species_use_log_pred + ln(1 + h * v)', 'risk')} FROM pred p JOIN e ON p.h3 = e.h3 AND p.date = e.date WHERE species = 'N'", days="date")
def _(t):
    return weekly.daily_gear_risk(t.pred, t.daily_effort, "N", "2-HIGH")


@query("stream_daily_activity", "telemetry", f"SELECT CAST(ts AS DATE) AS date, user_id % 10 AS h3, event_type AS species, count(*) AS n, {R('sum(value)', 'value_sum')} FROM events GROUP BY 1, 2, 3", days="date")
def _(t):
    """Structured Streaming over the events' files."""
    from tidecube.sources.store import shared_folder
    from tidecube.streaming.activity import run_daily_activity

    prepare = lambda df: df.select((F.col("user_id") % 10).alias("h3"), F.col("event_type").alias("species"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return run_daily_activity(t.spark, t.path("events"), t.events.schema, shared_folder(t.spark, "stream"), prepare)
