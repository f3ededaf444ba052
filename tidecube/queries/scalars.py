"""P: projections, filters and scalar functions."""

from pyspark.sql import functions as F

from tidecube.functions import dates, scalars
from tidecube.operators.joins import where_any
from tidecube.queries.registry import N, R, query
from tidecube.schema import drop_incomplete, missing_counts, require_complete

_DOY = "(dayofyear(date) - CASE WHEN dayofyear(make_date(year(date), 12, 31)) = 366 AND dayofyear(date) > 59 THEN 1 ELSE 0 END)"


@query("P1_utc_day", oracle="SELECT event_id, CAST(ts AS DATE) AS day FROM events", days="day")
def _(t):
    return t.events.select("event_id", dates.utc_day(F.col("ts")).alias("day"))


@query("P2_us_timestamp", oracle="SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('minute', ts) END AS ts FROM events", days="ts")
def _(t):
    text = F.when(F.col("event_id") % 5 == 0, "13/45/24 x").otherwise(F.date_format("ts", "M/d/yy H:mm"))
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts")).select("event_id", dates.us_timestamp(text).cast("timestamp_ntz").alias("ts"))


@query("P3_adjusted_doy", "env", f"SELECT DISTINCT date, {N(_DOY, 'adjusted_doy')} FROM env", days="date")
def _(t):
    return t.env.select("date").distinct().select("date", dates.adjusted_doy(F.col("date")).alias("adjusted_doy"))


@query("P4_season", "env", f"SELECT DISTINCT date, {R(f'sin(2 * pi() * ({_DOY} - 1) / 365)', 'doy_sin')}, {R(f'cos(2 * pi() * ({_DOY} - 1) / 365)', 'doy_cos')} FROM env", days="date")
def _(t):
    s, c = dates.season(dates.adjusted_doy(F.col("date")))
    return t.env.select("date").distinct().select("date", s.alias("doy_sin"), c.alias("doy_cos"))


@query("P5_season_lookup", "env", f"SELECT h3, date, {R(f'sin(2 * pi() * ({_DOY}) / 365)', 'doy_sin')}, {R(f'cos(2 * pi() * ({_DOY}) / 365)', 'doy_cos')} FROM env", days="date")
def _(t):
    """The lookup table's terms at every cell and day."""
    lookup = F.broadcast(dates.season_lookup(t.spark))  # 365 rows
    return t.env.select("h3", "date", dates.adjusted_doy(F.col("date")).alias("adjusted_doy")).join(lookup, "adjusted_doy").select("h3", "date", "doy_sin", "doy_cos")


@query("P6_wind_speed", "env", f"SELECT h3, date, {R('sqrt(wind_u10 * wind_u10 + wind_v10 * wind_v10)', 'wind_speed')} FROM env", days="date")
def _(t):
    return t.env.select("h3", "date", scalars.wind_speed(F.col("wind_u10"), F.col("wind_v10")).alias("wind_speed"))


@query("P7_log_chlorophyll", "env", f"SELECT h3, date, {R('CASE WHEN chl - 0.02e0 > -1 THEN ln(1 + chl) END', 'chl_log')} FROM env", days="date")
def _(t):
    return t.env.select("h3", "date", scalars.log1p(F.col("chl")).alias("chl_log"))


@query("P8_sphere", "cells", f"SELECT h3, {R('sin(radians(r - 57))', 'lat_sin')}, {R('cos(radians(r - 57))', 'lat_cos')}, {R('sin(radians(q - 64))', 'lon_sin')}, {R('cos(radians(q - 64))', 'lon_cos')} FROM cells")
def _(t):
    return t.cells.select("h3", *(c.alias(k) for k, c in scalars.sphere(F.col("r") - 57, F.col("q") - 64).items()))


@query("P9_indices", "presence", f"SELECT h3, date, species, {N('presence_count * individual_count', 'residence_index')} FROM presence", days="date")
def _(t):
    return t.presence.select("h3", "date", "species", scalars.product_index(F.col("presence_count"), F.col("individual_count")).alias("residence_index"))


@query("P10_log_target", oracle=f"SELECT l_orderkey, {R('ln(1 + l_quantity)', 'log_target')}, {R('greatest(exp(l_discount - 0.05e0) - 1, 0e0)', 'raw')} FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", F.log1p("l_quantity").alias("log_target"), scalars.inverse_log_target(F.col("l_discount") - 0.05).alias("raw"))


@query("P11_guarded_log", oracle=f"SELECT l_orderkey, {R('CASE WHEN l_discount - 0.05e0 > 0 THEN ln(1 + (l_discount - 0.05e0)) ELSE 0e0 END', 'v')} FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", scalars.guarded_log1p(F.col("l_discount") - 0.05).alias("v"))


_GAPS = "SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS a, CASE WHEN l_linenumber % 2 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_tax END AS b FROM lineitem"


def _gaps(t):
    return t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("a"), F.when(F.col("l_linenumber") % 2 == 0, float("inf")).otherwise(F.col("l_tax")).alias("b"))


@query("P12_drop_incomplete", oracle=f"SELECT l_orderkey, {R('a', 'a')}, {R('b', 'b')} FROM ({_GAPS}) WHERE a IS NOT NULL AND b < 1e300")
def _(t):
    return drop_incomplete(_gaps(t), ["a", "b"])


@query("P12_missing_counts", oracle=f"SELECT 'a' AS \"column\", {N('count(*) FILTER (a IS NULL)', 'missing')} FROM ({_GAPS}) UNION ALL SELECT 'l_orderkey', 0")
def _(t):
    return missing_counts(_gaps(t), ["l_orderkey", "a"])


@query("P13_require_complete", oracle=f"SELECT l_orderkey, {R('l_tax', 'l_tax')} FROM lineitem")
def _(t):
    return require_complete(t.lineitem.select("l_orderkey", "l_tax"), ["l_tax"])


@query("P14_category", oracle="SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' WHEN p_partkey % 4 = 1 THEN 'unknown' ELSE p_brand END AS brand FROM part")
def _(t):
    k = F.col("p_partkey") % 4
    return t.part.select("p_partkey", scalars.category(F.when(k == 0, " na ").when(k == 1, F.lit(None)).otherwise(F.concat(F.lit("  "), "p_brand", F.lit(" ")))).alias("brand"))


@query("P15_units", oracle=f"SELECT p_partkey, {R('p_retailprice - 273.15e0', 'celsius')}, {R('round_even(p_size / 4e0, 1)', 'rounded')} FROM part")
def _(t):
    return t.part.select("p_partkey", scalars.celsius(F.col("p_retailprice")).alias("celsius"), scalars.half_even(F.col("p_size") / 4, 1).alias("rounded"))


@query("P16_periods", "env", f"SELECT DISTINCT date, {N('month(date)', 'month')}, {N('year(date)', 'year')}, CAST(date_trunc('month', date) AS DATE) AS month_start FROM env", days="date month_start")
def _(t):
    d = F.col("date")
    return t.env.select("date").distinct().select("date", F.month(d).alias("month"), F.year(d).alias("year"), dates.month_start(d).alias("month_start"))


@query("P17_iso_week", "env", f"SELECT DISTINCT date, {N('isoyear(date)', 'iso_year')}, {N('week(date)', 'iso_week')} FROM env", days="date")
def _(t):
    return t.env.select("date").distinct().select("date", dates.iso_year(F.col("date")).alias("iso_year"), dates.iso_week(F.col("date")).alias("iso_week"))


@query("P18_optional_filters", oracle="SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_type IN ('ECONOMY', 'STANDARD')")
def _(t):
    return where_any(t.part, p_brand="Brand#2", p_type=["ECONOMY", "STANDARD"], p_size=None).select("p_partkey")


@query("P19_not_in", "regimes", "SELECT h3, date, seascape FROM regimes WHERE seascape NOT IN (0, 7)", days="date")
def _(t):
    return t.regimes.where(~F.col("seascape").isin(0, 7)).select("h3", "date", "seascape")


@query("P20_expression", "env", f"SELECT h3, date, {R('sst * 2 - chl', 'v')} FROM env", days="date")
def _(t):
    return t.env.select("h3", "date", F.expr("sst * 2 - chl").alias("v"))


@query("P21_display_null", "pred", f"SELECT h3, date, species, {R('CASE WHEN species_use_log_pred > 0.3e0 THEN species_use_log_pred + 1 END', 'display')} FROM pred", days="date")
def _(t):
    return t.pred.select("h3", "date", "species", scalars.above_or_null(F.col("species_use_log_pred") + 1, F.col("species_use_log_pred"), 0.3).alias("display"))


@query("P22_thresholds", "pred", f"SELECT h3, date, species, {R('CASE WHEN plausibility >= 0.5e0 THEN species_use_log_pred ELSE 0e0 END', 'kept')}, coalesce(plausibility, 0e0) <= 0 AS is_low FROM pred", days="date")
def _(t):
    p = F.col("plausibility")
    return t.pred.select("h3", "date", "species", scalars.zero_below(F.col("species_use_log_pred"), p, 0.5).alias("kept"), scalars.is_low(p).alias("is_low"))


@query("P23_drop_rename", oracle="SELECT CAST(n_nationkey AS BIGINT) AS nation, n_name FROM nation")
def _(t):
    return t.nation.drop("n_regionkey").withColumnRenamed("n_nationkey", "nation")


@query("P24_mapped", oracle="SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0.9e0 WHEN 'O' THEN 0.5e0 ELSE 0e0 END AS cut FROM orders")
def _(t):
    return t.orders.select("o_orderkey", scalars.mapped(F.col("o_orderstatus"), {"F": 0.9, "O": 0.5}, 0.0).alias("cut"))


@query("P25_labels", "effort", "SELECT DISTINCT concat(flag, ' - ', gear_type) AS label FROM effort")
def _(t):
    return t.effort.select(F.concat_ws(" - ", "flag", "gear_type").alias("label")).distinct()


@query("P26_dominance", "pred", f"WITH s AS (SELECT h3, date, round(avg(CASE WHEN species = 'A' THEN 1e0 ELSE 0e0 END), 6) AS share FROM pred GROUP BY 1, 2) SELECT h3, date, CASE WHEN share >= 0.8e0 THEN 'A-dominated' WHEN share <= 0.2e0 THEN 'other-dominated' ELSE 'mixed' END AS label FROM s", days="date")
def _(t):
    s = t.pred.groupBy("h3", "date").agg(F.round(F.avg((F.col("species") == "A").cast("double")), 6).alias("share"))
    return s.select("h3", "date", scalars.dominance(F.col("share"), "A", "other").alias("label"))


@query("P27_share_of_max", "pred", f"SELECT h3, date, species, {R('power(greatest(0e0, least(1e0, species_use_log_pred / (SELECT max(species_use_log_pred) FROM pred))), 0.5e0)', 'alpha')} FROM pred", days="date")
def _(t):
    top = F.broadcast(t.pred.agg(F.max("species_use_log_pred").alias("top")))  # one row
    return t.pred.join(top, F.lit(True)).select("h3", "date", "species", scalars.share_of(F.col("species_use_log_pred"), F.col("top"), 0.5).alias("alpha"))


@query("P28_one_hot", "pred", "SELECT h3, date, CAST(species = 'A' AS BIGINT) AS is_A, CAST(species = 'N' AS BIGINT) AS is_N FROM pred", days="date")
def _(t):
    return t.pred.select("h3", "date", *(c.alias(k) for k, c in scalars.one_hot(F.col("species"), ["A", "N"], "is_").items()))


@query("P29_buffered_box", "cells", "SELECT h3, CAST(q - 64 AS DOUBLE) AS lon, CAST(r - 57 AS DOUBLE) AS lat FROM cells WHERE q - 64 BETWEEN -62 - 50e0 / (111 * cos(radians(-53e0))) AND -59 + 50e0 / (111 * cos(radians(-53e0))) AND r - 57 BETWEEN -56 - 50e0 / 111 AND -50 + 50e0 / 111")
def _(t):
    """The cells whose centre lies in a region's box, widened by 50 km."""
    x0, y0, x1, y1 = scalars.buffered_box(-62, -56, -59, -50, 50)
    own = t.cells.select("h3", (F.col("q") - 64).cast("double").alias("lon"), (F.col("r") - 57).cast("double").alias("lat"))
    return own.where(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1))
