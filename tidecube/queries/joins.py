"""J, U, G and the spatial joins."""

from pyspark.sql import functions as F

from tidecube.operators import geodesic, grid, joins, spatial
from tidecube.operators.ordering import top_one
from tidecube.queries.registry import N, R, query


@query("J1_inner_key", "env regimes", f"SELECT h3, date, {R('sst', 'sst')}, seascape FROM env JOIN regimes USING (h3, date)", days="date")
def _(t):
    return t.env.join(t.regimes, ["h3", "date"]).select("h3", "date", "sst", "seascape")


@query("J2_attach_cell", "env cells", f"SELECT env.h3, date, {R('sst', 'sst')}, q, r FROM env LEFT JOIN (SELECT * FROM cells WHERE q < 5) c ON env.h3 = c.h3", days="date")
def _(t):
    return joins.attach(t.env.select("h3", "date", "sst"), t.cells.where("q < 5"), ["h3"])


@query("J3_zero_fill", "env daily_effort", f"WITH e AS (SELECT h3, date, sum(fishing_hours) AS fishing_hours, CAST(sum(vessel_count) AS BIGINT) AS vessel_count FROM daily_effort GROUP BY 1, 2) SELECT env.h3, env.date, {R('coalesce(fishing_hours, 0)', 'fishing_hours')}, coalesce(vessel_count, 0) AS vessel_count FROM env LEFT JOIN e ON env.h3 = e.h3 AND env.date = e.date", days="date")
def _(t):
    e = t.daily_effort.groupBy("h3", "date").agg(F.sum("fishing_hours").alias("fishing_hours"), F.sum("vessel_count").alias("vessel_count"))
    return joins.zero_fill(t.env.select("h3", "date"), e, ["h3", "date"])


@query("J4_zero_fill_species", "presence", "WITH k AS (SELECT DISTINCT c.h3, c.date, s.species FROM presence c JOIN presence s ON c.date = s.date) SELECT k.h3, k.date, k.species, coalesce(presence_count, 0) AS presence_count, coalesce(individual_count, 0) AS individual_count, coalesce(trip_count, 0) AS trip_count FROM k LEFT JOIN presence p ON k.h3 = p.h3 AND k.date = p.date AND k.species = p.species", days="date")
def _(t):
    return joins.zero_fill(joins.observed_days(t.presence), t.presence, ["h3", "date", "species"])


@query("J5_species_expansion", "env pred", f"SELECT h3, date, {R('sst', 'sst')}, species FROM env CROSS JOIN (SELECT DISTINCT species FROM pred) s", days="date")
def _(t):
    return joins.for_each(t.env.select("h3", "date", "sst"), "species", joins.species_list(t.lineitem.select(F.col("l_returnflag").alias("species"))))


@query("J6_observed_days", "telemetry", "SELECT DISTINCT c.h3, c.date, s.species FROM telemetry c JOIN (SELECT DISTINCT date, species FROM telemetry) s ON c.date = s.date", days="date")
def _(t):
    return joins.observed_days(t.telemetry)


@query("J7_many_to_one", "env cells", f"SELECT env.h3, date, {R('sst', 'sst')}, q FROM env JOIN cells ON env.h3 = cells.h3 WHERE q < 5", days="date")
def _(t):
    return joins.many_to_one(t.env.select("h3", "date", "sst"), t.cells.where("q < 5").select("h3", "q"), ["h3"])[0]


@query("J7_unmatched", "env cells", f"SELECT {N('count(*) FILTER (c.h3 IS NULL)', 'unmatched')} FROM env LEFT JOIN (SELECT * FROM cells WHERE q < 5) c ON env.h3 = c.h3")
def _(t):
    return joins.many_to_one(t.env, t.cells.where("q < 5").select("h3", "q"), ["h3"])[1]


@query("J8_inner_fold", "env regimes pred", f"WITH p AS (SELECT h3, date, avg(plausibility) AS plausibility FROM pred GROUP BY 1, 2) SELECT h3, date, {R('sst', 'sst')}, seascape, {R('plausibility', 'plausibility')} FROM env JOIN regimes USING (h3, date) JOIN p USING (h3, date)", days="date")
def _(t):
    p = t.pred.groupBy("h3", "date").agg(F.avg("plausibility").alias("plausibility"))
    return joins.fold([t.env.select("h3", "date", "sst"), t.regimes.select("h3", "date", "seascape"), p], ["h3", "date"])


@query("J9_left_fold", "env daily_effort", f"WITH e AS (SELECT h3, date, sum(fishing_hours) AS fishing_hours FROM daily_effort GROUP BY 1, 2) SELECT env.h3, env.date, {R('sst', 'sst')}, {R('fishing_hours', 'fishing_hours')} FROM env JOIN e ON env.h3 = e.h3 AND env.date = e.date WHERE fishing_hours IS NOT NULL", days="date")
def _(t):
    e = t.daily_effort.groupBy("h3", "date").agg(F.sum("fishing_hours").alias("fishing_hours"))
    return joins.fold([t.env.select("h3", "date", "sst"), e], ["h3", "date"], "left", ["fishing_hours"])


@query("J10_cast_keys", oracle=f"SELECT o_orderkey, {N('count(*)', 'n')} FROM orders JOIN lineitem ON CAST(o_orderkey AS VARCHAR) = CAST(l_orderkey AS VARCHAR) GROUP BY 1")
def _(t):
    """Keys have one type at the scan, so that the join is on plain columns."""
    items = t.lineitem.select(F.col("l_orderkey").cast("long").alias("o_orderkey"))
    return t.orders.select(F.col("o_orderkey").cast("long").alias("o_orderkey")).join(items, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n"))


_PAIRS = "(VALUES ('A', '1-URGENT'), ('N', '2-HIGH'), ('R', '2-HIGH')) g(species, gear_type)"


def pairs(t):
    return t.spark.createDataFrame([("A", "1-URGENT"), ("N", "2-HIGH"), ("R", "2-HIGH")], "species string, gear_type string")


@query("J11_three_way", "pred daily_effort", f"SELECT p.h3, p.date, p.species, e.gear_type, e.flag, {R('fishing_hours', 'fishing_hours')}, vessel_count FROM pred p JOIN {_PAIRS} ON p.species = g.species JOIN daily_effort e ON p.h3 = e.h3 AND p.date = e.date AND g.gear_type = e.gear_type", days="date")
def _(t):
    met = t.pred.join(pairs(t), "species").join(t.daily_effort, ["h3", "date", "gear_type"])
    return met.select("h3", "date", "species", "gear_type", "flag", "fishing_hours", "vessel_count")


@query("J12_two_summaries", "pred regimes", f"WITH b AS (SELECT species, seascape, species_use_log_pred AS u, plausibility AS p FROM pred JOIN regimes USING (h3, date)), o AS (SELECT species, seascape, avg(u) AS use_mean FROM b WHERE u > 0.3e0 GROUP BY 1, 2), m AS (SELECT species, seascape, max(p) AS top FROM b WHERE p > 0.9e0 GROUP BY 1, 2) SELECT DISTINCT b.species, b.seascape, {R('use_mean', 'use_mean')}, {R('top', 'top')} FROM b LEFT JOIN o ON b.species = o.species AND b.seascape = o.seascape LEFT JOIN m ON b.species = m.species AND b.seascape = m.seascape")
def _(t):
    b = t.pred.join(t.regimes, ["h3", "date"])
    o = b.where("species_use_log_pred > 0.3").groupBy("species", "seascape").agg(F.avg("species_use_log_pred").alias("use_mean"))
    m = b.where("plausibility > 0.9").groupBy("species", "seascape").agg(F.max("plausibility").alias("top"))
    keys = ["species", "seascape"]
    return joins.attach(joins.attach(b.select(*keys).distinct(), o, keys), m, keys)


@query("J13_completeness", "env regimes", "WITH a AS (SELECT h3, date FROM env WHERE h3 % 7 <> 0), b AS (SELECT h3, date FROM regimes WHERE h3 % 5 <> 0) SELECT (SELECT count(*) FROM a) AS left_rows, (SELECT count(*) FROM b) AS right_rows, (SELECT count(*) FROM a ANTI JOIN b USING (h3, date)) AS left_only, (SELECT count(*) FROM b ANTI JOIN a USING (h3, date)) AS right_only")
def _(t):
    return joins.completeness(t.env.where("h3 % 7 <> 0").select("h3", "date"), t.regimes.where("h3 % 5 <> 0").select("h3", "date"), ["h3", "date"])


@query("J14_semi", "pred", "SELECT h3, date, species FROM pred WHERE h3 IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)", days="date")
def _(t):
    rich = t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("h3"))
    return t.pred.join(rich, "h3", "left_semi").select("h3", "date", "species")


@query("J20_nearest_date", "env", "WITH d AS (SELECT DISTINCT date FROM env), s AS (SELECT date AS source_date FROM d WHERE (date - DATE '1995-01-03') % 8 = 0 AND date > DATE '1995-03-01'), r AS (SELECT date, source_date, row_number() OVER (PARTITION BY date ORDER BY abs(source_date - date), source_date) AS k FROM d CROSS JOIN s) SELECT date, source_date, CAST(source_date - date AS BIGINT) AS day_offset FROM r WHERE k = 1", days="date source_date")
def _(t):
    d = t.env.select("date").distinct()
    s = d.where("datediff(date, DATE '1995-01-03') % 8 = 0 AND date > DATE '1995-03-01'").select(F.col("date").alias("source_date"))
    return joins.nearest_date(d, s)


_EDGES = "e AS (SELECT a.h3, b.h3 AS neighbor FROM cells a JOIN cells b ON (b.q - a.q, b.r - a.r) IN ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)))"


@query("J21_neighbor_join", "env cells", f"WITH {_EDGES} SELECT v.h3, v.date, e.neighbor, {R('v.sst - n.sst', 'difference')} FROM env v JOIN e ON v.h3 = e.h3 JOIN env n ON n.h3 = e.neighbor AND n.date = v.date", days="date")
def _(t):
    near = t.env.join(grid.lattice_edges(t.cells).select("h3", "neighbor"), "h3")
    other = t.env.select(F.col("h3").alias("neighbor"), "date", F.col("sst").alias("other"))
    return near.join(other, ["neighbor", "date"]).select("h3", "date", "neighbor", (F.col("sst") - F.col("other")).alias("difference"))


@query("J22_prototype_class", "regimes", "SELECT h3, date, component, component // 3 AS class FROM regimes WHERE component < 24", days="date")
def _(t):
    table = t.spark.createDataFrame([(k, k // 3) for k in range(24)], "component long, class long")
    return joins.class_of_prototype(t.regimes, table, "component").select("h3", "date", "component", "class")


@query("U1_union_by_name", oracle=f"SELECT p_partkey AS k, p_brand AS brand, NULL::VARCHAR AS segment FROM part UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def _(t):
    a, b = t.part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand")), t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("U2_distinct", "effort", "SELECT DISTINCT gear_type, flag, h3 FROM effort")
def _(t):
    return t.effort.select("gear_type", "flag", "h3").distinct()


@query("U3_first_per_key", oracle=f"SELECT o_custkey, o_orderkey, {R('o_totalprice', 'o_totalprice')} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def _(t):
    return top_one(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("U4_year_sets", oracle=f"SELECT {N('y', 'year')}, 'both' AS side FROM (SELECT year(l_shipdate) AS y FROM lineitem INTERSECT SELECT year(o_orderdate) FROM orders) UNION ALL SELECT y, 'lines' FROM (SELECT year(l_shipdate) AS y FROM lineitem EXCEPT SELECT year(o_orderdate) FROM orders)")
def _(t):
    a, b = t.lineitem.select(F.year("l_shipdate").alias("year")), t.orders.select(F.year("o_orderdate").alias("year"))
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.subtract(b).withColumn("side", F.lit("lines")))


@query("U5_species_list", "pred", "SELECT DISTINCT species FROM pred ORDER BY 1")
def _(t):
    return t.pred.select("species").distinct().orderBy("species")


@query("G2_hex_ids", "cells", "SELECT h3, h3 + 599686042433355775 AS id FROM cells")
def _(t):
    return t.cells.select("h3", grid.id_from_hex(F.hex(F.col("h3") + 599686042433355775)).alias("id"))


@query("G1_cells_of_places")
def _(t):
    """Events by hexagon of the globe, with the hexagon's centre and its parent."""
    at = t.events.select((F.col("event_id") * 7919 % 180_001 / 1000.0 - 90).alias("lat"), (F.col("event_id") * 104_729 % 360_000 / 1000.0 - 180).alias("lon"))
    n = geodesic.with_cell(at, "lat", "lon", 6).groupBy("cell").agg(F.count("*").alias("n"))
    return geodesic.with_parent(geodesic.with_centre(n))


@query("G1_polygon_cells")
def _(t):
    """The hexagons whose centres lie in each supplier's polygon, a star with a hole."""
    x, y = F.col("s_suppkey") * 37 % 300 - 150, F.col("s_suppkey") * 53 % 120 - 60
    corner = lambda k, r: F.struct((x + r * F.cos(k * F.lit(0.6283185307179586))).alias("lon"), (y + r * F.sin(k * F.lit(0.6283185307179586))).alias("lat"))
    star = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: corner(k, F.when(k % 2 == 0, 9.5).otherwise(4.5)))
    hole = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: corner(k, F.lit(2.5)))
    return geodesic.fill(t.supplier.select(F.col("s_suppkey").alias("polygon"), F.array(star, hole).alias("rings")), 6)


@query("G1_boundaries")
def _(t):
    """The corners of the hexagons that hold events."""
    at = t.events.select((F.col("event_id") * 7919 % 180_001 / 1000.0 - 90).alias("lat"), (F.col("event_id") * 104_729 % 360_000 / 1000.0 - 180).alias("lon"))
    return geodesic.boundary(geodesic.with_cell(at, "lat", "lon", 4).select("cell").distinct())


@query("G3_wide_neighbors", "cells", f"WITH {_EDGES}, l AS (SELECT h3, list_sort(list(neighbor)) AS n FROM e GROUP BY 1) SELECT cells.h3, n[1] AS n1, n[2] AS n2, n[3] AS n3, n[4] AS n4, n[5] AS n5, n[6] AS n6 FROM cells LEFT JOIN l ON cells.h3 = l.h3")
def _(t):
    return grid.wide_neighbors(grid.lattice_edges(t.cells), t.cells)


@query("G4_neighbor_index", "cells", f"WITH {_EDGES}, i AS (SELECT h3, row_number() OVER (ORDER BY h3) - 1 AS idx FROM cells), l AS (SELECT e.h3, list_sort(list(e.neighbor)) AS n FROM e GROUP BY 1), x AS (SELECT i.idx, unnest(range(1, 7)) AS side, l.n FROM i LEFT JOIN l ON i.h3 = l.h3), y AS (SELECT x.idx, side, coalesce(j.idx, -1) AS v FROM x LEFT JOIN i j ON x.n[side] = j.h3) SELECT idx, " + ", ".join(f"max(v) FILTER (side = {i}) AS n{i}" for i in range(1, 7)) + " FROM y GROUP BY idx")
def _(t):
    return grid.neighbor_index(grid.wide_neighbors(grid.lattice_edges(t.cells), t.cells))


@query("G5_disk", "cells", "SELECT a.h3, b.h3 AS neighbor FROM cells a JOIN cells b ON (abs(b.q - a.q) + abs(b.r - a.r) + abs(b.q - a.q + b.r - a.r)) / 2 <= 1")
def _(t):
    return grid.disk(grid.lattice_edges(t.cells), t.cells, 1)


_E = "sqrt((2 - 1 / 298.257223563e0) / 298.257223563e0)"


def _ordinate(lat: str) -> str:
    """SQL of the ellipsoid's equal-area ordinate, in metres."""
    s = f"sin(radians({lat}))"
    return f"6378137e0 * (1 - {_E} * {_E}) / 2 * ({s} / (1 - {_E} * {_E} * {s} * {s}) + ln((1 + {_E} * {s}) / (1 - {_E} * {s})) / (2 * {_E}))"


def _metres(rows: str, lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Relation of h3 and m, the geodesic metres between two points of each of the rows."""
    flat = "(1 - 1 / 298.257223563e0)"
    return f"""(SELECT h3, 6378137e0 * (w - (coalesce((w - sin(w)) * p * p * (1 - q * q) / nullif(1 - h, 0), 0) + coalesce((w + sin(w)) * (1 - p * p) * q * q / nullif(h, 0), 0)) / (2 * 298.257223563e0)) AS m
        FROM (SELECT h3, sin((a + b) / 2) AS p, sin((b - a) / 2) AS q, h, 2 * asin(sqrt(h)) AS w
        FROM (SELECT *, least(1e0, power(sin((b - a) / 2), 2) + cos(a) * cos(b) * power(sin(l / 2), 2)) AS h
        FROM (SELECT h3, atan({flat} * tan(radians({lat1}))) AS a, atan({flat} * tan(radians({lat2}))) AS b, radians({lon2} - ({lon1})) AS l FROM {rows}) g1) g2) g3)"""


@query("G7_distance_area", "cells", f"SELECT c.h3, {R('m / 1000', 'km')}, {R(f'6378137e0 * radians(1e0) * ({_ordinate("r - 56")} - {_ordinate("r - 57")}) / 1e6', 'km2')} FROM cells c JOIN {_metres('cells', 'r - 57e0', 'q - 64e0', 'r - 56e0', 'q - 62e0')} g ON c.h3 = g.h3")
def _(t):
    lat, lon = (F.col("r") - 57).cast("double"), (F.col("q") - 64).cast("double")
    return t.cells.select("h3", (spatial.geodesic(lat, lon, lat + 1, lon + 2) / 1000).alias("km"), (spatial.box_area(lon, lat, lon + 1, lat + 1) / 1e6).alias("km2"))


#: Hexagons of whole coordinates that tile the plane: centre (4q + 2r, 3r).
_HEX = ((0, 2), (-2, 1), (-2, -1), (0, -2), (2, -1), (2, 1))


def hexagons(t):
    x, y = 4 * F.col("q") + 2 * F.col("r"), 3 * F.col("r")
    ring = F.array(*(F.struct((x + a).cast("double").alias("lon"), (y + b).cast("double").alias("lat")) for a, b in _HEX))
    return t.cells.select("h3", ring.alias("ring"))


def points(t):
    return t.events.select("event_id", ((F.col("user_id") % 120) / 2).alias("lon"), ((F.col("event_id") % 80) / 2).alias("lat"))


_POINTS = "p AS (SELECT event_id, (user_id % 120) / 2e0 AS lon, (event_id % 80) / 2e0 AS lat FROM events)"
_DXY = "p.lon - (4 * q + 2 * r) AS dx, p.lat - 3 * r AS dy"
#: Inside the hexagon: |dx| <= 2 and |dx| + 2|dy| <= 4.


@query("J16_points_in_polygons", "cells", f"WITH {_POINTS}, d AS (SELECT event_id, lon, lat, h3, {_DXY} FROM p CROSS JOIN cells) SELECT event_id, {R('lon', 'lon')}, {R('lat', 'lat')}, h3 FROM d WHERE abs(dx) <= 2 AND abs(dx) + 2 * abs(dy) <= 4")
def _(t):
    return spatial.points_in_polygons(points(t), hexagons(t), tile=4.0)


@query("J17_points_in_boxes", "cells", f"WITH {_POINTS} SELECT event_id, {R('lon', 'lon')}, {R('lat', 'lat')}, h3 AS grid FROM p JOIN cells ON lon > 5 * q AND lon < 5 * q + 5 AND lat > 5 * r AND lat < 5 * r + 5")
def _(t):
    x, y = (5 * F.col("q")).cast("double"), (5 * F.col("r")).cast("double")
    boxes = t.cells.select(F.col("h3").alias("grid"), x.alias("x0"), y.alias("y0"), (x + 5).alias("x1"), (y + 5).alias("y1"))
    return spatial.points_in_boxes(points(t), boxes, tile=5.0)


def pixels(t):
    """Boxes of half a degree over the hexagons' plane, which is read as degrees around the equator."""
    return t.spark.range(140 * 50).select(F.col("id").alias("pixel"), *(((F.expr(e)) / 2.0).alias(n) for n, e in (("x0", "id % 140 - 6"), ("y0", "id div 140 - 6"), ("x1", "id % 140 - 5"), ("y1", "id div 140 - 5"))))


@query("J18_overlay")
def _(t):
    """Weights of half-degree pixels in hexagonal cells."""
    return spatial.overlay(hexagons(t), pixels(t), tile=2.0)


@query("J18_weights", oracle=f"SELECT l_orderkey, l_partkey, {N('l_linenumber', 'l_linenumber')}, {R('l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey)', 'weight')} FROM lineitem")
def _(t):
    return spatial.weights(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity").select("l_orderkey", "l_partkey", "l_linenumber", "weight")


@query("J19_pixel_gather", oracle=f"WITH v AS (SELECT vec_id, i - 1 AS pixel, embedding[i] AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)), l AS (SELECT h3, (h3 * 7 + k) % 64 AS pixel, k / 10e0 AS weight FROM (SELECT s_suppkey AS h3, unnest(range(1, 5)) AS k FROM supplier)) SELECT vec_id, h3, {R('sum(value * weight) / sum(weight)', 'value')} FROM v JOIN l ON v.pixel = l.pixel GROUP BY 1, 2")
def _(t):
    lookup = t.supplier.select(F.col("s_suppkey").alias("h3"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).select("h3", ((F.col("h3") * 7 + F.col("k")) % 64).alias("pixel"), (F.col("k") / 10).alias("weight"))
    return spatial.gathered(t.embeddings, "embedding", lookup, by=("vec_id",))


@query("J23_coast_distance", "cells", f"WITH s AS (SELECT c_custkey, (c_custkey % 37) * 1e0 AS ax, (c_custkey % 11) * 1e0 AS ay FROM customer), n AS (SELECT h3, q + 0.5e0 AS lon, r + 0.25e0 AS lat, greatest(0e0, least(1e0, ((q + 0.5e0 - ax) * 3 + (r + 0.25e0 - ay) * 4) / 25e0)) AS t, ax, ay FROM cells CROSS JOIN (SELECT DISTINCT ax, ay FROM s)), m AS (SELECT h3, lon, lat, ax + t * 3 AS px, ay + t * 4 AS py FROM n), k AS (SELECT h3, lon, lat, px, py, row_number() OVER (PARTITION BY h3 ORDER BY (px - lon) * (px - lon) + (py - lat) * (py - lat), px, py) AS k FROM m) SELECT h3, round(m / 1000, 3) AS dist_km FROM {_metres('(SELECT * FROM k WHERE k = 1)', 'lat', 'lon', 'py', 'px')} g")
def _(t):
    a = t.customer.select((F.col("c_custkey") % 37).cast("double").alias("ax"), (F.col("c_custkey") % 11).cast("double").alias("ay")).distinct()
    segments = a.select("ax", "ay", (F.col("ax") + 3).alias("bx"), (F.col("ay") + 4).alias("by"))
    cells = t.cells.select("h3", (F.col("q") + 0.5).alias("lon"), (F.col("r") + 0.25).alias("lat"))
    return spatial.coast_distance(cells, segments).select("h3", F.round(F.col("dist_m") / 1000, 3).alias("dist_km"))
