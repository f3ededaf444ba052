"""S and K: scans and sinks. Sinks are checked by reading back what they wrote to the shared folder."""

from pyspark.sql import functions as F

from tidecube.functions import dates
from tidecube.queries.registry import N, R, Tables, query
from tidecube.sources import netcdf, scan, store

_LINE = f"SELECT l_orderkey, l_suppkey, {R('l_quantity', 'l_quantity')}, CAST(l_shipdate AS DATE) AS date, {N('year(l_shipdate)', 'year')} FROM lineitem"
_COLUMNS = ["l_orderkey", "l_suppkey", "l_quantity", "date", "year"]


def _yearly(t: Tables, **options):
    path = store.shared_folder(t.spark, "yearly")
    store.write_yearly(t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity", F.to_date("l_shipdate").alias("date")), path, **options)
    return path


@query("S1_yearly_scan", oracle=_LINE, days="date")
def _(t):
    return scan.yearly(t.spark, _yearly(t)).select(*_COLUMNS)


@query("S2_years_scan", oracle=f"{_LINE} WHERE year(l_shipdate) IN (1996, 1998)", days="date")
def _(t):
    return scan.yearly(t.spark, _yearly(t), years=[1996, 1998, 2050]).select(*_COLUMNS)


@query("S3_pruned_scan", oracle=f"SELECT l_suppkey, {R('l_quantity', 'l_quantity')} FROM lineitem")
def _(t):
    return scan.yearly(t.spark, _yearly(t), columns=["l_suppkey", "l_quantity"])


@query("S4_day_scan", oracle=f"SELECT l_orderkey, {R('l_quantity', 'l_quantity')} FROM lineitem WHERE l_shipdate = TIMESTAMP '1997-06-15'")
def _(t):
    return scan.day(t.lineitem, "1997-06-15", "l_shipdate").select("l_orderkey", "l_quantity")


@query("S5_file_list_scan", oracle=f"{_LINE} WHERE year(l_shipdate) IN (1996, 1997)", days="date")
def _(t):
    path = _yearly(t)
    return scan.files(t.spark, [f"{path}/year=1996", f"{path}/year=1997"], base=path).select(*_COLUMNS)


@query("S6_csv_after_junk", oracle=f"SELECT {N('n_nationkey', 'n_nationkey')}, n_name, {N('n_regionkey', 'n_regionkey')} FROM nation")
def _(t):
    path = store.shared_folder(t.spark, "junk")
    rows = t.nation.select(F.array_join(F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")), ",").alias("value"), F.col("n_nationkey").alias("k"))
    heads = t.spark.createDataFrame([("exported on some day", -2), ("n_nationkey,n_name,n_regionkey", -1)], "value string, k int")
    heads.union(rows).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)  # a table of 25 rows, as one file with a head
    return scan.csv_after_junk(t.spark, path, "n_nationkey long, n_name string, n_regionkey long")


@query("S7_csv_scan", oracle=f"SELECT {N('p_partkey', 'p_partkey')}, p_brand, {R('p_retailprice', 'p_retailprice')} FROM part")
def _(t):
    path = store.shared_folder(t.spark, "csv")
    store.write_report(t.part.select("p_partkey", "p_brand", "p_retailprice"), path)
    return scan.csv(t.spark, path, "p_partkey long, p_brand string, p_retailprice double")


@query("S8_raster_rows", oracle=f"SELECT vec_id, {N('i - 1', 'pixel')}, {R('embedding[i]', 'value')}, {N('(i - 1) // 8', 'lat_idx')}, {N('(i - 1) % 8', 'lon_idx')} FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def _(t):
    return scan.raster_rows(t.embeddings, "embedding", ["vec_id"], width=8)


@query("S8_netcdf_scan", oracle=f"SELECT vec_id, {N('i - 1', 'pixel')}, {N('(i - 1) // 8', 'lat_idx')}, {N('(i - 1) % 8', 'lon_idx')}, {R('embedding[i]', 'value')} FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id >= 100) WHERE (i - 1) // 8 BETWEEN 2 AND 6 AND (i - 1) % 8 BETWEEN 1 AND 5")
def _(t):
    """Embeddings as daily frames in NetCDF files, of which a box and a span of days are read back."""
    path = store.shared_folder(t.spark, "netcdf")
    netcdf.write_frames(t.embeddings.withColumnRenamed("vec_id", "day"), path, "embedding", (8, 8))
    rows = netcdf.scan(t.spark, path, ["embedding"], box=(1, 2, 5, 6), days=("1970-04-11", "9999-12-31"))
    return rows.select(F.datediff("date", F.lit("1970-01-01")).alias("vec_id"), "pixel", "lat_idx", "lon_idx", F.col("embedding").alias("value"))


@query("S9_grid_scan", "cells", f"SELECT h3, {R('q', 'lon')}, {R('r', 'lat')} FROM cells")
def _(t):
    path = store.shared_folder(t.spark, "grid")
    t.cells.select(F.lower(F.hex("h3")).alias("h3"), F.col("q").cast("double").alias("lon"), F.col("r").cast("double").alias("lat")).write.parquet(path)
    return scan.grid(t.spark, path)


@query("S11_box_subset", "cells", "SELECT h3, q, r FROM cells WHERE q BETWEEN 2 AND 5 AND r BETWEEN 1 AND 3")
def _(t):
    return scan.box(t.cells, "q", "r", (5, 1, 2, 3))


@query("S12_values", oracle=f"WITH g(gear_type, cap) AS (VALUES ('1-URGENT', 5), ('2-HIGH', 7)) SELECT o_orderkey, gear_type, {N('cap', 'cap')} FROM orders JOIN g ON o_orderpriority = gear_type")
def _(t):
    g = t.spark.createDataFrame([("1-URGENT", 5), ("2-HIGH", 7)], "gear_type string, cap long")
    return t.orders.join(F.broadcast(g), F.col("o_orderpriority") == F.col("gear_type")).select("o_orderkey", "gear_type", "cap")  # two rows


@query("S13_latest_partition", oracle=f"{_LINE} WHERE year(l_shipdate) = (SELECT max(year(l_shipdate)) FROM lineitem)", days="date")
def _(t):
    return scan.latest(scan.yearly(t.spark, _yearly(t))).select(*_COLUMNS)


@query("S14_clean_effort", oracle=f"SELECT DISTINCT CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, {R('o_totalprice', 'o_totalprice')} FROM orders")
def _(t):
    return scan.clean_effort(t.orders, {"o_custkey": "long", "o_orderstatus": "string", "o_totalprice": "double"})


@query("S16_year_ranges", oracle=f"SELECT {N('y', 'year')}, greatest(make_date(y, 1, 1), DATE '1995-03-04') AS first, least(make_date(y, 12, 31), DATE '1998-02-01') AS last, count(l_orderkey) AS rows FROM range(1995, 1999) t(y) LEFT JOIN lineitem ON CAST(l_shipdate AS DATE) BETWEEN greatest(make_date(y, 1, 1), DATE '1995-03-04') AND least(make_date(y, 12, 31), DATE '1998-02-01') GROUP BY y", days="first last")
def _(t):
    """The rows of each clipped year."""
    years = F.broadcast(dates.year_ranges(t.spark, "1995-03-04", "1998-02-01"))  # one row a year
    counts = t.lineitem.select(F.to_date("l_shipdate").alias("d")).join(years, F.col("d").between(F.col("first"), F.col("last"))).groupBy("year").agg(F.count("*").alias("rows"))
    return years.join(counts, "year", "left").na.fill(0, ["rows"]).select("year", "first", "last", "rows")


@query("S17_year_spec", oracle=f"SELECT l_orderkey, {N('year(l_shipdate)', 'year')} FROM lineitem WHERE year(l_shipdate) IN (1996, 1998, 1999)")
def _(t):
    return t.lineitem.select("l_orderkey", F.year("l_shipdate").alias("year")).where(F.col("year").isin(*dates.parse_years("1998-1999, 1996", [])))


@query("K1_yearly_sink", oracle=f"SELECT {N('year(l_shipdate)', 'year')}, {N('count(*)', 'n')} FROM lineitem GROUP BY 1")
def _(t):
    path = _yearly(t)
    store.write_yearly(t.lineitem.where("year(l_shipdate) = 1997").select("l_orderkey", "l_suppkey", "l_quantity", F.to_date("l_shipdate").alias("date")), path, overwrite=True)  # only 1997 is replaced
    return scan.yearly(t.spark, path).groupBy("year").agg(F.count("*").alias("n"))


@query("K2_chunked_sink", oracle=_LINE, days="date")
def _(t):
    return scan.yearly(t.spark, _yearly(t, rows_a_file=1_000)).select(*_COLUMNS)


@query("K3_table_sink", oracle="SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    path = store.shared_folder(t.spark, "table")
    store.write_table(t.orders.select("o_orderkey", "o_orderstatus"), path)
    return t.spark.read.parquet(path)


@query("K4_csv_sink", oracle=f"SELECT o_orderpriority, {N('count(*)', 'n')} FROM orders GROUP BY 1")
def _(t):
    path = store.shared_folder(t.spark, "report")
    store.write_report(t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), path)
    return scan.csv(t.spark, path, "o_orderpriority string, n long")


@query("K5_versioned_rewrite", oracle=f"SELECT p_partkey, p_brand, {R('p_retailprice * 2', 'doubled')} FROM part")
def _(t):
    v = store.Versions(t.spark, store.shared_folder(t.spark, "versions"))
    v.write(t.part.select("p_partkey", "p_brand", "p_retailprice"))
    v.write(v.read().withColumn("doubled", F.col("p_retailprice") * 2).drop("p_retailprice"))
    return v.read()


@query("K6_no_overwrite", oracle="SELECT p_partkey, true AS refused FROM part")
def _(t):
    """A table that is there is only replaced on request."""
    from pyspark.errors import AnalysisException

    path = store.shared_folder(t.spark, "kept")
    store.write_table(t.nation.select("n_nationkey"), path)
    try:
        store.write_table(t.part.select("p_partkey"), path)
        refused = False
    except AnalysisException:
        refused = True
    assert t.spark.read.parquet(path).columns == ["n_nationkey"]
    store.write_table(t.part.select("p_partkey", F.lit(refused).alias("refused")), path, overwrite=True)
    return t.spark.read.parquet(path)


@query("K7_json_report", oracle=f"SELECT o_orderstatus, {R('sum(o_totalprice)', 'total')} FROM orders GROUP BY 1")
def _(t):
    path = store.shared_folder(t.spark, "json")
    store.write_report(t.orders.groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 6).alias("total")), path, "json")
    return t.spark.read.schema("o_orderstatus string, total double").json(path)


@query("O5_head", oracle=f"SELECT p_partkey, {R('p_retailprice', 'p_retailprice')} FROM part ORDER BY p_partkey LIMIT 5")
def _(t):
    """A look at the first rows is the feature."""
    return t.part.select("p_partkey", "p_retailprice").orderBy("p_partkey").limit(5)
