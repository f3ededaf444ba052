"""M and W8: samples, balances, splits and folds. The order is arithmetic, so that both engines draw the same rows."""

from pyspark.sql import functions as F

from tidecube.operators.ordering import written
from tidecube.operators import grid, sampling
from tidecube.queries.joins import _EDGES
from tidecube.queries.registry import N, R, query

_K = "(o_orderkey * 2654435761) % 1000003"


def _key():
    return sampling.integer_key(F.col("o_orderkey")), F.col("o_orderkey")


@query("M1_sample_n", oracle=f"SELECT o_orderkey FROM orders ORDER BY {_K}, o_orderkey LIMIT 500")
def _(t):
    """An exact-n sample is the feature."""
    return sampling.sample_n(t.orders, 500, *_key()).select("o_orderkey")


@query("M2_sample_per_year", oracle=f"SELECT o_orderkey, {N('y', 'year')} FROM (SELECT o_orderkey, year(o_orderdate) AS y, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY {_K}, o_orderkey) AS k FROM orders) WHERE k <= 100")
def _(t):
    return sampling.sample_per(t.orders.withColumn("year", F.year("o_orderdate")), ["year"], 100, *_key()).select("o_orderkey", "year")


_T = "CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END"


def _target(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).otherwise(0.0).alias("target"))


@query("M3_balance", oracle=f"WITH x AS (SELECT o_orderkey, {_T} AS target FROM orders), z AS (SELECT *, row_number() OVER (ORDER BY {_K}, o_orderkey) AS k FROM x WHERE target = 0) SELECT o_orderkey, {R('target', 'target')} FROM x WHERE target > 0 UNION ALL SELECT o_orderkey, 0 FROM z WHERE k <= (SELECT count(*) FROM x WHERE target > 0)")
def _(t):
    return sampling.balance(_target(t), "target", *_key())


@query("M4_weights", oracle=f"SELECT o_orderkey, {R(f'1 + power({_T}, 0.75e0)', 'weight')} FROM orders")
def _(t):
    return _target(t).select("o_orderkey", sampling.sample_weight(F.col("target")).alias("weight"))


@query("M5_hold_out", oracle=f"SELECT o_orderkey, row_number() OVER (ORDER BY {_K}, o_orderkey) <= round(0.25 * (SELECT count(*) FROM orders)) AS is_test FROM orders")
def _(t):
    return sampling.hold_out(t.orders.select("o_orderkey"), 0.25, *_key())


@query("J15_train_test", oracle=f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_K}, o_orderkey) AS k FROM orders) WHERE k > round(0.25 * (SELECT count(*) FROM orders))")
def _(t):
    return sampling.hold_out(t.orders.select("o_orderkey"), 0.25, *_key()).where("NOT is_test").select("o_orderkey")


@query("M6_time_hold_out", oracle="SELECT o_orderkey, NOT row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) <= CAST(floor(0.75 * (SELECT count(*) FROM orders)) AS BIGINT) AS is_test FROM orders")
def _(t):
    from tidecube.operators.ordering import first_part

    return first_part(t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("date")), "date", ["o_orderkey"], 0.75).select("o_orderkey", (~F.col("is_first")).alias("is_test"))


_GROUPS = "g AS (SELECT h3 // 5 AS block, count(*) AS n FROM env GROUP BY 1), k AS (SELECT block, coalesce(sum(n) OVER (ORDER BY (block * 2654435761) % 1000003, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM g)"


def _blocks(t):
    own = t.env.select("h3", "date").withColumn("block", F.expr("h3 div 5"))
    return sampling.hold_out_groups(own, "block", 0.25, sampling.integer_key(F.col("block")))


@query("M7_group_hold_out", "env", f"WITH {_GROUPS} SELECT h3, date, h3 // 5 AS block, before < total * 0.25e0 AS is_test FROM env JOIN k ON k.block = h3 // 5", days="date")
def _(t):
    return _blocks(t)


@query("W8_running_hold_out", "env", f"WITH {_GROUPS} SELECT block FROM k WHERE before < total * 0.25e0")
def _(t):
    return _blocks(t).where("is_test").select("block").distinct()


@query("running_total", oracle=f"SELECT o_orderkey, {R('coalesce(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000', 'before')} FROM orders")
def _(t):
    from tidecube.operators.ordering import running_total

    return running_total(t.orders.select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")), "o_orderkey", "cents", "c").select("o_orderkey", (F.col("c") / 100000).alias("before"))


@query("W7_group_weights", oracle=f"SELECT l_orderkey, l_partkey, {N('l_linenumber', 'l_linenumber')}, {R('l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey, l_orderkey)', 'weight')} FROM lineitem")
def _(t):
    from tidecube.operators import spatial

    own = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.struct("l_suppkey", "l_orderkey").alias("cell"))
    return spatial.weights(own, "cell", "l_quantity").select("l_orderkey", "l_partkey", "l_linenumber", "weight")


@query("M8_buffered_hold_out", "env cells", f"WITH {_EDGES}, {_GROUPS}, x AS (SELECT h3, date, h3 // 5 AS block, before < total * 0.25e0 AS is_test FROM env JOIN k ON k.block = h3 // 5), n AS (SELECT DISTINCT e.neighbor AS h3 FROM e JOIN x ON e.h3 = x.h3 WHERE is_test) SELECT x.h3, date, CASE WHEN is_test THEN 'test' WHEN n.h3 IS NOT NULL THEN 'excluded' ELSE 'train' END AS part FROM x LEFT JOIN n ON x.h3 = n.h3", days="date")
def _(t):
    return sampling.buffered_split(_blocks(t), grid.disk(grid.lattice_edges(t.cells), t.cells, 1)).select("h3", "date", "part")


@query("M9_parent_cell", oracle="SELECT s_suppkey, ((id & ~(15::BIGINT << 52)) | (5::BIGINT << 52)) | ((1::BIGINT << 30) - 1) AS parent FROM (SELECT s_suppkey, 617700169958293503 - s_suppkey * 1099511627776 AS id FROM supplier)")
def _(t):
    return t.supplier.select("s_suppkey", grid.parent(F.lit(617700169958293503) - F.col("s_suppkey") * 1099511627776, 5).alias("parent"))


@query("G6_block_label", oracle="SELECT s_suppkey, ((id & ~(15::BIGINT << 52)) | (4::BIGINT << 52)) | ((1::BIGINT << 33) - 1) AS block FROM (SELECT s_suppkey, 617700169958293503 - s_suppkey * 1099511627776 AS id FROM supplier)")
def _(t):
    """The parent at the default resolution of spatial blocks."""
    return t.supplier.select("s_suppkey", grid.parent(F.lit(617700169958293503) - F.col("s_suppkey") * 1099511627776, grid.BLOCK_RESOLUTION).alias("block"))


@query("M10_folds")
def _(t):
    """Groups dealt to folds, even in rows and kinds; a greedy choice, which SQL does not have."""
    own = written(t.pred.select("h3", "date", "species", "species_use_log_pred", F.expr("h3 div 5").alias("block")))  # read three times
    return sampling.with_folds(own, "block", "species", F.col("species_use_log_pred") > 0.4, ["A", "N", "R"], 5).select("h3", "date", "species", "block", "fold")


@query("M11_fold_split", "pred", "SELECT h3, date, species, h3 % 5 AS fold FROM pred WHERE h3 % 5 <> 2", days="date")
def _(t):
    return sampling.fold_split(t.pred.select("h3", "date", "species", (F.col("h3") % 5).alias("fold")), 2)[0]


_DESIGNS = ["groups", "buffered", "random", "time"]
_BY_GROUP = "SELECT '{d}' AS design, CASE WHEN before < total * 0.25e0 THEN 'test' ELSE 'train' END AS part FROM x JOIN (SELECT {g} AS k, coalesce(sum(n) OVER (ORDER BY ({g} * 2654435761) % 1000003, {g} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM (SELECT {g}, count(*) AS n FROM x GROUP BY 1) s) c ON c.k = x.{g}"


@query("M12_designs", "regimes cells", f"""WITH {_EDGES}, x AS (SELECT h3, date, h3 // 5 AS block, component, seascape FROM regimes),
    t AS (SELECT block FROM (SELECT block, coalesce(sum(n) OVER (ORDER BY (block * 2654435761) % 1000003, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM (SELECT block, count(*) AS n FROM x GROUP BY 1) s) c WHERE before < total * 0.25e0),
    near AS (SELECT DISTINCT e.neighbor AS h3 FROM e JOIN x ON e.h3 = x.h3 JOIN t ON t.block = x.block),
    p AS ({" UNION ALL ".join(_BY_GROUP.format(d=d, g=g) for d, g in (("spatial", "block"), ("component", "component"), ("class", "seascape")))}
        UNION ALL SELECT 'buffered', CASE WHEN t.block IS NOT NULL THEN 'test' WHEN near.h3 IS NOT NULL THEN 'excluded' ELSE 'train' END FROM x LEFT JOIN t ON t.block = x.block LEFT JOIN near ON near.h3 = x.h3
        UNION ALL SELECT 'random', CASE WHEN k <= round_even(0.25 * n, 0) THEN 'test' ELSE 'train' END FROM (SELECT row_number() OVER (ORDER BY ((h3 * 10007 + date_diff('day', DATE '1990-01-01', date)) * 2654435761) % 1000003, h3, date) AS k, count(*) OVER () AS n FROM x)
        UNION ALL SELECT 'time', CASE WHEN k <= CAST(floor(0.75 * n) AS BIGINT) THEN 'train' ELSE 'test' END FROM (SELECT row_number() OVER (ORDER BY date, h3) AS k, count(*) OVER () AS n FROM x))
    SELECT design, part, count(*) AS n FROM p GROUP BY 1, 2""")
def _(t):
    """Designs by name and alias, each applied to the same rows: the size of every part."""
    from functools import reduce

    own = t.regimes.select("h3", "date", F.expr("h3 div 5").alias("block"), "component", "seascape")
    order = [sampling.integer_key(F.col("h3") * 10007 + F.datediff("date", F.lit("1990-01-01").cast("date"))), F.col("h3"), F.col("date")]
    ring = grid.disk(grid.lattice_edges(t.cells), t.cells, 1)
    one = lambda d: sampling.with_parts(own, d, order, ring, group_order=sampling.integer_key).groupBy("part").agg(F.count("*").alias("n")).select(F.lit(d.name).alias("design"), "part", "n")
    return reduce(lambda a, b: a.union(b), map(one, sampling.variants(_DESIGNS)))
