"""Hexagonal cells: ids, parents, neighbors; and a lattice of our own for grids without a cell library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecube.operators.ordering import running_total

#: Steps from an axial position (q, r) to the six around it.
STEPS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
#: Resolution of the cells that are the blocks of spatial validation.
BLOCK_RESOLUTION = 4


def id_from_hex(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("long")


def parent(cell: Column, resolution: int) -> Column:
    """The ancestor of a 64-bit hexagon id at a coarser resolution: the resolution field set, the finer digits all 7."""
    low = (1 << (3 * (15 - resolution))) - 1
    return cell.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.lit(resolution << 52)).bitwiseOR(F.lit(low))


def lattice_edges(cells: DataFrame, cell: str = "h3") -> DataFrame:
    """(cell, side 1 to 6, neighbor) of cells with axial q and r; only neighbors that are in the grid."""
    offs = F.array(*(F.struct(F.lit(i).cast("long").alias("side"), (F.col("q") + a).alias("q"), (F.col("r") + b).alias("r")) for i, (a, b) in enumerate(STEPS, 1)))
    wanted = cells.select(F.col(cell).alias("cell"), F.explode(offs).alias("o")).select("cell", "o.*")
    return wanted.join(cells.select("q", "r", F.col(cell).alias("neighbor")), ["q", "r"]).select(F.col("cell").alias(cell), "side", "neighbor")


def edges_from_wide(wide: DataFrame, cell: str = "h3", columns: tuple[str, ...] = ("n1", "n2", "n3", "n4", "n5", "n6")) -> DataFrame:
    """(cell, neighbor) of a table with a column for each neighbor, null where there is none."""
    return wide.select(cell, F.explode(F.array(*columns)).alias("neighbor")).where("neighbor is not null")


def wide_neighbors(edges: DataFrame, cells: DataFrame, cell: str = "h3") -> DataFrame:
    """(cell, n1 to n6): neighbors in order of their ids, padded with null; cells without neighbors too."""
    lists = edges.groupBy(cell).agg(F.array_sort(F.collect_list("neighbor")).alias("__n"))
    return cells.select(cell).join(lists, cell, "left").select(cell, *(F.get(F.col("__n"), F.lit(i)).alias(f"n{i + 1}") for i in range(6)))


def neighbor_index(wide: DataFrame, cell: str = "h3") -> DataFrame:
    """(idx, n1 to n6) with dense row numbers by id instead of ids, -1 for none."""
    idx = running_total(wide.select(cell, F.lit(1).alias("one")), cell, "one", "idx").select(cell, F.col("idx").cast("long").alias("idx"))
    long = wide.select(cell, F.posexplode(F.array(*(f"n{i}" for i in range(1, 7)))).alias("side", "neighbor")).join(idx.withColumnRenamed(cell, "neighbor").withColumnRenamed("idx", "to"), "neighbor", "left")
    sides = long.groupBy(cell).agg(*(F.coalesce(F.max(F.when(F.col("side") == i, F.col("to"))), F.lit(-1)).alias(f"n{i + 1}") for i in range(6)))
    return idx.join(sides, cell).select("idx", *(f"n{i}" for i in range(1, 7)))


def disk(edges: DataFrame, cells: DataFrame, k: int, cell: str = "h3") -> DataFrame:
    """(cell, neighbor) of all cells within k steps, the cell itself too."""
    out = cells.select(cell, F.col(cell).alias("neighbor"))
    step = edges.select(F.col(cell).alias("neighbor"), F.col("neighbor").alias("next"))
    for _ in range(k):
        out = out.union(out.join(step, "neighbor").select(cell, F.col("next").alias("neighbor"))).distinct()
    return out


def neighbor_gradient(values: DataFrame, edges: DataFrame, columns: list[str], keys: tuple[str, str] = ("h3", "date")) -> DataFrame:
    """(cell, date, <column>_grad): root mean square difference to the neighbors of the same day that have a value; null if none has, or the cell itself has none."""
    cell, date = keys
    near = values.join(edges.select(cell, "neighbor"), cell)
    other = values.select(F.col(cell).alias("neighbor"), date, *(F.col(c).alias(f"__{c}") for c in columns))
    met = near.join(other, ["neighbor", date]).groupBy(cell, date).agg(*(F.sqrt(F.avg(F.pow(F.col(c) - F.col(f"__{c}"), F.lit(2)))).alias(f"{c}_grad") for c in columns))
    return values.select(cell, date).join(met, [cell, date], "left")
