"""Matrix products as a join on the inner index and a sum by cell.

Matrices are coordinates (i, j, v).  Zero cells are dropped before the join.  A
right side of at most BROADCAST_CELLS cells is broadcast after it was counted.
Larger ones are multiplied by tiles (tiled_product): each pair of tiles that
meet is a piece of work of its own, so a dense row, column or inner index is
spread over tasks, and a tile of the product is summed from pieces of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_CELLS = 4_000_000
#: Rows and columns of a tile.
TILE = 256


def dims(cells: DataFrame) -> DataFrame:
    """One row (rows, columns): the largest indices and one; 0 and 0 for no cells."""
    one = lambda c: F.coalesce(F.max(c) + 1, F.lit(0)).cast("long")
    return cells.agg(one("i").alias("rows"), one("j").alias("columns"))


def reducer_count(cells: DataFrame, most: int = 64) -> DataFrame:
    """One row (reducers): distinct rows of the matrix, 1 to most."""
    return cells.agg(F.least(F.lit(most), F.greatest(F.lit(1), F.countDistinct("i"))).cast("long").alias("reducers"))


def checked(cells: DataFrame, on_duplicate: str = "error") -> DataFrame:
    """cells with one row for each (i, j): repeated cells are an error, or are added up with on_duplicate='sum'."""
    if on_duplicate == "sum":
        return cells.groupBy("i", "j").agg(F.sum("v").alias("v"))
    twice = cells.groupBy("i", "j").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("a cell is given twice")
    return cells


def check_product(a: DataFrame, b: DataFrame, a_dims: tuple[int, int] | None = None, b_dims: tuple[int, int] | None = None) -> None:
    """Raises unless the columns of a are as many as the rows of b; sizes come from the cells where they aren't given."""
    a_dims = a_dims or tuple(dims(a).first())
    b_dims = b_dims or tuple(dims(b).first())
    if a_dims[1] != b_dims[0]:
        raise ValueError(f"dimension mismatch: {a_dims} by {b_dims}")


def product(a: DataFrame, b: DataFrame, broadcast_cells: int = BROADCAST_CELLS, tile: int = TILE, sizes: tuple[tuple[int, int], tuple[int, int]] | None = None) -> DataFrame:
    """The nonzero cells (i, j, v) of the product; sizes (rows, columns) of both that do not fit are an error.

    Without sizes nothing is checked: cells alone do not tell of empty last columns or rows.
    """
    if sizes is not None:
        check_product(a, b, *sizes)
    right = b.where("v <> 0").select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    if right.limit(broadcast_cells + 1).count() > broadcast_cells:
        return tiled_product(a, b, tile)
    left = a.where("v <> 0").select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    return left.join(F.broadcast(right), "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v")).where("v <> 0")


def tiles(cells: DataFrame, tile: int, row: str, column: str) -> DataFrame:
    """(row, column, at: array, v: array): the nonzero cells by tile, at being place in row times tile plus place in column; at most tile * tile of them."""
    place = F.pmod("i", F.lit(tile)) * tile + F.pmod("j", F.lit(tile))
    return (
        cells.where("v <> 0")
        .select(F.expr(f"(i - pmod(i, {tile})) div {tile}").alias(row), F.expr(f"(j - pmod(j, {tile})) div {tile}").alias(column), F.struct(place.cast("int").alias("at"), "v").alias("cell"))
        .groupBy(row, column)
        .agg(F.collect_list("cell").alias("cells"))
        .select(row, column, F.col("cells.at").alias("at"), F.col("cells.v").alias("v"))
    )


def tiled_product(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """The nonzero cells (i, j, v) of the product, by tiles.

    A tile of a is sent to each column of tiles that b has in its inner block, and
    a tile of b to each row of tiles that a has there, so both meet under (row
    block, inner block, column block).  A task multiplies one pair at a time; the
    cells of its product are summed by place.
    """
    left, right = tiles(a, tile, "p", "q"), tiles(b, tile, "q", "r")
    # which tiles there are: numbers alone; the rows and columns of tiles of one inner block
    there = left.select("p", "q").join(right.select("q", "r"), "q")
    pairs = left.join(there, ["p", "q"]).withColumnsRenamed({"at": "a_at", "v": "a_v"}).join(right.withColumnsRenamed({"at": "b_at", "v": "b_v"}), ["q", "r"])
    dealt = pairs.select("p", "q", "r", "a_at", "a_v", "b_at", "b_v").repartition("p", "q", "r")

    def multiply(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                p, _, r = (batch.column(c)[k].as_py() for c in range(3))
                x, y = np.zeros(tile * tile), np.zeros(tile * tile)
                for out, at, v in ((x, 3, 4), (y, 5, 6)):
                    np.add.at(out, np.asarray(batch.column(at)[k].values), np.asarray(batch.column(v)[k].values))
                made = (x.reshape(tile, tile) @ y.reshape(tile, tile)).reshape(-1)
                some = np.flatnonzero(made)
                yield pa.RecordBatch.from_arrays([pa.array(p * tile + some // tile), pa.array(r * tile + some % tile), pa.array(made[some])], ["i", "j", "v"])

    return dealt.mapInArrow(multiply, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")


def from_rows(rows: DataFrame) -> DataFrame:
    """Coordinates of rows (i, row: array), without zeros."""
    return rows.select("i", F.posexplode("row").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")).where("v <> 0")


def to_rows(cells: DataFrame, rows: int | None = None, columns: int | None = None) -> DataFrame:
    """(i, row: array of all columns) for every row of a matrix, zeros filled in; sizes that aren't given come from the largest indices."""
    if rows is None or columns is None:
        most = dims(cells).first()
        rows, columns = most["rows"] if rows is None else rows, most["columns"] if columns is None else columns
    held = cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
    spine = cells.sparkSession.range(rows).select(F.col("id").alias("i"))
    filled = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long")), lambda j: F.coalesce(F.try_element_at(F.col("m"), j), F.lit(0.0)))
    return spine.join(held, "i", "left").select("i", (filled if columns else F.array().cast("array<double>")).alias("row"))


def row_major(cells: DataFrame) -> DataFrame:
    return cells.orderBy("i", "j")
