"""Matrix files: dense rows of blank-separated numbers, or i, j, v by tabs; and a generator."""

from __future__ import annotations

import random
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import shared
from tessera.schema import COORDINATES

#: Splits whose places are broadcast, some hundred bytes each; those of more are joined by a shuffle.
BROADCAST_SPLITS = 100_000


def is_sparse(spark: SparkSession, path: str) -> bool:
    """Whether the first line that isn't blank holds a tab."""
    first = spark.read.text(path).where(_not_blank("value")).limit(1).collect()
    return bool(first) and "\t" in first[0]["value"]


def read_sparse(spark: SparkSession, *paths: str) -> DataFrame:
    """Coordinates without zero cells."""
    return spark.read.csv(list(paths), sep="\t", schema=COORDINATES, mode="FAILFAST").where("v <> 0")


def _not_blank(value) -> Column:
    return F.trim(F.translate(value, "\t\r", "  ")) != ""


def _row(value) -> Column:
    return F.transform(F.split(F.trim(F.translate(value, "\t\r", "  ")), r"\s+"), lambda x: x.cast("double"))


def split_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, splits) of the lines that aren't blank: rows (file, block, at, row), written once; splits (file, block, first,
    many, narrow, wide, before): the smallest at, the rows, their least and most columns, and the rows of all splits before.

    The lines of a split are read in order and numbered as they come, so a line's place in its split is at - first.
    Files follow one another by name.
    """
    block = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), block.alias("block")).where(_not_blank("value"))
    rows = shared.stored(lines.select("file", "block", F.monotonically_increasing_id().alias("at"), _row("value").alias("row")), "rows")
    width = F.size("row")
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("many"), F.min(width).alias("narrow"), F.max(width).alias("wide"))
    before = F.sum("many").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))  # of a row for each split
    return rows, shared.stored(splits.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).coalesce(1), "splits")


def numbered_rows(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(i, row: array) of the lines that aren't blank, in the order of files and lines.

    Rows are numbered by counts of splits.  whole reads each file as one row instead, for small ones.
    """
    if whole:
        lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\r?\n"), _not_blank).alias("l")).select(F.posexplode("l").alias("i", "value"))
        return lines.select(F.col("i").cast("long").alias("i"), _row("value").alias("row"))
    return _numbered(*split_rows(spark, path))


def _numbered(rows: DataFrame, splits: DataFrame) -> DataFrame:
    places = splits.select("file", "block", (F.col("before") - F.col("first")).alias("shift"))
    if splits.count() <= BROADCAST_SPLITS:
        places = F.broadcast(places)
    return rows.join(places, ["file", "block"]).select((F.col("at") + F.col("shift")).alias("i"), "row")


def check_even(rows: DataFrame) -> DataFrame:
    """rows, or an error if they differ in length."""
    low, high = rows.agg(F.min(F.size("row")), F.max(F.size("row"))).first()
    _check_widths(low, high)
    return rows


def _check_widths(low: int | None, high: int | None) -> None:
    if low != high:
        raise ValueError(f"ragged rows: {low} to {high} columns")


def read_dense(spark: SparkSession, path: str, whole: bool = False) -> tuple[DataFrame, tuple[int, int]]:
    """(coordinates, (rows, columns)); ragged rows are an error.  Lines are parsed once, and the checks read a row for each split."""
    if whole:
        rows = check_even(numbered_rows(spark, path, whole))
        m, n = rows.agg(F.count("*"), F.coalesce(F.max(F.size("row")), F.lit(0))).first()
    else:
        held, splits = split_rows(spark, path)
        low, n, m = splits.agg(F.min("narrow"), F.coalesce(F.max("wide"), F.lit(0)), F.coalesce(F.sum("many"), F.lit(0))).first()
        _check_widths(n if low is None else low, n)
        rows = _numbered(held, splits)
    cells = rows.select("i", F.posexplode("row").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")
    return cells.where("v <> 0"), (m, n)


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """Coordinates of files of either format, which the first line of each tells; rows of dense files follow one another."""
    out, first = None, 0
    for path in paths:
        if is_sparse(spark, path):
            cells = read_sparse(spark, path)
        else:
            cells, (m, _) = read_dense(spark, path)
            cells, first = cells.withColumn("i", F.col("i") + first), first + m
        out = cells if out is None else out.unionByName(cells)
    if out is None:
        raise ValueError("no file is named")
    return out


def write_file(path: str, rows: list[list[int]], sparse: bool = False) -> None:
    """A local file of a generated matrix."""
    with Path(path).open("w") as out:
        for i, row in enumerate(rows):
            out.write("".join(f"{i}\t{j}\t{v}\n" for j, v in enumerate(row) if v) if sparse else " ".join(map(str, row)) + "\n")


def generated(m: int, n: int, p: int, seed: int, density: float = 1.0) -> tuple[list[list[int]], list[list[int]]]:
    """Two matrices, m by n and n by p, of integers from -5 to 5; density is held between 0.001 and 1."""
    rng, density = random.Random(seed), min(1.0, max(0.001, density))

    def rows(height: int, width: int) -> Iterator[list[int]]:
        for _ in range(height):
            yield [rng.randint(-5, 5) if rng.random() < density else 0 for _ in range(width)]

    return list(rows(m, n)), list(rows(n, p))
