"""Benchmark logs as CSV files with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.schema import SWEEP


def read_sweep(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.csv(list(paths), header=True, schema=SWEEP)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of CSV files."""
    rows.write.mode("append").option("header", True).csv(path)
