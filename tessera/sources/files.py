"""Facts about files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, bytes, sha256) of each file; a file is read as one row, so it has at most 2 GB."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
