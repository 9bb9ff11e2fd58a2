"""Reading and making sensor record files.

A line of three tokens is the header `N K S`; a line of seven numbers is a record;
every other line that isn't blank is malformed and counted.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import known_number
from tessera.operators.weather import DEFAULT_K
from tessera.schema import WEATHER


#: Lines in which a header is looked for first.
HEAD = 1000


@dataclass(frozen=True)
class DatasetMeta:
    """The header: declared records, length of the top list, stations; None where there is no header."""

    n: int | None = None
    k: int = DEFAULT_K
    s: int | None = None


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """The columns, worked out once for each row however often they are used: filters and projections do not pass a generator."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def parsed(lines: DataFrame) -> DataFrame:
    """lines(value) as (kind, the columns of schema.WEATHER, f): kind is record, header, blank or malformed; f the tokens."""
    blank = F.col("value").rlike("[\t\r\f\v]")
    plain = _once(lines, F.trim(F.when(blank, F.translate("value", "\t\r\f\v", "    ")).otherwise(F.col("value"))).alias("v"))
    single = F.when(F.col("v").contains("  "), F.regexp_replace("v", " +", " ")).otherwise(F.col("v"))
    tokens = _once(plain, F.split(single, " ").alias("f"))
    numbers = _once(tokens, "f", *(known_number(F.get("f", F.lit(k)), c.dataType.simpleString()).alias(c.name) for k, c in enumerate(WEATHER)))
    whole = F.size("f") == len(WEATHER)
    for c in WEATHER.names:
        whole = whole & F.col(c).isNotNull()
    kind = F.when(whole, "record").when(F.array_join("f", "") == "", "blank").when(F.size("f") == 3, "header").otherwise("malformed")
    return numbers.select(kind.alias("kind"), *WEATHER.names, "f")


def records(lines: DataFrame) -> DataFrame:
    """The records of text lines."""
    return parsed(lines).where("kind = 'record'").select(*WEATHER.names)


def malformed(lines: DataFrame) -> DataFrame:
    """One row (malformed): lines that are neither blank, header nor record."""
    return parsed(lines).agg(F.count_if(F.col("kind") == "malformed").alias("malformed"))


def meta(lines: DataFrame) -> DatasetMeta:
    """The first header line's values."""
    found = parsed(lines.where(F.length("value") < 100)).where("kind = 'header'").select(*(known_number(F.get("f", F.lit(k)), "bigint") for k in range(3))).limit(1).collect()
    if not found or None in tuple(found[0]):
        return DatasetMeta()
    return DatasetMeta(*tuple(found[0]))


class Header:
    """The header of text files, looked for when it is first asked for: in the first lines, and in all of them where those have none."""

    def __init__(self, lines: DataFrame):
        self._lines = lines

    @cached_property
    def found(self) -> DatasetMeta:
        head = meta(self._lines.limit(HEAD))
        return head if head != DatasetMeta() else meta(self._lines)

    @property
    def n(self) -> int | None:
        return self.found.n

    @property
    def k(self) -> int:
        return self.found.k

    @property
    def s(self) -> int | None:
        return self.found.s


def read_weather(spark: SparkSession, *paths: str) -> tuple[Header, DataFrame]:
    """(header, records) of text files.  Lines are parsed where they are read; save the records as Parquet to use them often."""
    lines = spark.read.text(list(paths))
    return Header(lines), records(lines)


def quality(spark: SparkSession, path: str) -> DataFrame:
    """One row (n_declared, n_read, malformed)."""
    lines = spark.read.text(path)
    declared = F.lit(Header(lines).n).cast("long").alias("n_declared")
    return parsed(lines).agg(declared, F.count_if(F.col("kind") == "record").alias("n_read"), F.count_if(F.col("kind") == "malformed").alias("malformed"))


def generated(n: int, s: int, seed: int = 42, tmax: int = 86400) -> Iterator[tuple]:
    """n records on a grid of one half, always the same for the same arguments."""
    rng = random.Random(seed)
    half = lambda low, high: rng.randint(2 * low, 2 * high) / 2
    for _ in range(n):
        yield rng.randint(0, tmax), rng.randint(0, s - 1), half(-30, 50), half(0, 100), half(950, 1050), half(0, 50), half(0, 40)


def write_text(path: str, rows, k: int, s: int) -> None:
    """A local record file with its header."""
    rows = list(rows)
    with Path(path).open("w") as out:
        out.write(f"{len(rows)} {k} {s}\n")
        out.writelines(" ".join(str(v) for v in row) + "\n" for row in rows)


def synthetic(spark: SparkSession, n: int, s: int, tmax: int = 86400, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """n records on the same grid, made where they are used; any size."""
    h = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(m))
    half = lambda k, low, high: h(k, 2 * (high - low) + 1) * F.lit(0.5) + F.lit(float(low))
    base = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return base.select(
        h(0, tmax + 1).alias("timestamp"), h(1, s).alias("station_id"), half(2, -30, 50).alias("temperature"), half(3, 0, 100).alias("humidity"),
        half(4, 950, 1050).alias("pressure"), half(5, 0, 50).alias("rainfall"), half(6, 0, 40).alias("wind_speed"),
    )
