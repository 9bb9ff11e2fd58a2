"""Replay of records as a stream, counted in records.

prepare() writes records in the order of time and an index of their files: where
each begins, counted in records, and its times.  The data source `replay` streams
them with offsets in records.  A batch takes at most batch_size of them, no more
than rate allows since the start, and none whose time has not come yet when time
runs speed times as fast as the clock.  Offsets are all that a checkpoint holds,
so a restart goes on at the very record; replayed() reads the last one, as Spark
asks a Python source for its newest offset without saying where it stands.
Tasks read their own rows of a file, on any file system that Arrow opens.
"""

from __future__ import annotations

import bisect
import json
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tessera import shared
from tessera.schema import WEATHER

INDEX = "_index.json"
#: Records that one task reads.
TASK_ROWS = 1 << 20


def prepare(records: DataFrame, folder: str, rows_per_file: int = TASK_ROWS) -> int:
    """Writes records (schema.WEATHER) for a replay, ordered by time and then by all columns, and returns how many they are.

    The driver sees one row for each file.
    """
    spark = records.sparkSession
    order = ["timestamp", *(c for c in WEATHER.names if c != "timestamp")]
    records.select(*WEATHER.names).orderBy(*order).write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
    name = F.col("_metadata.file_name").alias("name")
    files = spark.read.schema(WEATHER).parquet(folder).groupBy(name).agg(F.count("*").alias("rows"), F.min("timestamp").alias("low"), F.max("timestamp").alias("high"))
    index, first = [], 0
    for f in sorted(files.collect()):  # names follow the partitions of the sort and their parts
        index.append([f["name"], first, f["rows"], f["low"], f["high"]])
        first += f["rows"]
    assert all(a[4] <= b[3] for a, b in zip(index, index[1:], strict=False)), "files are out of order"
    if not shared.create_json(spark, f"{folder.rstrip('/')}/{INDEX}", {"files": index, "rows": first}):
        raise ValueError("there is a replay in this folder")
    return first


class Slice(InputPartition):
    """Rows low to high of a file."""

    def __init__(self, name: str, low: int, high: int):
        self.name, self.low, self.high = name, low, high


class ReplayReader(DataSourceStreamReader):
    """Options: path; batchSize, rate (records a second), speed (seconds of the records a second), from (the record to begin at)."""

    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.folder = options["path"].rstrip("/")
        where, root = shared.arrow_place(self.folder)
        with where.open_input_stream(f"{root}/{INDEX}") as f:
            index = json.loads(f.read())
        self.files, self.rows = index["files"], index["rows"]
        self.batch, self.rate, self.speed = (None if (v := options.get(k)) is None else float(v) for k in ("batchsize", "rate", "speed"))
        if any(v is not None and v <= 0 for v in (self.batch, self.rate, self.speed)):
            raise ValueError("batchSize, rate and speed must be positive")
        self.start = self.last = int(options.get("from", 0))
        self.began: float | None = None
        self._times: tuple[str, list[int]] = ("", [])

    def initialOffset(self) -> dict:
        return {"record": 0}

    def latestOffset(self) -> dict:
        now = time.monotonic()
        self.began = now if self.began is None else self.began
        self.last = max(self.last, self.released(now - self.began))
        return {"record": self.last}

    def released(self, seconds: float) -> int:
        """The record up to which the next batch goes, so many seconds after the start."""
        end = self.rows
        if self.batch is not None:
            end = min(end, self.last + max(1, int(self.batch)))
        if self.rate is not None:
            end = min(end, self.start + int(self.rate * seconds))
        if self.speed is not None and self.start < self.rows:
            end = min(end, self.until(self.time_of(self.start) + self.speed * seconds))
        return end

    def _file(self, record: int) -> list:
        return self.files[bisect.bisect_right(self.files, record, key=lambda f: f[1]) - 1]

    def _times_of(self, name: str) -> list[int]:
        if self._times[0] != name:
            where, root = shared.arrow_place(self.folder)
            with where.open_input_file(f"{root}/{name}") as f:
                self._times = name, pq.read_table(f, columns=["timestamp"]).column(0).to_pylist()
        return self._times[1]

    def time_of(self, record: int) -> int:
        name, first, *_ = self._file(record)
        return self._times_of(name)[record - first]

    def until(self, moment: float) -> int:
        """How many records have a time up to a moment."""
        whole = [f for f in self.files if f[4] <= moment]
        done = whole[-1][1] + whole[-1][2] if whole else 0
        rest = self.files[len(whole)] if len(whole) < len(self.files) else None
        return done + (bisect.bisect_right(self._times_of(rest[0]), moment) if rest and rest[3] <= moment else 0)

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        low, high, out = start["record"], end["record"], []
        for name, first, rows, *_ in self.files:
            a, b = max(low, first), min(high, first + rows)
            out += [Slice(name, k - first, min(b, k + TASK_ROWS) - first) for k in range(a, b, TASK_ROWS)]
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        where, root = shared.arrow_place(self.folder)
        with where.open_input_file(f"{root}/{partition.name}") as f:
            file, at = pq.ParquetFile(f), 0
            for k in range(file.num_row_groups):
                rows = file.metadata.row_group(k).num_rows
                low, high = max(partition.low, at), min(partition.high, at + rows)
                if low < high:
                    yield from file.read_row_group(k, columns=WEATHER.names).slice(low - at, high - low).to_batches()
                at += rows

    def commit(self, end: dict) -> None:
        return


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> StructType:
        return WEATHER

    def streamReader(self, schema: StructType) -> ReplayReader:
        return ReplayReader(dict(self.options))


def position(spark: SparkSession, checkpoint: str) -> int:
    """The record up to which the last batch in a checkpoint goes, 0 without one."""
    folder = f"{checkpoint.rstrip('/')}/offsets"
    batches = [n for n in shared.names(spark, folder) if n.isdigit()]
    if not batches:
        return 0
    return json.loads(shared.read_text(spark, f"{folder}/{max(batches, key=int)}").splitlines()[-1])["record"]


def replayed(spark: SparkSession, folder: str, checkpoint: str, *, batch_size: int | None = None, rate: float | None = None, speed: float | None = None) -> DataFrame:
    """A stream over prepared records, for a query with this checkpoint; trigger it by processingTime, as each call gives one batch."""
    spark.dataSource.register(ReplaySource)
    options = {"path": folder, "batchSize": batch_size, "rate": rate, "speed": speed, "from": position(spark, checkpoint)}
    return spark.readStream.format("replay").options(**{k: v for k, v in options.items() if v is not None}).load()
