"""The sensor report over a stream, queryable while it runs.

start() writes one table of partial aggregates per micro-batch, from one pass
of grouping sets, and then a manifest: a small file that appears as a whole or
not at all and names the tables that count, with the counters of the batches in
them.  A reader takes the newest manifest once and reads all kinds of results
from its tables, so they always tell of the same batches, however many are
being written.  A batch that is repeated after a crash is skipped if a manifest
has it and written anew if not.  compact() folds the tables of a manifest into
one.  Records may come in any order of time: there is no watermark, and every
record counts.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera import shared
from tessera.functions import interval_of, is_extreme
from tessera.operators import weather
from tessera.schema import MEASURES
from tessera.streaming.tables import on_rocksdb

#: Levels of a row of partial aggregates.
INTERVAL, STATION, WHOLE, HOTTEST, COLDEST = 1, 2, 3, 4, 5
_ENDS = [f"{name}_{m}" for name in ("min", "max") for m in MEASURES]
PARTIAL = T.StructType(
    [T.StructField("level", T.IntegerType())]
    + [T.StructField(c, T.LongType()) for c in ("interval", "station_id", "timestamp", "n", "extreme")]
    + [T.StructField(c, T.DoubleType()) for c in (*(f"sum_{m}" for m in MEASURES), *_ENDS)]
)
#: Tables after which a stream folds them by itself.
FOLD_AT = 64
#: Manifests that stay for readers that are still at them.
MANIFESTS = 16


def grouped(records: DataFrame) -> DataFrame:
    """Counts and sums over all, by interval and by station in one aggregate; level is Spark's grouping id: 3, 1 and 2."""
    keyed = records.select(interval_of(F.col("timestamp")).alias("interval"), "station_id", *MEASURES)
    sets = keyed.groupingSets([[], ["interval"], ["station_id"]], "interval", "station_id")
    ends = [f(m).alias(f"{name}_{m}") for name, f in (("min", F.min), ("max", F.max)) for m in MEASURES]
    return sets.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *(F.sum(m).alias(f"sum_{m}") for m in MEASURES), *ends, F.count_if(is_extreme(F.col("temperature"))).alias("extreme"))


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PARTIAL))


def _ends(rows: DataFrame) -> DataFrame:
    """Rows of the levels HOTTEST and COLDEST from readings (temperature, timestamp, station_id)."""
    both = weather.hottest(rows).withColumn("level", F.lit(HOTTEST)).unionByName(weather.coldest(rows).withColumn("level", F.lit(COLDEST)))
    return _shaped(both.withColumnRenamed("temperature", "max_temperature"))


def partial_rows(records: DataFrame) -> DataFrame:
    """The partial aggregates (PARTIAL) of records."""
    return _shaped(grouped(records)).unionByName(_ends(records))


def merged(rows: DataFrame) -> DataFrame:
    """The partial aggregates of all that rows tell of: one row for each interval and station, one for all, and the two readings."""
    some = rows.where(F.col("level") <= WHOLE).groupBy("level", "interval", "station_id")
    sums = some.agg(*(f(c).alias(c) for f, cs in ((F.sum, ["n", "extreme", *(f"sum_{m}" for m in MEASURES)]), (F.min, _ENDS[:5]), (F.max, _ENDS[5:])) for c in cs))
    readings = lambda level: rows.where(F.col("level") == level).select(F.col("max_temperature").alias("temperature"), "timestamp", "station_id")
    hot = weather.hottest(readings(HOTTEST)).withColumn("level", F.lit(HOTTEST))
    cold = weather.coldest(readings(COLDEST)).withColumn("level", F.lit(COLDEST))
    return _shaped(sums).unionByName(_shaped(hot.unionByName(cold).withColumnRenamed("temperature", "max_temperature")))


@dataclass(frozen=True)
class View:
    """What the batches of one manifest give; all results tell of the same records."""

    manifest: dict
    rows: DataFrame

    def _level(self, level: int) -> DataFrame:
        return self.rows.where(F.col("level") == level)

    @property
    def whole(self) -> DataFrame:
        one = self._level(WHOLE).agg(
            F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), *(F.sum(f"sum_{m}").alias(f"sum_{m}") for m in MEASURES),
            *(F.min(c).alias(c) for c in _ENDS[:5]), *(F.max(c).alias(c) for c in _ENDS[5:]), F.coalesce(F.sum("extreme"), F.lit(0).cast("long")).alias("extreme"),
        )
        return one.withColumns({f"avg_{m}": F.try_divide(F.col(f"sum_{m}"), F.col("n")) for m in MEASURES})

    @property
    def intervals(self) -> DataFrame:
        return self._level(INTERVAL).groupBy("interval").agg(F.sum("n").alias("n"))

    @property
    def stations(self) -> DataFrame:
        return self._level(STATION).groupBy("station_id").agg(F.sum("n").alias("n"), F.sum("sum_temperature").alias("sum_temperature"), F.sum("sum_rainfall").alias("sum_rainfall"))

    def _reading(self, level: int) -> DataFrame:
        return self._level(level).select(F.col("max_temperature").alias("temperature"), "timestamp", "station_id")

    @property
    def hottest(self) -> DataFrame:
        return weather.hottest(self._reading(HOTTEST))

    @property
    def coldest(self) -> DataFrame:
        return weather.coldest(self._reading(COLDEST))

    def top_stations(self, k: int) -> DataFrame:
        top = self.stations.orderBy(F.desc("n"), "station_id").limit(weather.check_k(k))
        return top.select("station_id", "n", (F.col("sum_temperature") / F.col("n")).alias("avg_temperature"), "sum_rainfall")

    def busiest_interval(self) -> DataFrame:
        return self.intervals.orderBy(F.desc("n"), "interval").limit(1)


_NOTHING = {"version": 0, "last": -1, "tables": [], "replaced": [], "records": 0, "batches": 0, "seconds": 0.0}


class LiveReport:
    """A running report: ingest, view, subscribe, reset.  One stream writes to a folder; any number of readers."""

    def __init__(self, spark: SparkSession, folder: str, k: int = weather.DEFAULT_K):
        self.spark, self.folder, self.k = spark, folder.rstrip("/"), weather.check_k(k)
        self.query: StreamingQuery | None = None
        self._writing = threading.Lock()

    def _path(self, *parts: str) -> str:
        return "/".join([self.folder, *parts])

    @property
    def checkpoint(self) -> str:
        return self._path("checkpoint")

    def manifest(self) -> dict:
        """The newest one."""
        while True:
            there = [n for n in shared.names(self.spark, self._path("manifest")) if n.endswith(".json")]
            if not there:
                return dict(_NOTHING)
            try:
                return shared.read_json(self.spark, self._path("manifest", there[-1]))
            except Exception as e:  # so many newer ones that this one has gone meanwhile
                if "FileNotFound" not in str(e):
                    raise

    def _publish(self, manifest: dict) -> None:
        number = manifest["version"] + 1
        if not shared.create_json(self.spark, self._path("manifest", f"{number:012d}.json"), manifest | {"version": number}):
            raise RuntimeError("another stream writes to this folder")
        for name in [n for n in shared.names(self.spark, self._path("manifest")) if n.endswith(".json")][:-MANIFESTS]:
            shared.remove(self.spark, self._path("manifest", name))

    def _keep(self, batch: DataFrame, number: int) -> None:
        with self._writing:
            now, began = self.manifest(), time.perf_counter()
            if number <= now["last"]:  # it was published before the crash
                return
            table = f"parts/batch_id={number}"
            batch = batch.persist()
            try:
                partial_rows(batch).coalesce(1).write.mode("overwrite").parquet(self._path(table))
            finally:
                batch.unpersist()
            records = self._read([table]).where(F.col("level") == WHOLE).agg(F.sum("n")).first()[0] or 0
            seconds = time.perf_counter() - began
            self._publish(now | {"last": number, "tables": [*now["tables"], table], "records": now["records"] + records, "batches": now["batches"] + (records > 0), "seconds": now["seconds"] + seconds})
            if len(now["tables"]) + 1 >= FOLD_AT:
                self._fold()

    def ingest(self, records: DataFrame, every: str | None = None) -> StreamingQuery:
        """Starts on a stream of records; without every, takes what there is now and ends."""
        writer = records.writeStream.foreachBatch(self._keep).option("checkpointLocation", self.checkpoint)
        self.query = writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()
        return self.query

    def drain(self, timeout_s: float = 300.0) -> dict:
        """Waits for the stream to take all there is, and sums up the kept batches; TimeoutError where it takes longer."""
        assert self.query is not None, "nothing was ingested"
        waiting = threading.Thread(target=lambda: self.query.isActive and self.query.processAllAvailable(), daemon=True)
        waiting.start()
        waiting.join(timeout_s)
        if waiting.is_alive():
            raise TimeoutError(f"the stream has not taken all there is within {timeout_s} s")
        return self.summary()

    def summary(self) -> dict:
        """Records and batches kept so far, and the seconds spent on keeping them; the query's own progress is cut to its last updates."""
        now = self.manifest()
        seconds = float(now["seconds"])
        return {"records": now["records"], "batches": now["batches"], "elapsed_s": seconds, "records_per_second": now["records"] / seconds if seconds else 0.0, "active": bool(self.query and self.query.isActive)}

    def _read(self, tables: list[str]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], PARTIAL)
        return self.spark.read.schema(PARTIAL).parquet(*(self._path(t) for t in tables))

    def compact(self) -> int | None:
        """Folds the tables of the newest manifest into one and returns the last batch in it, None where there is nothing to fold.

        What the fold before this one replaced is removed, so a view that was
        taken before a fold can still be read.
        """
        with self._writing:
            return self._fold()

    def _fold(self) -> int | None:
        now = self.manifest()
        if len(now["tables"]) < 2:
            return None
        table = f"folded/upto={now['last']}"
        merged(self._read(now["tables"])).coalesce(1).write.mode("overwrite").parquet(self._path(table))
        self._publish(now | {"tables": [table], "replaced": now["tables"]})
        for old in now["replaced"]:
            shared.remove(self.spark, self._path(old))
        return now["last"]

    def view(self) -> View:
        """The batches so far; every result of it tells of the same ones."""
        now = self.manifest()
        return View(now, self._read(now["tables"]))

    def snapshot(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(global, by interval, by station) of one view."""
        now = self.view()
        return now.whole, now.intervals, now.stations

    def extremes(self) -> tuple[DataFrame, DataFrame]:
        """(hottest, coldest) reading so far."""
        now = self.view()
        return now.hottest, now.coldest

    def top_stations(self, k: int | None = None) -> DataFrame:
        return self.view().top_stations(self.k if k is None else k)

    def busiest_interval(self) -> DataFrame:
        return self.view().busiest_interval()

    def subscribe(self, interval_s: float = 1.0) -> Iterator[dict]:
        """Global aggregates again and again while the stream runs, whenever they have changed, and once at its end."""
        last = None
        while True:
            active = bool(self.query and self.query.isActive)
            now = self.view()
            if now.manifest["records"] and (last is None or now.manifest["records"] != last[0]):
                last = now.manifest["records"], now.whole.first().asDict()
                yield last[1]
            if not active:
                return
            time.sleep(interval_s)

    def latencies(self, times: int, pause_s: float = 0.0) -> list[float]:
        """Seconds that each of some snapshot queries takes, the stream running or not."""
        out = []
        for _ in range(times):
            began = time.perf_counter()
            self.view().whole.collect()
            out.append(time.perf_counter() - began)
            time.sleep(pause_s)
        return out

    def reset(self) -> None:
        """Forgets all batches and the place in the stream; k stays."""
        if self.query is not None and self.query.isActive:
            self.query.stop()
        self.query = None
        shared.remove(self.spark, self.folder)


def state_of(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """Keys and values in the state store of a stateful stream, as of its last committed batch or of an earlier one."""
    reader = spark.read.format("statestore")
    return (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)


def state_changes(spark: SparkSession, checkpoint: str, first: int, last: int | None = None) -> DataFrame:
    """(batch_id, change_type, key, value, partition_id): what the batches from first to last changed in the state.

    The stream must have run on RocksDB with logs of changes (tables.on_rocksdb).
    """
    with on_rocksdb(spark):
        reader = spark.read.format("statestore").option("readChangeFeed", True).option("changeStartBatchId", first)
        return (reader if last is None else reader.option("changeEndBatchId", last)).load(checkpoint)


def replay(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def dealt(records: DataFrame, folder: str, batch_size: int) -> None:
    """Writes records in the order of time for a replay, at most batch_size in a file."""
    records.orderBy("timestamp").write.option("maxRecordsPerFile", batch_size).parquet(folder)


def pace(batch_size: int, per_second: float) -> str:
    """The trigger interval for ingest(every=...) at which files of batch_size records come at most so fast."""
    if batch_size < 1 or per_second <= 0:
        raise ValueError("batch size and rate must be positive")
    return f"{max(1, round(1000 * batch_size / per_second))} milliseconds"
