"""Results of stateful streams as tables.

A stateful stream runs in update mode on the RocksDB store: each batch gives the
keys that it changed, executors write them as one table of changes, and a
manifest names the tables that count.  A reader takes the last change of each
key.  Nothing of a result passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera import shared

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Tables of changes after which they are folded into one.
FOLD_AT = 32


@contextmanager
def on_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, on disk and in logs of changes."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ChangeTable:
    """The result of a stateful stream in a folder: the last row of each value of keys."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])

    @property
    def checkpoint(self) -> str:
        return f"{self.folder}/checkpoint"

    def _manifests(self) -> list[str]:
        return [n for n in shared.names(self.spark, f"{self.folder}/manifest") if n.endswith(".json")]

    def manifest(self) -> dict:
        there = self._manifests()
        return shared.read_json(self.spark, f"{self.folder}/manifest/{there[-1]}") if there else {"version": 0, "last": -1, "tables": []}

    def _publish(self, now: dict) -> None:
        if not shared.create_json(self.spark, f"{self.folder}/manifest/{now['version'] + 1:012d}.json", now | {"version": now["version"] + 1}):
            raise RuntimeError("another stream writes to this folder")

    def _keep(self, changes: DataFrame, number: int) -> None:
        now = self.manifest()
        if number <= now["last"]:
            return
        table = f"changes/batch_id={number}"
        changes.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/{table}")
        now |= {"last": number, "tables": [*now["tables"], table]}
        if len(now["tables"]) >= FOLD_AT:
            folded = f"folded/upto={number}"
            self._last_of(self._rows(now["tables"])).write.mode("overwrite").parquet(f"{self.folder}/{folded}")
            now["tables"] = [folded]
        self._publish(now)

    def fold(self, result: DataFrame, every: str | None = None) -> StreamingQuery:
        """Starts the stateful stream result; without every, takes what there is now and ends."""
        with on_rocksdb(self.spark):
            writer = result.writeStream.outputMode("update").foreachBatch(self._keep).option("checkpointLocation", self.checkpoint)
            return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()

    def _rows(self, tables: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{t}" for t in tables)) if tables else self.spark.createDataFrame([], self.schema)

    def _last_of(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
        return last.select(*(F.col(c) if c in self.keys else F.col(f"last.{c}") for c in self.schema.names))

    def changes(self, after: int = -1) -> DataFrame:
        """The kept changes of the batches after a number, with the batch; those that were folded count as of the key's last one."""
        return self._rows(self.manifest()["tables"]).where(F.col("batch") > after)

    def read(self) -> DataFrame:
        """The result as of the newest manifest."""
        return self._last_of(self._rows(self.manifest()["tables"])).drop("batch")
