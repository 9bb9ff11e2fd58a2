"""What ran where and for how long: executors, stages of a piece of work, batches of a stream; as rows and as tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tessera import shared

WORKERS = "worker string, host string, alive boolean, active_tasks long, done_tasks long, failed_tasks long, task_seconds double, input_bytes long, shuffle_bytes long"
STAGES = "label string, stage long, name string, tasks long, seconds double, task_seconds double, rows_in long, rows_out long, shuffle_read long, shuffle_written long, spilled long, began double"
BATCHES = "query string, run string, batch long, records long, records_per_second double, trigger_seconds double, phases map<string, long>, observed map<string, string>, at double"


def _each(found) -> Iterator:
    """The items of a Scala sequence."""
    for k in range(found.size()):
        yield found.apply(k)


def workers(spark: SparkSession) -> list[dict]:
    """A row (WORKERS) for each executor that this application has had; on one machine the driver is the only one."""
    out = []
    for e in _each(spark.sparkContext._jsc.sc().statusStore().executorList(False)):
        if e.id() == "driver" and not spark.sparkContext.master.startswith("local["):
            continue
        out.append({
            "worker": e.id(), "host": e.hostPort(), "alive": e.isActive(), "active_tasks": e.activeTasks(), "done_tasks": e.completedTasks(), "failed_tasks": e.failedTasks(),
            "task_seconds": e.totalDuration() / 1000, "input_bytes": e.totalInputBytes(), "shuffle_bytes": e.totalShuffleRead() + e.totalShuffleWrite(),
        })
    return out


def stages(spark: SparkSession, group: str, label: str | None = None) -> list[dict]:
    """A row (STAGES) for each stage that ran for a job group; a stream's group is its run id."""
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    numbers = sorted({s for job in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(job)) for s in info.stageIds})
    out = []
    for number in numbers:
        try:
            s = store.lastStageAttempt(number)
        except Exception:  # so long ago that Spark has forgotten it
            continue
        if s.submissionTime().isEmpty():  # skipped: its result was there
            continue
        began = s.submissionTime().get().getTime() / 1000
        ended = s.completionTime().get().getTime() / 1000 if not s.completionTime().isEmpty() else time.time()
        out.append({
            "label": label or group, "stage": number, "name": s.name(), "tasks": s.numTasks(), "seconds": ended - began, "task_seconds": s.executorRunTime() / 1000, "rows_in": s.inputRecords(),
            "rows_out": s.outputRecords(), "shuffle_read": s.shuffleReadBytes(), "shuffle_written": s.shuffleWriteBytes(), "spilled": s.diskBytesSpilled(), "began": began,
        })
    return out


@contextmanager
def timed(spark: SparkSession, label: str, table: str | None = None) -> Iterator[list[dict]]:
    """Times what runs inside: the list has a row for each stage afterwards, which is appended to the table too."""
    context, group, out = spark.sparkContext, f"timed-{uuid.uuid4().hex}", []
    context.setJobGroup(group, label)
    try:
        yield out
    finally:
        context._jsc.sc().clearJobGroup()
        context._jsc.sc().listenerBus().waitUntilEmpty()
        out += stages(spark, group, label)
        if table and out:
            spark.createDataFrame(out, STAGES).coalesce(1).write.mode("append").parquet(table)


def timings(spark: SparkSession, table: str) -> DataFrame:
    """(label, stages, seconds, task_seconds, rows_in, shuffle_written) of a table of stage times."""
    sums = [F.sum(c).alias(c) for c in ("seconds", "task_seconds", "rows_in", "shuffle_written")]
    return spark.read.schema(STAGES).parquet(table).groupBy("label").agg(F.count("*").alias("stages"), *sums)


def observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """df whose next action counts metrics (column expressions) beside its work, and where to get them."""
    seen = Observation(name)
    return df.observe(seen, *(m.alias(k) for k, m in metrics.items())), seen


class BatchLog(StreamingQueryListener):
    """Keeps a small file for each batch of the streams of a session, with what the stream observes; batches() reads them as a table.

    Spark itself remembers the last hundred batches of a running stream only.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def onQueryStarted(self, event) -> None:
        return

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.numInputRows:
            return
        seen = {f"{name}.{k}": str(v) for name, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        rate = p.processedRowsPerSecond
        row = {
            "query": str(p.id), "run": str(p.runId), "batch": p.batchId, "records": p.numInputRows, "records_per_second": rate if rate == rate else 0.0, "trigger_seconds": p.durationMs.get("triggerExecution", 0) / 1000,
            "phases": dict(p.durationMs), "observed": seen, "at": time.time(),
        }
        shared.create_json(self.spark, f"{self.folder}/{p.id}-{p.batchId:012d}.json", row)

    def onQueryIdle(self, event) -> None:
        return

    def onQueryTerminated(self, event) -> None:
        return


@contextmanager
def logged(spark: SparkSession, folder: str) -> Iterator[BatchLog]:
    """Streams that run inside are logged to a folder."""
    log = BatchLog(spark, folder)
    spark.streams.addListener(log)
    try:
        yield log
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(log)


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """The table (BATCHES) of a log; one row for each batch, the first of a batch that was run twice."""
    if not any(n.endswith(".json") for n in shared.names(spark, folder)):
        return spark.createDataFrame([], BATCHES)
    return spark.read.schema(BATCHES).option("pathGlobFilter", "*.json").json(folder)


def worker_table(rows: list[dict]) -> str:
    """Lines of a worker table."""
    head = f"{'worker':<10}{'alive':<7}{'active':>8}{'done':>8}{'failed':>8}{'seconds':>10}"
    return "\n".join([head, *(f"{r['worker']:<10}{'yes' if r['alive'] else 'no':<7}{r['active_tasks']:>8}{r['done_tasks']:>8}{r['failed_tasks']:>8}{r['task_seconds']:>10.1f}" for r in rows)])
