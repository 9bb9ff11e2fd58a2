from pyspark.sql import functions as F

from tessera.operators import weather
from tessera.plans import metrics
from tessera.schema import WEATHER
from tessera.sources import weather as source
from tessera.streaming import tables
from tessera.streaming import weather as live_weather
from tessera.streaming.weather import LiveReport, replay


def test_stage_times_as_a_table(spark, tmp_path):
    table = str(tmp_path / "timings")
    for label in ("one", "two"):
        with metrics.timed(spark, label, table) as rows:
            assert spark.range(1000).repartition(3).groupBy(F.col("id") % 7).count().count() == 7
        assert len(rows) >= 2 and all(r["label"] == label and r["seconds"] >= 0 and r["tasks"] > 0 for r in rows)
        assert sum(r["shuffle_written"] for r in rows) > 0
    with metrics.timed(spark, "three", table):
        pass
    found = {r["label"]: r for r in metrics.timings(spark, table).collect()}
    assert set(found) == {"one", "two"} and found["one"]["stages"] >= 2
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_worker_table(spark):
    before = metrics.workers(spark)[0]["done_tasks"]
    spark.range(10).repartition(4).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    (row,) = metrics.workers(spark)
    assert row["alive"] and row["worker"] == "driver" and row["done_tasks"] >= before + 4
    text = metrics.worker_table([row]).splitlines()
    assert len(text) == 2 and text[0].split() == ["worker", "alive", "active", "done", "failed", "seconds"] and text[1].split()[:2] == ["driver", "yes"]


def test_observed(spark):
    df, seen = metrics.observed(spark.range(10), "seen", rows=F.count("*"), most=F.max("id"))
    assert df.count() == 10 and seen.get == {"rows": 10, "most": 9}


def test_every_batch_is_logged_with_what_it_observes(spark, tmp_path):
    rows = list(source.generated(60, 5, 3))
    spark.createDataFrame(rows, WEATHER).repartition(6).write.parquet(str(tmp_path / "in"))
    live, log = LiveReport(spark, str(tmp_path / "live")), str(tmp_path / "log")
    assert metrics.batches(spark, log).count() == 0
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 1)
    try:
        with metrics.logged(spark, log):
            stream = replay(spark, str(tmp_path / "in"), WEATHER, 1).observe("seen", F.count("*").alias("records"), F.max("temperature").alias("hottest"))
            query = live.ingest(stream)
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    found = metrics.batches(spark, log).orderBy("batch").collect()
    assert [r["batch"] for r in found] == list(range(len(found))) and len(found) > 1
    assert sum(r["records"] for r in found) == 60 == sum(int(r["observed"]["seen.records"]) for r in found)
    assert max(float(r["observed"]["seen.hottest"]) for r in found) == max(r[2] for r in rows)
    assert {r["run"] for r in found} == {str(query.runId)} and all(r["phases"]["addBatch"] >= 0 for r in found)
    assert metrics.stages(spark, str(query.runId))  # the stages of the stream's batches


def test_state_and_its_changes(spark, tmp_path):
    rows = list(source.generated(400, 30, 8))
    halves = [spark.createDataFrame(part, WEATHER).coalesce(1) for part in (rows[:300], rows[300:])]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(WEATHER).parquet(str(tmp_path / "in"))
    counted = stream.groupBy("station_id").count()
    kept = tables.ChangeTable(spark, str(tmp_path / "t"), counted.schema, ["station_id"])
    for half in halves:
        half.write.mode("append").parquet(str(tmp_path / "in"))
        kept.fold(counted).awaitTermination()
    count = lambda df: {r["station_id"]: r["n"] for r in weather.station_stats(df).collect()}
    first, second, whole = count(halves[0]), count(halves[1]), count(halves[0].union(halves[1]))
    state = lambda df: {r["key"]["station_id"]: r["value"]["count"] for r in df.collect()}
    assert state(live_weather.state_of(spark, kept.checkpoint)) == whole
    assert state(live_weather.state_of(spark, kept.checkpoint, 0)) == first
    changes = live_weather.state_changes(spark, kept.checkpoint, 1)
    assert {(r["batch_id"], r["change_type"]) for r in changes.collect()} == {(1, "update")}
    assert state(changes) == {k: whole[k] for k in second}
    assert {r["station_id"]: r["count"] for r in kept.read().collect()} == whole
