"""The live report while its stream runs, across crashes and folds."""

import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessera import shared
from tessera.operators import weather
from tessera.schema import WEATHER
from tessera.sources import weather as source
from tessera.streaming import weather as live_weather
from tessera.streaming.weather import LiveReport, replay


def files(spark, folder, many, each, seed=4):
    rows = list(source.generated(many * each, 12, seed))
    for k in range(many):
        spark.createDataFrame(rows[k * each : (k + 1) * each], WEATHER).coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(rows, WEATHER)


def consistent(view):
    """Records that all results of a view agree on."""
    n = view.whole.first()["n"]
    assert n == view.manifest["records"]
    assert (view.stations.agg(F.sum("n")).first()[0] or 0) == n
    assert (view.intervals.agg(F.sum("n")).first()[0] or 0) == n
    return n


def test_every_view_of_a_running_stream_is_of_whole_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live_weather, "FOLD_AT", 5)
    whole = files(spark, str(tmp_path / "in"), 12, 50)
    live = LiveReport(spark, str(tmp_path / "live"), 5)
    query = live.ingest(replay(spark, str(tmp_path / "in"), WEATHER, 1), every="0 seconds")
    seen = []
    try:
        while not seen or seen[-1] < 600:
            assert query.exception() is None
            seen.append(consistent(live.view()))
        assert live.drain(60)["records"] == 600
    finally:
        query.stop()
    assert seen == sorted(seen) and all(n % 50 == 0 for n in seen)
    assert live.view().whole.first().asDict() == weather.global_metrics(whole).first().asDict()
    assert any(t.startswith("folded/") for t in live.manifest()["tables"])  # the stream folded by itself


@pytest.mark.parametrize("step", ["before", "after"])
def test_a_crash_around_the_manifest_counts_nothing_twice(spark, tmp_path, monkeypatch, step):
    whole = files(spark, str(tmp_path / "in"), 4, 30)
    live = LiveReport(spark, str(tmp_path / "live"), 5)
    publish, calls = live._publish, []

    def breaks(manifest):
        calls.append(manifest["last"])
        if len(calls) == 3:
            if step == "after":
                publish(manifest)
            raise RuntimeError("killed")
        publish(manifest)

    monkeypatch.setattr(live, "_publish", breaks)
    with pytest.raises(StreamingQueryException):
        live.ingest(replay(spark, str(tmp_path / "in"), WEATHER, 1)).awaitTermination()
    assert consistent(live.view()) == (60 if step == "before" else 90)
    live.ingest(replay(spark, str(tmp_path / "in"), WEATHER, 1)).awaitTermination()
    assert consistent(live.view()) == 120
    assert live.view().whole.first().asDict() == weather.global_metrics(whole).first().asDict()


def test_a_view_outlives_the_fold_after_it(spark, tmp_path):
    files(spark, str(tmp_path / "in"), 3, 20)
    live = LiveReport(spark, str(tmp_path / "live"))
    live.ingest(replay(spark, str(tmp_path / "in"), WEATHER, 1)).awaitTermination()
    before = live.view()
    assert live.compact() == 2
    assert consistent(before) == consistent(live.view()) == 60
    assert live.compact() is None


def test_two_writers_are_refused(spark, tmp_path):
    live = LiveReport(spark, str(tmp_path / "live"))
    now = live.manifest()
    live._publish(now)
    with pytest.raises(RuntimeError, match="another stream"):
        live._publish(now)
    assert live.manifest()["version"] == 1


def test_nothing_ingested(spark, tmp_path):
    live = LiveReport(spark, str(tmp_path / "live"))
    assert consistent(live.view()) == 0
    assert live.compact() is None and list(live.subscribe(0)) == []
    assert live.top_stations().collect() == live.busiest_interval().collect() == live.extremes()[0].collect() == []


def test_drain_has_a_time_limit(spark, tmp_path, monkeypatch):
    files(spark, str(tmp_path / "in"), 2, 5)
    live = LiveReport(spark, str(tmp_path / "live"))
    keep = live._keep
    monkeypatch.setattr(live, "_keep", lambda batch, number: (time.sleep(1), keep(batch, number)))
    query = live.ingest(replay(spark, str(tmp_path / "in"), WEATHER, 1), every="0 seconds")
    try:
        with pytest.raises(TimeoutError):
            live.drain(0.2)
        assert live.drain(60)["records"] == 10
    finally:
        query.stop()


def test_small_files(spark, tmp_path):
    path = str(tmp_path / "m" / "1.json")
    assert shared.names(spark, str(tmp_path / "m")) == []
    assert shared.create_json(spark, path, {"a": "é"}) and not shared.create_json(spark, path, {"a": 2})
    assert shared.read_json(spark, path) == {"a": "é"} and [n for n in shared.names(spark, str(tmp_path / "m"))] == ["1.json"]
