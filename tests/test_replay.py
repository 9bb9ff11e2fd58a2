import random
import time

import pytest

from tessera.operators import weather
from tessera.schema import WEATHER
from tessera.sources import weather as source
from tessera.streaming import replay
from tessera.streaming.weather import LiveReport


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    """(folder, records in the order of the replay): 700 records with many equal times, in files of up to 60."""
    rows = list(source.generated(700, 9, 3, tmax=100))
    random.Random(1).shuffle(rows)
    folder = str(tmp_path_factory.mktemp("replay") / "r")
    assert replay.prepare(spark.createDataFrame(rows, WEATHER).repartition(3), folder, 60) == 700
    return folder, sorted(rows)


def test_offsets_count_records(prepared, monkeypatch):
    monkeypatch.setattr(replay, "TASK_ROWS", 25)
    folder, rows = prepared
    reader = replay.ReplayReader({"path": folder})
    for low, high in ((0, 700), (0, 0), (59, 61), (123, 456), (699, 700)):
        parts = reader.partitions({"record": low}, {"record": high})
        assert all(p.high - p.low <= 25 for p in parts)
        got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert got == rows[low:high]
    assert [reader.time_of(k) for k in (0, 60, 699)] == [rows[k][0] for k in (0, 60, 699)]
    for moment in (-1, 0, 33, 33.5, 99, 100, 1000):
        assert reader.until(moment) == sum(r[0] <= moment for r in rows)


def test_batch_size_rate_and_speed(prepared):
    folder, rows = prepared
    made = lambda **o: replay.ReplayReader({"path": folder, **{k: str(v) for k, v in o.items()}})
    assert [made(batchSize=100).released(s) for s in (0, 5)] == [100, 100]
    assert [made(rate=50).released(s) for s in (0, 2, 100)] == [0, 100, 700]
    first = rows[0][0]
    assert [made(speed=10).released(s) for s in (0, 3)] == [sum(r[0] <= first + 10 * s for r in rows) for s in (0, 3)]
    assert made(batchSize=30, rate=50, speed=10).released(1) == 30
    late = made(rate=50, **{"from": 650})
    assert late.released(0.5) == 675 and late.latestOffset() == {"record": 650}
    with pytest.raises(ValueError):
        made(rate=0)


def test_stream_in_order_with_a_restart(spark, prepared, tmp_path):
    """Batches of 90 records in order of time; stopped after three, the next run goes on at record 270 and each comes once."""
    folder, rows = prepared
    checkpoint, batches = str(tmp_path / "c"), []

    def take(batch, number):
        batches.append((number, sorted(map(tuple, batch.collect()))))
        if number == 2 and len(batches) == 3:
            raise RuntimeError("stopped")

    def start():
        return replay.replayed(spark, folder, checkpoint, batch_size=90).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()

    query = start()
    with pytest.raises(Exception, match="stopped"):
        query.processAllAvailable()
    assert replay.position(spark, checkpoint) == 270
    query = start()  # the third batch was not committed and comes again
    query.processAllAvailable()
    query.stop()
    numbers = [n for n, _ in batches]
    assert numbers == [0, 1, 2, 2, 3, 4, 5, 6, 7] and batches[2] == batches[3]
    assert [r for n, b in batches[:2] + batches[3:] for r in b] == rows
    query = start()  # all was taken; there is nothing new
    query.processAllAvailable()
    query.stop()
    assert len(batches) == 9


def test_live_report_over_a_replay_at_a_speed(spark, prepared, tmp_path):
    folder, rows = prepared
    live = LiveReport(spark, str(tmp_path / "live"), 5)
    began = time.monotonic()
    query = live.ingest(replay.replayed(spark, folder, live.checkpoint, speed=10), every="0 seconds")
    try:
        while live.view().manifest["records"] < 700:
            assert query.exception() is None and time.monotonic() - began < 90
            time.sleep(0.1)
        took = time.monotonic() - began
    finally:
        query.stop()
    assert took >= (rows[-1][0] - rows[0][0]) / 10
    assert live.view().manifest["batches"] > 1
    assert live.view().whole.first().asDict() == weather.global_metrics(spark.createDataFrame(rows, WEATHER)).first().asDict()


def test_nothing_to_replay(spark, tmp_path):
    assert replay.prepare(spark.createDataFrame([], WEATHER), str(tmp_path / "r")) == 0
    reader = replay.ReplayReader({"path": str(tmp_path / "r"), "speed": "1"})
    assert reader.latestOffset() == {"record": 0} and reader.partitions({"record": 0}, {"record": 0}) == []
