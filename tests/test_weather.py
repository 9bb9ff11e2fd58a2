import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import weather
from tessera.plans import render
from tessera.plans.watch import watch
from tessera.schema import WEATHER
from tessera.sources import weather as source
from tessera.sources.files import digests
from tessera.streaming.weather import LiveReport, dealt, pace, replay

SAMPLE = [
    (0, 0, 25.5, 50.0, 1000.0, 1.5, 10.0),
    (60, 1, 30.0, 40.0, 1010.0, 0.0, 5.0),
    (120, 0, -5.0, 80.0, 990.0, 2.5, 20.0),
    (61, 2, 40.0, 55.0, 1005.0, 10.0, 15.0),
    (121, 1, 0.0, 45.0, 995.0, 0.5, 8.0),
    (3600, 0, 41.0, 60.0, 1000.0, 0.0, 12.0),
]


def brute(rows, k):
    """The report in plain Python."""
    out = [f"TOTAL_MEASUREMENTS {len(rows)}"]
    value = lambda f, c: f([r[c] for r in rows]) if rows else 0.0
    mean = lambda x: sum(x) / len(x)
    for c, name in ((2, "TEMPERATURE"), (3, "HUMIDITY"), (4, "PRESSURE")):
        out += [f"{a}_{name} {value(f, c):.6f}" for a, f in (("AVERAGE", mean), ("MIN", min), ("MAX", max))]
    out += [f"TOTAL_RAINFALL {value(sum, 5):.6f}", f"MAX_RAINFALL {value(max, 5):.6f}", f"AVERAGE_WIND_SPEED {value(mean, 6):.6f}", f"MAX_WIND_SPEED {value(max, 6):.6f}"]
    out.append(f"EXTREME_TEMPERATURE_EVENTS {sum(r[2] >= 40 or r[2] <= 0 for r in rows)}")
    for name, sign in (("HOTTEST", -1), ("COLDEST", 1)):
        t, ts, s = min(((sign * r[2], r[0], r[1]) for r in rows), default=(0.0, 0, 0))
        out.append(f"{name}_MEASUREMENT {sign * t + 0.0:.6f} {s} {ts}")
    n, interval = min(((-n, i) for i, n in Counter(int(r[0] / 60) for r in rows).items()), default=(0, -1))
    out += [f"BUSIEST_INTERVAL {interval} {-n}", "TOP_STATIONS"]
    for s, n in sorted(Counter(r[1] for r in rows).items(), key=lambda x: (-x[1], x[0]))[:k]:
        own = [r for r in rows if r[1] == s]
        out.append(f"{s} {n} {sum(r[2] for r in own) / n:.6f} {sum(r[5] for r in own):.6f}")
    return "\n".join(out) + "\n"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, WEATHER).repartition(parts)


@pytest.mark.parametrize("parts", [1, 4])
def test_sample_report(spark, parts):
    assert render.report(frame(spark, SAMPLE, parts), 2) == brute(SAMPLE, 2)


@pytest.mark.parametrize(("n", "k", "s", "seed"), [(500, 3, 7, 5), (1000, 5, 1, 8), (999, 100, 6, 99), (4000, 4, 300, 77)])
def test_generated_report(spark, n, k, s, seed):
    rows = list(source.generated(n, s, seed))
    assert render.report(frame(spark, rows), k) == brute(rows, k)


def test_empty_and_zero_k(spark):
    assert render.report(frame(spark, []), 3) == brute([], 3)
    assert render.report(frame(spark, SAMPLE), 0) == brute(SAMPLE, 0)
    with pytest.raises(ValueError):
        weather.top_stations(frame(spark, SAMPLE), -1)


def test_ties_negative_times_and_bounds(spark):
    rows = [(-61, 5, 45.0, 1.0, 1.0, 1.0, 1.0), (-61, 4, 45.0, 1.0, 1.0, 1.0, 1.0), (-1, -2, 1.0, 1.0, 1.0, 1.0, 1.0), (1, 9, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = frame(spark, rows)
    assert weather.hottest(df).collect() == [(45.0, -61, 4)]
    assert weather.coldest(df).collect() == [(1.0, -1, -2)]
    assert {tuple(r) for r in weather.interval_histogram(df).collect()} == {(-1, 2), (0, 2)}
    assert weather.busiest_interval(df).collect() == [(-1, 2)]
    assert {r[0] for r in weather.station_stats(df, 6).collect()} == {4, 5}
    assert weather.global_metrics(df).first()["n"] == 4


def test_partials_merge_to_the_whole(spark):
    rows = list(source.generated(700, 9, 3))
    df = frame(spark, rows)
    whole = weather.merge(*weather.partials(df.withColumn("part", F.col("timestamp") % 5), "part"))
    direct = weather.global_metrics(df).first().asDict()
    assert {k: v for k, v in whole[0].first().asDict().items()} == direct
    assert sorted(whole[2].collect()) == sorted(weather.station_stats(df).collect())


def test_text_with_odd_lines(spark, tmp_path):
    path = tmp_path / "w.txt"
    good = "\n".join(" ".join(map(str, r)) for r in SAMPLE)
    path.write_text(f"\n7 2 3\n{good}\n1 2 3 4 5 6\n1 2 3 4 5 6 x\n  \t \n0\t1 2 3 4 5\t NaN\n 9  1 1 1 1 1 1 8\n")
    meta, df = source.read_weather(spark, str(path))
    assert (meta.n, meta.k, meta.s) == (7, 2, 3)
    assert sorted(map(tuple, df.collect())) == sorted(SAMPLE)
    assert tuple(source.quality(spark, str(path)).first()) == (7, 6, 4)


def test_no_header(spark, tmp_path):
    path = tmp_path / "w.txt"
    path.write_text("1 1 1 1 1 1 1\n")
    meta, df = source.read_weather(spark, str(path))
    assert (meta.n, meta.k, df.count()) == (None, 10, 1)


@pytest.mark.parametrize("files", [1, 2, 5])
def test_live_report_equals_batch(spark, tmp_path, files):
    rows = list(source.generated(2000, 40, 11))
    random.Random(1).shuffle(rows)
    frame(spark, rows, 5).write.parquet(str(tmp_path / "in"))
    live = LiveReport(spark, str(tmp_path / "live"), 7)
    live.ingest(replay(spark, str(tmp_path / "in"), WEATHER, files)).awaitTermination()
    batch = frame(spark, rows)
    one, intervals, stations = live.snapshot()
    assert one.first().asDict() == weather.global_metrics(batch).first().asDict()
    assert sorted(intervals.collect()) == sorted(weather.interval_histogram(batch).collect())
    assert live.top_stations().collect() == weather.top_stations(batch, 7).collect()
    assert [x.collect() for x in live.extremes()] == [weather.hottest(batch).collect(), weather.coldest(batch).collect()]
    assert live.summary()["records"] == 2000
    assert [x["n"] for x in live.subscribe(0.01)] == [2000]
    # a second replay of new files adds up, a restart counts nothing twice, a reset forgets
    frame(spark, rows[:10], 1).write.mode("append").parquet(str(tmp_path / "in"))
    live.ingest(replay(spark, str(tmp_path / "in"), WEATHER, files)).awaitTermination()
    assert live.snapshot()[0].first()["n"] == 2010
    live.reset()
    live.ingest(replay(spark, str(tmp_path / "in"), WEATHER)).awaitTermination()
    assert live.snapshot()[0].first()["n"] == 2010


def test_summary_counts_batches_beyond_recent_progress(spark, tmp_path):
    frame(spark, list(source.generated(60, 5, 3)), 4).write.parquet(str(tmp_path / "in"))
    live = LiveReport(spark, str(tmp_path / "live"), 7)
    assert live.summary()["records"] == 0
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 1)
    try:
        live.ingest(replay(spark, str(tmp_path / "in"), WEATHER, 1)).awaitTermination()
        found = live.summary()
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert (found["records"], found["batches"]) == (60, 4)
    assert found["elapsed_s"] > 0


def test_synthetic_grid(spark):
    low, high = source.synthetic(spark, 5000, 20).agg(F.min("temperature"), F.max("temperature")).first()
    assert -30 <= low < high <= 50


def test_compaction_keeps_the_report(spark, tmp_path):
    rows = list(source.generated(900, 30, 5))
    live = LiveReport(spark, str(tmp_path / "live"), 5)
    for part in range(3):  # a fold of batches, of a fold and batches, and once more, which removes what the first replaced
        dealt(frame(spark, rows[part * 300 : part * 300 + 300], 1), str(tmp_path / "in" / f"p={part}"), 100)
        live.ingest(replay(spark, str(tmp_path / "in" / "*"), WEATHER, 1)).awaitTermination()
        so_far = frame(spark, rows[: part * 300 + 300])
        before = live.summary()
        assert (before["records"], before["batches"]) == (part * 300 + 300, part * 3 + 3)
        for _ in range(2):
            one, intervals, stations = live.snapshot()
            assert one.first().asDict() == weather.global_metrics(so_far).first().asDict()
            assert sorted(intervals.collect()) == sorted(weather.interval_histogram(so_far).collect())
            assert [x.collect() for x in live.extremes()] == [weather.hottest(so_far).collect(), weather.coldest(so_far).collect()]
            live.compact()
        assert live.compact() is None
        assert live.summary() == before
    assert len(list((tmp_path / "live" / "folded").glob("upto=*"))) == 2
    assert len(list((tmp_path / "live" / "parts").glob("batch_id=*"))) == 3
    shown, counters = [], tmp_path / "counters.csv"
    watch(live, None, str(counters), shown.append)
    watch(live, 0.01, str(counters), shown.append, times=2)
    assert len(shown) == 3 and "TOTAL_MEASUREMENTS 900" in shown[0] and len(counters.read_text().splitlines()) == 4
    assert (tmp_path / "live" / "folded" / "upto=99").mkdir(parents=True) is None  # a fold that no manifest names
    assert live.snapshot()[0].first()["n"] == 900


def test_pace():
    assert pace(500, 1000) == "500 milliseconds"
    with pytest.raises(ValueError, match="positive"):
        pace(0, 1)


def test_digests(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    found = digests(spark, str(tmp_path / "a.txt")).first()
    assert (found["bytes"], found["sha256"]) == (3, hashlib.sha256(b"abc").hexdigest())
