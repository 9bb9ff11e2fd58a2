from tessera.operators import benchlog
from tessera.sources import benchlog as source

ROWS = [(10, 1, 100, r, t, 10 / t, None) for r, t in enumerate((2.0, 1.0, 4.0))] + [(10, 2, 100, r, t, 10 / t, 1.5) for r, t in enumerate((1.0, 1.0))] + [(10, 4, 100, 0, 0.5, 20.0, None)]
KEYS = ["records", "workers", "batch_size"]


def log(spark, tmp_path):
    from tessera.schema import SWEEP

    source.append(spark.createDataFrame(ROWS, SWEEP), str(tmp_path / "log"))
    return source.read_sweep(spark, str(tmp_path / "log"))


def test_summary(spark, tmp_path):
    found = log(spark, tmp_path)
    rows = {r["workers"]: r for r in benchlog.medians(found, KEYS, "elapsed_s").collect()}
    assert (rows[1]["median"], rows[1]["best"], rows[1]["below"], rows[1]["above"], rows[1]["reps"]) == (2.0, 1.0, 1.0, 2.0, 3)
    summary = benchlog.medians(found, KEYS, "recs_per_s")
    ratio = {r["workers"]: r["ratio"] for r in benchlog.speedups(summary, ["records", "batch_size"], "workers", "median").collect()}
    assert ratio == {1: 1.0, 2: 2.0, 4: 4.0}
    assert tuple(benchlog.best_configuration(summary, ["records"], ["workers", "batch_size"], "median").first()) == (10, 4, 100, 20.0)
    assert benchlog.latest(found, ["workers"], "rep", ["elapsed_s"]).where("workers = 1").first()["elapsed_s"] == 4.0
    planned = spark.createDataFrame([(10, w, 100) for w in (1, 2, 8)], "records long, workers long, batch_size long")
    assert [r["workers"] for r in benchlog.still_to_run(planned, found, KEYS).collect()] == [8]


def test_selection_equals_the_median(spark, monkeypatch):
    import random


    for bins, rounds in ((1024, 2), (4, 0), (5, 3)):
        monkeypatch.setattr(benchlog, "BINS", bins)
        monkeypatch.setattr(benchlog, "ROUNDS", rounds)
        rng = random.Random(bins)
        values = {f"g{k}": [rng.choice([float(rng.randint(0, 3)), rng.random(), 1e300 * rng.random(), -1e-300, 7.0]) for _ in range(rng.randint(1, 60))] for k in range(12)}
        values |= {None: [2.0, 1.0], "one": [3.5], "same": [4.0] * 9, "far": [-1.7e308, 1.7e308, 5.0, 6.0], "inf": [float("-inf"), 1.0, 2.0, float("inf")], "infs": [float("inf")] * 3, "nulls": [None, None]}
        rows = [(k, v, 1) for k, own in values.items() for v in own] + [("g0", None, 1)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k string, v double, n long")
        got = {r["k"]: (r["rows"], r["n"], r["median"]) for r in benchlog.selected(df.select("k", "v"), ["k"], "v").collect()}
        want = {k: (len(own) + (k == "g0"), len(some := [v for v in own if v is not None]), 0.5 * sorted(some)[(len(some) - 1) // 2] + 0.5 * sorted(some)[len(some) // 2] if some else None) for k, own in values.items()}
        assert got == want
        assert benchlog.selected(df, [], "v").first()["median"] == 0.5 * (s := sorted(v for _, v, _ in rows if v is not None))[(len(s) - 1) // 2] + 0.5 * s[len(s) // 2]
    plan = benchlog.medians(spark.createDataFrame(ROWS, "records long, workers long, batch_size long, rep long, elapsed_s double, recs_per_s double, query_latency_ms double"), KEYS, "elapsed_s")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in text and "SortAggregate" not in text
    assert benchlog.selected(df.where("false"), ["k"], "v").count() == 0
