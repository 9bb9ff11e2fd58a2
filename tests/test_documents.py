import random

import pytest

from tessera.operators import documents
from tessera.schema import EDIT
from tessera.streaming import documents as stream
from tessera.streaming import tables


def ops(spark, rows):
    return spark.createDataFrame(rows, EDIT)


BASIC = [
    (1, "create", " d ", None, "Hello World", 1),
    (2, "insert", "d", 6, "Distributed ", 2),
    (3, "insert", "d", 10**6, "x", 2),
    (4, "insert", "missing", 0, "x", 2),
    (5, "create", "   ", None, "x", 1),
    (6, "create", "d", None, "other", 3),
    (7, "insert", "d", 0, "a😀b", 1),
    (8, "insert", "d", None, "y", 1),
    (9, "insert", "d", -1, "y", 1),
    (10, "create", "e", None, None, None),
    (11, "insert", "e", 0, None, None),
]
STATUS = ["CREATED", "APPLIED", "OUT_OF_RANGE", "NOT_FOUND", "INVALID_ARGUMENT", "ALREADY_EXISTS", "APPLIED", "OUT_OF_RANGE", "OUT_OF_RANGE", "CREATED", "APPLIED"]


def test_outcomes(spark):
    found = sorted(documents.outcomes(ops(spark, BASIC)).collect())
    assert [r["status"] for r in found] == STATUS
    assert found[6]["content"] == "a😀bHello Distributed World"
    assert sorted(map(tuple, documents.final_state(ops(spark, BASIC)).collect())) == [("d", "a😀bHello Distributed World", 3), ("e", "", 2)]
    assert {r["status"] for r in documents.rejected(ops(spark, BASIC)).collect()} == {"OUT_OF_RANGE", "NOT_FOUND", "INVALID_ARGUMENT", "ALREADY_EXISTS"}
    stats = {r["edited_by"]: (r["commands"], r["accepted"], r["refused"]) for r in documents.session_stats(documents.outcomes(ops(spark, BASIC))).collect()}
    assert stats[2] == (3, 1, 2)
    assert sorted(map(tuple, documents.listing(documents.final_state(ops(spark, BASIC))).collect())) == [("d", 3, 26), ("e", 2, 0)]


def test_fold_equals_walk_in_any_input_order(spark):
    rng = random.Random(4)
    rows = [(k, "create" if k < 5 else "insert", f"n{k % 5}", rng.randint(-2, 60), f"<{k}>", k % 3) for k in range(200)]
    rng.shuffle(rows)
    walked = documents.latest(documents.history(ops(spark, rows)))
    folded = documents.final_state(ops(spark, rows))
    assert sorted(walked.collect()) == sorted(folded.collect())
    for r in folded.collect():
        assert r["version"] == 1 + r["content"].count("<") - 1


def test_same_position_race(spark):
    rows = [(0, "create", "d", None, "", 0)] + [(k, "insert", "d", 0, f"<{k:03}>", k % 8) for k in range(1, 201)]
    (row,) = documents.final_state(ops(spark, rows)).collect()
    assert row["version"] == 201
    assert row["content"] == "".join(f"<{k:03}>" for k in range(200, 0, -1))


def test_monotone(spark):
    feed = spark.createDataFrame([(1, "d", 1), (2, "d", 3), (3, "d", 2), (4, "d", 3), (5, "d", 4)], "seq long, name string, version long")
    assert [r["version"] for r in documents.monotone(feed).orderBy("seq").collect()] == [1, 3, 4]


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch(spark, tmp_path, files):
    for k in range(3):
        ops(spark, BASIC[4 * k : 4 * k + 4]).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
    source = spark.readStream.schema(EDIT).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "ops"))
    name = f"docs{files}"
    query = stream.outcomes(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["status"] for r in spark.table(name).orderBy("seq").collect()] == STATUS


def test_empty(spark):
    assert documents.final_state(ops(spark, [])).count() == documents.outcomes(ops(spark, [])).count() == 0


def test_a_hundred_thousand_edits_of_one_name(spark):
    from pyspark.sql import functions as F

    edits = spark.range(1, 100_001).select(
        F.col("id").alias("seq"), F.lit("insert").alias("op"), F.lit("d").alias("name"), ((F.col("id") * 7919) % (F.col("id") * 5 - 4)).alias("position"),
        F.lpad((F.col("id") % 100_000).cast("string"), 5, "0").alias("text"), F.lit(1).cast("long").alias("edited_by"),
    )
    made = edits.unionByName(ops(spark, [(0, "create", "d", None, "", 1)]))
    (row,) = documents.final_state(made.repartition(7)).collect()
    assert row["version"] == 100_001 and len(row["content"]) == 500_000
    plain = ""
    for k in range(1, 2001):  # the first ones, as a plain string
        at = k * 7919 % (k * 5 - 4)
        plain = plain[:at] + f"{k % 100_000:05}" + plain[at:]
    (row,) = documents.final_state(made.where("seq <= 2000")).collect()
    assert row["content"] == plain


TIES = [
    (1, "insert", "d", 0, "x", 1),
    (1, "create", "d", None, "y", 2),
    (2, "insert", "d", 0, "b", 1),
    (2, "insert", "d", 0, "a", 1),
    (2, "insert", "d", None, "a", 1),
    (3, "create", "\ta ", None, "t", 1),
    (3, "create", "　\xa0", None, "t", 1),
    (4, "insert", "a", 1, "!", None),
    (4, "insert", "a", 1, "!", 3),
    (None, "create", "n", None, None, None),
    (None, "insert", "n", 0, None, None),
]


def test_one_order_and_one_rule_for_names(spark, tmp_path):
    """Outcomes, the fold, the store's rule and both streams agree where seq repeats and names have odd spaces."""
    for seed in range(3):
        rows = list(TIES)
        random.Random(seed).shuffle(rows)
        found = documents.outcomes(ops(spark, rows).repartition(3))
        assert {(r["name"], r["op"], r["status"]) for r in found.collect() if r["name"] != "d"} == {("a", "create", "CREATED"), ("", "create", "INVALID_ARGUMENT"), ("a", "insert", "APPLIED"), ("n", "create", "CREATED"), ("n", "insert", "APPLIED")}
        expected = [("a", "t!!", 3), ("d", "baxy", 4), ("n", "", 2)]
        assert sorted(map(tuple, documents.latest(documents.history(ops(spark, rows))).collect())) == expected
        assert sorted(map(tuple, documents.final_state(ops(spark, rows)).collect())) == expected
    ops(spark, rows).coalesce(1).write.parquet(str(tmp_path / "ops"))
    source = spark.readStream.schema(EDIT).parquet(str(tmp_path / "ops"))
    kept = tables.ChangeTable(spark, str(tmp_path / "table"), stream.states(source).schema, ["name"])
    kept.fold(stream.states(source)).awaitTermination()
    assert sorted(map(tuple, kept.read().collect())) == expected
    assert documents.plain_name("\t\x1c a b　\x85") == "a b" and documents.plain_name(None) == ""


def test_white_space_is_what_python_strips():
    assert set(documents.SPACES) == {chr(k) for k in range(0x110000) if chr(k).isspace()}


def test_fold_from_a_checkpoint(spark):
    rng = random.Random(8)
    rows = [(k, "create" if k < 6 else "insert", f"n{k % 6}", rng.randint(0, 80), f"<{k}>", 1) for k in range(240)]
    for cut in (0, 3, 100, 239):
        since = documents.final_state(ops(spark, rows[:cut]))
        assert sorted(documents.final_state(ops(spark, rows[cut:]), since).collect()) == sorted(documents.final_state(ops(spark, rows)).collect())


def test_stream_of_states_over_many_batches_and_a_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FOLD_AT", 3)
    rng = random.Random(2)
    rows = [(k, "create" if k < 4 else "insert", f"n{k % 4}", rng.randint(0, 40), f"<{k}>", 1) for k in range(80)]
    (tmp_path / "ops").mkdir()
    source = spark.readStream.schema(EDIT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops"))
    kept = tables.ChangeTable(spark, str(tmp_path / "table"), stream.states(source).schema, ["name"])
    for k in range(8):
        ops(spark, rows[10 * k : 10 * k + 10]).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
        if k % 4 == 3:
            kept.fold(stream.states(source)).awaitTermination()
            assert sorted(kept.read().collect()) == sorted(documents.final_state(ops(spark, rows[: 10 * k + 10])).collect())
    assert kept.manifest()["last"] == 7
    assert {r["batch"] for r in kept.changes(6).collect()} == {7}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_column_functions_agree_with_the_rope(spark):
    from pyspark.sql import functions as F

    from tessera.functions import fits, inserted

    df = spark.createDataFrame([("a😀b", "x", k) for k in range(-1, 5)], "c string, t string, p long")
    got = df.select("p", fits(F.col("p"), F.col("c")).alias("ok"), inserted(F.col("c"), F.col("t"), F.col("p")).alias("made")).orderBy("p").collect()
    assert [r["ok"] for r in got] == [False, True, True, True, True, False]
    assert [r["made"] for r in got[1:5]] == ["xa😀b", "ax😀b", "a😀xb", "a😀bx"]
