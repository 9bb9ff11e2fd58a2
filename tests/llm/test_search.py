import random

import pytest
from helpers import corpus, documents, prose, shingles

from tessera.llm import decontamination, mixing
from tessera.llm.queries import domain_of
from pyspark.sql import functions as F


def brute(rows, items):
    out = []
    for i, t in rows:
        for k, u in items:
            want, have = shingles(u), shingles(t)
            if want and 100 * len(want & have) >= 80 * len(want):
                out.append((i, k, len(want), len(want & have), len(want & have) / len(want)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_index", [2_000_000, 20])
def test_contained_items(spark, max_index):
    """With one block of items and with many."""
    rng = random.Random(2)
    rows = corpus(2)
    items = [(k, prose(rng, rng.randint(1, 60))) for k in range(20)] + [(50, None), (51, ""), (52, "one"), (53, "ONE two"), (54, rows[5][1]), (54, rows[5][1])]
    for k, (_, t) in enumerate(items[:12]):
        w = t.split()
        if k % 3 == 1 and len(w) > 12:  # a change in the middle takes five shingles
            w[len(w) // 2] = "other"
        rows.append((1000 + k, f"{prose(rng, 2000 if k == 4 else 30)} {' '.join(w).upper()} {prose(rng, 10)}"))
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    df = documents(spark, rows)
    found = decontamination.contained_items(df, table, max_index=max_index)
    want = brute(rows, items)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert len(want) > 12
    clean = decontamination.without_contaminated(df, table, max_index=max_index)
    assert clean.columns == df.columns
    texts = {t for i, t in rows if any(x[0] == i for x in want) and i is not None}
    left = [r["text"] for r in clean.collect()]
    assert not texts & set(left) - {None}
    assert len(left) == sum(not any(100 * len(shingles(u) & shingles(t)) >= 80 * len(shingles(u)) for _, u in items if shingles(u)) for _, t in rows)


def test_no_items_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained_items(documents(spark, corpus()), none).count() == 0
    assert decontamination.contained_items(documents(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_divide():
    assert mixing.divide(90, [(1, 100), (2, 100)]) == pytest.approx([30, 60])
    assert mixing.divide(90, [(1, 10), (1, 100), (1, 100)]) == pytest.approx([10, 40, 40])
    assert mixing.divide(90, [(1, 10), (1, 20)]) == pytest.approx([10, 20])
    assert mixing.divide(50, [(0, 10), (1, 100)]) == pytest.approx([0, 50])
    assert mixing.divide(0, []) == []


def test_siblings_before_ancestors():
    totals = {("a", "x", "1"): 10, ("a", "x", "2"): 500, ("a", "y", "1"): 5, ("b", "x", "1"): 1000}
    got = mixing.budgets(totals, 400, {}, 1)
    # a has 200: x 100 and y 5, whose shortage of 95 goes to x and not to b
    assert got == {("a", "y", "1"): 5, ("a", "x", "1"): 10, ("a", "x", "2"): 185, ("b", "x", "1"): 200}


def table(spark, n=3000):
    rng = random.Random(1)
    rows = [(k, None if k % 97 == 0 else prose(rng, rng.randint(0, 40)), rng.choice(["en", "en", "de", None]), "src0" if k % 3 else f"src{rng.randint(1, 5)}") for k in range(n)]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_tokens", F.lit(0)).withColumn("epoch", F.lit("x"))


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 2), (1.6, 2), (0.01, 1), (5.0, 3)])
def test_mixture_is_a_prefix_of_each_epoch(spark, share, epochs):
    df = table(spark)
    weights = {("domain0",): 3.0, ("domain1", "de"): 2.0}
    domain = domain_of(F.col("source"))
    got = mixing.mixed(df, domain=domain, weights=weights, share=share, max_epochs=epochs, seed=3).collect()
    placed = mixing._placed(df.select("doc_id", "text", "lang", "source"), domain)
    rows = [(tuple(r["_" + c] for c in ("domain", "lang", "source")), r["_tokens"], r["doc_id"]) for r in placed.collect()]
    totals = {}
    for leaf, t, _ in rows:
        totals[leaf] = totals.get(leaf, 0) + t
    want = mixing.budgets(totals, share * sum(totals.values()), weights, epochs)
    for leaf, budget in want.items():
        own = [r for r in got if (r["domain"], r["lang"], r["source"]) == leaf]
        full = budget // totals[leaf] if totals[leaf] else 0
        order = {r["doc_id"]: r["h"] for r in placed.select("doc_id", mixing._order(3, F.lit(full)).alias("h")).collect()}
        todo = sorted((order[i], t, i) for x, t, i in rows if x == leaf)
        taken, expect = 0, []
        at = 0
        while at < len(todo):  # rows of one hash go together
            group = [x for x in todo if x[0] == todo[at][0]]
            taken += sum(x[1] for x in group)
            if taken > budget - full * totals[leaf] or budget == full * totals[leaf]:
                break
            expect += [(x[2], full) for x in group]
            at += len(group)
        expect += [(i, e) for x, _, i in rows if x == leaf for e in range(full)]
        assert sorted((r["doc_id"], r["epoch"]) for r in own) == sorted(expect)


def test_selected_keeps_columns(spark):
    df = table(spark, 300)
    kept = mixing.selected(df, domain=F.lit("d"), weights={}, share=0.5)
    assert kept.columns == df.columns
    assert 0 < kept.count() < df.count()
    assert mixing.selected(df, domain=F.lit("d"), weights={}, share=1.0).count() == df.count()
    empty = df.where("false")
    assert mixing.selected(empty, domain=F.lit("d"), weights={}).count() == mixing.mixed(empty, domain=F.lit("d"), weights={}).count() == 0


def test_columns_of_the_caller_stay(spark):
    """Names that the operators use themselves, and texts that are very long."""
    mine = ("_tokens", "_lang", "_source", "_domain", "_text", "_full", "_cut", "_times", "c0", "domain", "_h")
    df = table(spark, 300).withColumns({c: F.lit("mine") for c in mine})
    long = df.limit(1).withColumn("text", F.repeat(F.lit("word "), F.lit(2_000_000)))
    df = df.unionByName(long)
    kept = mixing.selected(df, domain=domain_of(F.col("source")), weights={}, share=1.0)
    assert kept.columns == df.columns
    assert kept.count() == df.count()
    assert {tuple(r) for r in kept.select(*mine).distinct().collect()} == {("mine",) * len(mine)}
    assert mixing.mixed(df, domain=F.lit("d"), weights={}, share=1.0, max_epochs=1).agg(F.max("n_tokens")).first()[0] == 2_000_000
