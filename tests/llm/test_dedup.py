import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import corpus, documents, lower, prose, shingles
from pyspark.sql import functions as F

from tessera.llm import near_join
from tessera.llm.exact_dedup import chunks_of, exact_duplicates


def exact(rows):
    """Exactly one row of each group is kept: one with the largest id, nulls last."""
    groups = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        groups[lower(t)].append(k)
    out = []
    for t, group in groups.items():
        keep = max(group, key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
        out += [(rows[k][0], rows[keep][0], len(group), k == keep, hashlib.sha256(t.encode()).hexdigest()) for k in group]
    return sorted(out, key=repr)


@pytest.mark.parametrize("identifier", [F.xxhash64, lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(5))])
def test_exact_groups(spark, identifier):
    """Also with identifiers that collide all the time."""
    rows = corpus()
    long = "".join(t or "" for _, t in rows)
    rows += [(900, long), (901, long.upper()), (902, long[:-1]), (903, long[1:])]
    found = exact_duplicates(documents(spark, rows), identifier=identifier)
    assert sorted(map(tuple, found.collect()), key=repr) == exact(rows)


def test_one_row_of_each_group_is_kept(spark):
    rows = [(None, "only me"), (None, "zz"), (None, "ZZ"), (9, "b"), (9, "B"), (9, "b"), (3, "b"), (None, "b"), (None, ""), (None, None), (-5, ""), (-5, None), (1, "one")]
    for identifier in (F.xxhash64, lambda c: F.lit(1)):
        found = exact_duplicates(documents(spark, rows), identifier=identifier).collect()
        assert sorted(map(tuple, found), key=repr) == exact(rows)
        assert sum(r["kept"] for r in found) == len({lower(t) for _, t in rows})
        assert {r["text_sha256"] for r in found} == {r["text_sha256"] for r in found if r["kept"]}


def test_exact_empty(spark):
    assert exact_duplicates(documents(spark, [])).count() == 0


def test_chunks_are_the_text_and_follow_content(spark):
    text = " ".join(t or "" for _, t in corpus(5, 200)) + "\n"
    df = spark.createDataFrame([(text,), ("new words here " + text,), ("",), ("a\n",)], "t string").select("t", chunks_of(F.col("t")).alias("c"))
    a, b, c, d = df.collect()
    assert all("".join(r["c"]) == r["t"] for r in (a, b, c, d))
    assert len(set(a["c"]) & set(b["c"])) > len(a["c"]) / 2


def components(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = i if least[root(k)] is None else min(i, least[root(k)])
    return sorted(((i, len(s), least[root(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_near_components(spark, seed, monkeypatch):
    if seed:  # with shingles known as frequent
        monkeypatch.setattr(near_join, "REPORT_AT", 1)
        monkeypatch.setattr(near_join, "FREQUENT_AT", 2)
    rows = corpus(seed)
    found = near_join.near_duplicates(documents(spark, rows))
    assert sorted(map(tuple, found.collect()), key=repr) == components(rows)


def test_chain_at_the_threshold(spark):
    """Each text shares just 0.8 with the next, and 0.79 is no link."""
    w = [f"w{k}" for k in range(60)]
    a = w[:13]  # 9 shingles
    b = w[:12]  # 8 of them
    c = w[1:13]
    d = ["z", *w[1:12]]
    rows = [(5, " ".join(a)), (3, " ".join(b)), (9, " ".join(c)), (1, " ".join(d)), (0, " ".join(w))]
    assert sorted(map(tuple, near_join.near_duplicates(documents(spark, rows)).collect())) == components(rows)


def test_near_empty_and_one_of_each(spark):
    assert near_join.near_duplicates(documents(spark, [])).count() == 0
    rows = [(k, t) for k, (_, t) in enumerate(corpus())]
    df = documents(spark, rows)
    kept = near_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, n, c in components(rows) if not n or c == i)


def test_one_row_of_each_with_repeated_ids_and_rows(spark):
    rng = random.Random(4)
    a, u, b, c = (prose(rng, 40) for _ in range(4))
    rows = [(1, a), (5, a), (5, u), (9, b), (9, b), (None, b + " more"), (None, c), (None, c), (7, ""), (7, ""), (None, None), (3, "one two")]
    df = documents(spark, rows).withColumns({k: F.lit("mine") for k in ("row", "id", "stays", "c0", "judged_row", "set_id")})
    kept = near_join.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(1, a), (5, u), (9, b), (None, c), (7, ""), (7, ""), (None, None), (3, "one two")], key=repr)
    assert {r[k] for r in kept.collect() for k in ("row", "id", "stays", "c0", "judged_row", "set_id")} == {"mine"}
    assert near_join.one_of_each(documents(spark, [])).count() == 0


def test_links_through_rows_without_id(spark):
    """Two documents that only a row without id links, and a very long text."""
    w = [f"w{k}" for k in range(60)]
    long = " ".join(f"x{k % 9000}" for k in range(700_000))
    rows = [(5, " ".join(w[:54])), (None, " ".join(w[:48])), (3, " ".join(w[6:48])), (8, long), (6, long + " end")]
    want = components(rows)
    assert {c for i, _, c in want if i in (5, 3)} == {3}
    assert sorted(map(tuple, near_join.near_duplicates(documents(spark, rows)).collect()), key=repr) == want


@pytest.mark.parametrize("block", [4096, 7])
def test_forest_loses_no_pair(spark, block, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK_NODES", block)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = []
    for _ in range(60):
        keep = base[rng.random(400) < rng.choice([0.1, 0.5, 0.9, 0.97])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, rng.integers(0, 80)).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    maps = [near_join.bitmap(s) for s in sets]
    assert len({len(m) for m in maps}) > 1
    forest = near_join.Forest(sizes, np.arange(60), np.arange(60), maps)
    pairs = {tuple(sorted(p)) for a, b in forest.pairs(forest, 80) for p in zip(a.tolist(), b.tolist(), strict=True)}
    true = {(a, b) for a in range(60) for b in range(a + 1, 60) if near_join.similar(sets[a], sets[b], 80)}
    assert true
    assert true <= pairs
    assert len(pairs) < 60 * 59 / 4
    alike = near_join.Forest(sizes, np.arange(60), np.zeros(60, dtype=int), maps)
    assert sum(len(a) for a, _ in alike.pairs(alike, 80)) == 0
    # the same by blocks, dealt to tasks
    rows = spark.createDataFrame([(1, k, int(sizes[k]), k) for k in range(60)], "hub long, set_id long, size int, component long")
    dealt = near_join.blocked(rows).join(spark.createDataFrame(list(enumerate(maps)), "set_id long, signature binary"), "set_id")
    dealt = dealt.select("work", "cross", "side", "size", "set_id", "component", "signature").orderBy("work").toArrow()
    found = [tuple(r.values()) for b in near_join._trees(dealt.to_batches(max_chunksize=13), 80) for r in b.to_pylist()]
    assert true <= set(found)
    assert len(found) == len(set(found))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in near_join.components(edges).collect()}
    assert found == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100}
