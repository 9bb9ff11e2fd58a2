import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import corpus, documents, lower, prose
from pyspark.sql import functions as F

from tessera.llm import resampling

B = 97


def features(text, longest):
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower(text))
    return len(words), [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def brute(rows, target, percent, least, longest, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % B
    s, t = Counter(bucket(f) for _, x in rows for f in features(x, longest)[1]), Counter(bucket(f) for x in target for f in features(x, longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + B) / ((s[b] + 1) * (big_t + B)))) for b in range(B)]
    out = []
    for k, (i, x) in enumerate(rows):
        words, found = features(x, longest)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words >= least, k])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {r[5]: n for n, r in enumerate(able[: percent * len(able) // 100], 1)}
    return Counter((*r[:4], rank.get(r[5])) for r in out)


@pytest.mark.parametrize("longest,percent,least", [(1, 10, 20), (3, 37, 1), (2, 100, 0), (1, 0, 20)])
def test_same_as_brute_force(spark, longest, percent, least):
    rows = corpus(3) + [(500 + k, prose(random.Random(k), 40)) for k in range(60)]
    target = [prose(random.Random(9), 200), None, "", "ka lo ka"]
    items = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resampled(documents(spark, rows), items, percent=percent, least_words=least, buckets=B, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(rows, target, percent, least, longest)


def test_ties_go_to_the_smaller_id_and_repeated_rows_stay(spark):
    rows = spark.createDataFrame([(5, 3, 1, 10), (5, 3, 1, 10), (None, 3, 1, 10), (2, 9, 1, 10), (7, 1, 1, 11)], "doc_id long, n_features long, weight long, score long")
    above, n = resampling.offsets(rows)
    assert n == 5 and {tuple(r) for r in above.collect()} == {(11, 0), (10, 1)}
    assert sorted((r["rank"], r["doc_id"]) for r in resampling.ranked(rows, above).collect()) == [(1, 7), (2, 2), (3, 5), (4, 5), (5, None)]


def test_a_group_of_repeated_rows_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(resampling, "COPIES", 7)
    rows = spark.range(40).select(F.lit(1).cast("long").alias("doc_id"), F.lit(2).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), F.lit(3).cast("long").alias("score"))
    above, _ = resampling.offsets(rows)
    assert sorted(r["rank"] for r in resampling.ranked(rows, above).collect()) == list(range(1, 41))


def test_offsets_over_many_ranges(spark):
    rng = np.random.default_rng(0)
    scores = [int(x) for x in rng.integers(-500, 500, 4000)]
    above, n = resampling.offsets(spark.createDataFrame([(x,) for x in scores], "score long").repartition(5))
    assert n == 4000
    assert dict(map(tuple, above.collect())) == {x: sum(y > x for y in scores) for x in set(scores)}


def test_long_texts_are_split_between_words(monkeypatch):
    row = ("ab c1 " * 50 + "x" * 90 + " é").encode()
    whole = [(n, f.tolist()) for n, f in resampling.features(row, 10_000, 2)]
    monkeypatch.setattr(resampling, "SLICE", 16)
    parts = [(n, f.tolist()) for n, f in resampling.features(row, 10_000, 2)]
    assert len(parts) > 10 and sum(n for n, _ in parts) == whole[0][0]
    assert Counter(x for _, f in parts for x in f) == Counter(x for _, f in whole for x in f)


def test_empty_tables(spark):
    items = spark.createDataFrame([], "text string")
    assert resampling.resampled(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0
    got = resampling.resampled(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), items, least_words=0, percent=50).collect()
    assert sorted(r["rank"] or 0 for r in got) == [0, 1]
    with pytest.raises(ValueError):
        resampling.resampled(items, items, percent=101)
