import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import corpus, documents, lower

from tessera.llm import spelling


def counts(rows, shortest=7, least=2, drop=31):
    found = Counter()
    for i, x in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", x or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop and h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= shortest:
                found[w] += 1
    return {w: n for w, n in found.items() if n >= least}


def near(words):
    letters, out = sorted(set("".join(words))), {}
    for w in words:
        cut = [(w[:k], w[k:]) for k in range(len(w) + 1)]
        made = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}
        out[w] = {v for v in made if v in words and v != w}
    return out


def brute(words, ratio=10):
    form, found = {}, near(words)
    for w, others in found.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(found[w]), words.get(form[w])))
    return out


def vocabulary(seed, many=80):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("abcé"[: rng.choice([1, 2, 4])]) for _ in range(rng.randint(7, 11))) for _ in range(many)})


def variant_rows():
    """Texts in which words have variants of variants, each a tenth as frequent."""
    chain = ["orantion", "orantien", "orantienne", "orantienn", "thanedble", "ciónquel"]
    rows = [(k, " ".join([chain[0]] * 3 + [chain[4]])) for k in range(700)]
    rows += [(1000 + k, f"{chain[1]} {chain[3]} {chain[5].upper()}") for k in range(40)]
    return rows + [(2000 + k, "orantiem, thanedblE.thanedbl orantienne cíónquel") for k in range(3)] + [(None, "thanedblx thanedblx"), (None, None), (7, ""), (7, ""), (8, "x" * 3000 + " " + "x" * 2999 + " " + "x" * 3000 + " " + "x" * 2999)]


@pytest.mark.parametrize("seed", range(40))
def test_shard_finds_every_pair_once(seed):
    words = vocabulary(seed)
    n, kind = np.arange(2, 2 + len(words)), np.repeat([0, 1], len(words))
    both, twice, slices = words * 2, np.concatenate([n, n]), np.zeros(2 * len(words), dtype=np.int64)
    shard = spelling.Shard(both, twice, kind, slices)
    got = [frozenset((s.words[a], shard.of.words[b])) for s, x, y in shard.near(both, twice, kind, slices) for a, b in zip(x, y, strict=True)]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((w, v)) for w, others in near(dict.fromkeys(words, 1)).items() for v in others}


def test_slices_are_kept_apart():
    words = ["abcdefgh", "abcdefgx"]
    n, kind, slices = np.array([5, 6, 5, 6]), np.zeros(4, dtype=np.int64), np.array([0, 0, 1, 1])
    shard = spelling.Shard([words[0], words[0]], np.array([5, 5]), np.array([0, 0]), np.array([0, 1]))
    assert sum(len(x) for _, x, _ in shard.near(words * 2, n, kind, slices)) == 2
    shard = spelling.Shard([words[0]], np.array([5]), np.array([0]), np.array([1]))
    assert sum(len(x) for _, x, _ in shard.near(words * 2, n, kind, slices)) == 1
    assert not list(spelling.Shard([], n[:0], kind[:0], slices[:0]).near(words * 2, n, kind, slices))


@pytest.mark.parametrize("slice_,pairs,counted", [(1 << 14, 1 << 20, 1 << 19), (2, 3, 5)])
def test_same_as_brute_force(spark, monkeypatch, slice_, pairs, counted):
    monkeypatch.setattr(spelling, "SLICE", slice_)
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    monkeypatch.setattr(spelling, "COUNTED", counted)
    rows = variant_rows() + corpus(4) + [(3000 + k, " ".join(vocabulary(k))) for k in range(6)]
    got = spelling.variants(documents(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = list(map(tuple, got.collect()))
    assert len(got) == len(set(got)) and set(got) == brute(counts(rows))
    assert any(root != form and form is not None for _, form, root, *_ in got)


def test_other_settings(spark):
    rows = variant_rows() + [(k, x) for k, x in enumerate(vocabulary(1) * 2)]
    got = spelling.variants(documents(spark, rows), shortest=4, least=1, drop=None, ratio=2)
    assert set(map(tuple, got.collect())) == brute(counts(rows, 4, 1, None), 2)


def test_no_words(spark):
    assert spelling.variants(documents(spark, [])).count() == 0
    assert spelling.variants(documents(spark, [(1, None), (2, "a b"), (3, "elephant")])).count() == 0
    with pytest.raises(ValueError):
        spelling.near_words(documents(spark, []), shortest=3)
