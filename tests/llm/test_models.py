import math
import pickle
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, documents, prose, words
from pyspark.sql import functions as F

from tessera.llm import context_mixing, language_id, quality, toxicity
from tessera.llm.common import remainder, text_bytes

ODD = [(9000, None), (9001, ""), (9002, "123 !!"), (9003, "é"), (9004, "x" * 50000), (None, "ka lo"), (9000, None)]


def test_kernel_is_the_presence_kernel():
    rng = random.Random(0)
    texts = [language_id.normalised(prose(rng, 30)) for _ in range(12)]
    grams = lambda t: {t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)}
    model = language_id.KernelModel(["a"], np.unique(language_id._codes(texts)[0]).astype(np.int64), np.zeros((0, 0)))
    p = model.presence(texts)
    assert (p @ p.T).tolist() == [[len(grams(a) & grams(b)) for b in texts] for a in texts]


def languages(n=300):
    rng = random.Random(1)
    out = []
    for k in range(n):
        lang = ["en", "fr", "de"][k % 3]
        syllables = {"en": ["the", "ing", "wh"], "fr": ["eau", "é", "qu"], "de": ["sch", "ung", "ü"]}[lang]
        out.append((k, " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 900))), None if k % 29 == 0 else lang))
    return out


def test_language(spark):
    rows = languages()
    df = spark.createDataFrame(rows + [(i, t, "en") for i, t in ODD], "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "_lang": F.lit("x"), "_part": F.lit("x"), "block": F.lit(1)})
    held = remainder(F.col("doc_id"), 4) == 2
    model = language_id.train(df.where(~held).where("doc_id < 9000"))
    assert model.languages == ["de", "en", "fr"]
    found = language_id.identify(df, held, model).collect()
    assert len(found) == df.count()
    true = {i: ["en", "fr", "de"][i % 3] for i, _, _ in rows}
    right = [r["lang_pred"] == true[r["doc_id"]] for r in found if r["doc_id"] in true and r["held_out"]]
    assert sum(right) >= 0.98 * len(right) > 10
    assert {r["lang_pred"] for r in found if r["doc_id"] in (9000, 9001, 9002)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in found)
    assert language_id.identify(df.where("false"), held, model).count() == 0
    none = language_id.train(df.where("false"))
    assert {r["lang_pred"] for r in language_id.identify(df, held, none).collect()} == {"und"}


def labelled(kind, n=400):
    """Half junk, or a tenth insulted."""
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        text = prose(rng, rng.randint(5, 200))
        y = int(rng.random() < (0.7 if kind == "quality" else 0.2))
        if kind == "quality" and not y:
            text = rng.choice([text.upper() + "!!", " ### ".join(text.split()), "ka " * 80])
        if kind == "toxic" and y:
            w = text.split()
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w)), rng.choice(["zounds,", "Fie!"]))
            text = " ".join(w)
        rows.append((k, text))
        if k % 5:
            labels.append((k, y))
    labels += [(1, labels[0][1]), (77777, 1), (None, 1), (2, None)]
    return rows, labels, {i: y for i, y in labels if y is not None}


@pytest.mark.parametrize(("kind", "module", "modulus", "rest"), [("quality", quality, 5, 0), ("toxic", toxicity, 3, 1)])
def test_scores(spark, kind, module, modulus, rest):
    rows, labels, true = labelled(kind)
    df = documents(spark, rows + ODD)
    table = spark.createDataFrame(labels, f"doc_id long, {kind} int").withColumn("text", F.lit("x"))
    held = remainder(F.col("doc_id"), modulus) == rest
    found = module.scored(df, table, held).collect()
    assert len(found) == df.count()
    threshold = 0.3 if kind == "quality" else 0.7
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in found)
    checked = [(r["predicted"], true[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in true]
    assert len(checked) > 50
    assert sum(a == b for a, b in checked) >= 0.95 * len(checked)
    # other labels of held-out rows change nothing
    held_ids = {r["doc_id"] for r in found if r["held_out"]}
    other = spark.createDataFrame([(i, 1 - y if i in held_ids and y is not None else y) for i, y in labels], f"doc_id long, {kind} int")
    again = {r["doc_id"]: r["score"] for r in module.scored(df, other, held).collect() if r["doc_id"] is not None}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-9) for r in found if r["doc_id"] is not None)
    assert module.scored(df.where("false"), table, held).count() == 0
    assert module.scored(df, table.where("false"), held).count() == df.count()


def test_accepted(spark):
    rows, labels, _ = labelled("quality")
    df = documents(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    held = remainder(F.col("doc_id"), 5) == 0
    kept = quality.accepted(df, table, held)
    assert kept.columns == df.columns
    want = {r["doc_id"] for r in quality.scored(df, table, held).collect() if r["predicted"]}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_discriminant_against_densities():
    rng = np.random.default_rng(0)
    size = len(quality.STATISTICS)
    x = {k: rng.normal(k, 1 + k, (500, size)) for k in (0, 1)}
    model = quality.Discriminant({k: (500.0, v.sum(axis=0), v.T @ v) for k, v in x.items()})
    point = rng.normal(0.5, 1, (5, size))
    value = []
    for mean, factor, _ in model.classes:
        cov = factor @ factor.T
        d = point - mean
        value.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    want = 1 / (1 + np.exp(-np.clip(value[1] - value[0] + model.odds, -30, 30)))
    assert model.score(point) == pytest.approx(want)


def test_block_maxima_give_the_nearest():
    rng = np.random.default_rng(1)
    v = np.where(rng.random((700, 40)) < 0.1, rng.random((700, 40)), 0).astype(np.float32)
    v = v[v.any(axis=1)]
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    index = toxicity.ExampleIndex(np.arange(len(v)), v, rng.integers(0, 2, len(v)), np.ones(len(v)), np.ones(40), 0.1, 9)
    q = np.concatenate([v[:50], np.zeros((1, 40), np.float32)])
    _, cosine = index.nearest(q, 9)
    want = -np.sort(-(q @ v.T), axis=1)[:, :9]
    assert cosine == pytest.approx(want, abs=1e-5)
    rows = toxicity.Rows.of(v)
    labels = rng.integers(0, 2, len(v))
    index = toxicity.ExampleIndex(np.arange(len(v)), rows, labels, np.ones(len(v)), np.ones(40), 0.1, 9)
    packed = pickle.loads(pickle.dumps(toxicity.Examples(np.arange(len(v)) + 500, rows, labels, np.ones(len(v)), np.ones(40), 0.1, 9)))
    assert (packed.index.nearest(q, 9)[1] == index.nearest(q, 9)[1]).all()
    assert (packed.rows.at == rows.at).all()
    # votes without the example itself
    cosine = v @ v.T
    np.fill_diagonal(cosine, -1)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(v)))], ["id"])
    x = next(toxicity._own_votes(iter([batch]), type("B", (), {"value": packed}))).column(1).to_numpy()
    for k in (0, 7, 99):
        top = np.argsort(-cosine[k], kind="stable")[:9]
        w = np.square(np.maximum(cosine[k][top], 0))
        one, zero = (w * labels[top]).sum() + 0.02 * 0.1, (w * (1 - labels[top])).sum() + 0.02 * 0.9
        assert x[k] == pytest.approx(np.log(one / zero), abs=1e-3)


def test_every_term_counts_in_toxicity(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, prose(rng, 30)) for k in range(120)]
    rows[1] = (1, rows[1][1] + " varlet")  # a word of one example alone
    rows[119] = (119, "Varlet " + " ".join(f"{a}{b}" for a in "wxyz" for b in "ghjk"))
    truth = {k: int(k % 10 == 1) for k in range(110)}
    df, held = documents(spark, rows), F.col("doc_id") >= 110
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")

    def terms(text):
        w = re.findall("[a-z]+", text.lower())
        return Counter([*w, *((n, x[:n]) for x in w for n in toxicity.PREFIXES if len(x) > n)])

    of = {k: terms(t) for k, t in rows}
    n = Counter(t for c in of.values() for t in c)
    one = sum(truth.values())

    def weight(t, f):
        a, b = (sum(t in of[k] for k, y in truth.items() if y == label) for label in (1, 0))
        chi2 = len(truth) * (a * (len(truth) - one) - b * one) ** 2 / max(1e-9, one * (len(truth) - one) * (a + b) * (len(truth) - a - b))
        return (1 + math.log(f)) * (math.log((1 + len(rows)) / (1 + n[t])) + 1) * math.sqrt(1 + chi2 / toxicity.CHI2)

    vector = {k: {t: weight(t, f) for t, f in c.items()} for k, c in of.items()}
    cosine = lambda x, y: sum(v * y.get(t, 0) for t, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    for most in (1 << 21, 1):  # all other terms broadcast; nearly all joined
        monkeypatch.setattr(toxicity, "MAX_TERMS", most)
        found = {r["doc_id"]: r for r in toxicity.scored(df, labels, held).collect()}
        assert found[119]["neighbours"][0] == 1
        for k in (0, 1, 115, 119):
            want = sorted((cosine(vector[k], vector[e]) for e in truth), reverse=True)
            assert found[k]["cosines"] == pytest.approx([w for w in want[:5] if w > 0], abs=1e-5)


def test_unigram_of_context_mixing(spark, monkeypatch):
    rows = [r for r in corpus(3) if r[0] is not None]
    df = documents(spark, rows)
    held = remainder(F.col("doc_id"), 5) == 1
    expect = scores = None
    monkeypatch.setattr(context_mixing, "TREE_WORDS", 6)
    for most in (1 << 20, 40, 7):  # all words broadcast; some joined; nearly all joined
        monkeypatch.setattr(context_mixing, "MAX_WORDS", most)
        found = sorted(map(tuple, context_mixing.scored(df, held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()))
        if expect is None:
            flags = {r[0]: r[1] for r in found}
            seen = [w for i, t in rows if not flags[i] for w in [*words(t), None]]
            count = {w: seen.count(w) for w in set(seen)}
            below = len(seen) + 0.5 * (len(count) + 1)
            expect = []
            for i, t in rows:
                w = [*words(t), None]
                expect.append((i, flags[i], len(w), sum(x in count for x in w), len(seen), sum(math.log10((count.get(x, 0) + 0.5) / below) for x in w)))
            expect.sort()
        assert [r[:5] for r in found] == [r[:5] for r in expect]
        assert [r[5] for r in found] == pytest.approx([r[5] for r in expect])
        assert all(r[6] < 0 for r in found)
        scores = scores or [r[6] for r in found]
        assert [r[6] for r in found] == pytest.approx(scores)
    assert context_mixing.scored(df.where("false"), held).count() == 0
    assert context_mixing.scored(df, F.lit(True)).count() == df.count()


def model(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return context_mixing.trained(df, df)


def sequence(mixer, texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    words = context_mixing.split(data, offsets)
    return words, mixer.vocabulary.sequence(words, len(texts), np.ones(len(texts), dtype=bool))


def one_by_one(mixer, text):
    """The mix bit by bit in plain Python, for a text of one lane: its contexts, too, are found word by word."""
    C, v = context_mixing, mixer.vocabulary
    known = dict(zip(v.names.tolist(), v.symbol.tolist(), strict=True))
    hashed = lambda x: int(C.mix(np.array([x], dtype=np.uint64))[0] % np.uint64(C.CONTEXTS - 1))
    said, tails = [], []
    for w in words(text):
        raw = np.frombuffer(w.encode(), dtype=np.uint8)
        lowered, start, end, _, name = C.split(raw, np.array([0, len(raw)]))
        said.append(known.get(int(name[0]), v.words + int(C.class_of(lowered, start, end)[0])))
        tails.append(((raw[-1], raw[-2] if len(raw) > 1 else 0)))
    weights, cells = mixer.start.astype(float).copy(), [1 / (1 + math.exp(-((c + 0.5) / C.CELLS * 16 - 8))) for c in range(C.CELLS)]
    follow, total = Counter(), 0.0
    for k, symbol in enumerate([*said, v.symbols - 1]):
        often = [x for x in said[:k] if x < min(C.OWN, v.words)]
        context = [C.CONTEXTS - 1] * 2
        if often:
            context[0] = often[-1]
        if k:
            last = int(tails[k - 1][0]) << 8 | int(tails[k - 1][1])
            context[1] = hashed(last << 8 | (int(tails[k - 2][0]) if k > 1 else 0))
        for d in range(mixer.tree.length[symbol]):
            node, y = mixer.tree.node[symbol, d], int(mixer.tree.bit[symbol, d])
            gate = min(d // 3, 3) * 2 + int(k > 0 and said[k - 1] < min(C.OWN, v.words))
            slot = min(node, C.FOLLOWED - 1)
            x = [mixer.overall[node] / C.STEPS, *(mixer.odds[c, context[c], node] / C.STEPS for c in range(2)), follow[slot]]
            dot = max(-7.99, min(7.99, sum(a * b for a, b in zip(x, weights[gate], strict=True))))
            p, cell = 1 / (1 + math.exp(-dot)), int((dot + 8) * C.CELLS / 16)
            final = (0.7 * p + 0.3 * cells[cell]) * 0.9998 + 0.0001
            total += math.log(final if y else 1 - final)
            for c in range(4):
                weights[gate, c] += C.RATE * (y - p) * x[c]
            cells[cell] += C.REFINE * (y - cells[cell])
            follow[slot] += C.FOLLOW * (y - p)
    return total


def test_mix_bit_by_bit(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "TREE_WORDS", 60)
    monkeypatch.setattr(context_mixing, "OWN", 9)
    monkeypatch.setattr(context_mixing, "FOLLOWED", 40)
    rng = random.Random(5)
    mixer, counts, _, _ = model(spark, [prose(rng, 200) for _ in range(20)])
    texts = [prose(rng, 40), "", "Xyz é 123", prose(rng, 30)]
    _, (symbol, row, context, place, just) = sequence(mixer, texts)
    found = mixer.score(symbol, row, context, just, len(texts))
    assert found == pytest.approx([one_by_one(mixer, t) for t in texts], rel=1e-4)
    assert len(place) == sum(len(words(t)) for t in texts)
    # every step is a probability: all first words, all words of a class, all letters together
    every = np.arange(mixer.vocabulary.symbols)
    contexts = np.full((2, len(every)), context_mixing.CONTEXTS - 1)
    first = mixer.score(every, every, contexts, np.zeros(len(every), dtype=np.int8), len(every))
    assert np.exp(first).sum() == pytest.approx(1, abs=1e-3)
    assert context_mixing.CLASSES + 61 == len(every)
    assert 0 < counts.novel < 1
    one = mixer.byte_tree.length[np.arange(256)]
    known = np.zeros((256, 5), dtype=np.int64) + np.array([[97], *([[0]] * 4)]).T
    _, bit, of = mixer._byte_inputs(np.arange(256), np.arange(256), known.T)
    odds = (mixer._byte_inputs(np.arange(256), np.arange(256), known.T)[0] / context_mixing.STEPS) @ mixer.byte_start
    p = 1 / (1 + np.exp(-odds))
    assert np.exp(np.bincount(of, np.log(np.where(bit > 0, p, 1 - p)))).sum() == pytest.approx(1, abs=1e-3)
    assert len(bit) == one.sum()


def test_words_of_a_class_share_it(spark, monkeypatch):
    """The classes hold what is no leaf; on words drawn without any order, where the unigram is all there is to know, the mix costs little more."""
    monkeypatch.setattr(context_mixing, "TREE_WORDS", 30)
    rng = random.Random(8)
    rows = [(k, prose(rng, 150)) for k in range(300)]
    mixer, counts, kept, _ = model(spark, [t for _, t in rows])
    assert counts.counts.sum() == sum(r["n"] for r in kept.collect())
    assert counts.classes[counts.classes > 1].sum() == pytest.approx(np.sort(counts.counts)[::-1][30:].sum())
    assert mixer.vocabulary.words == 30
    found = context_mixing.scored(documents(spark, rows), F.col("doc_id") % 3 == 1).where("held_out").collect()
    assert sum(r["score"] for r in found) > 1.1 * sum(r["base_score"] for r in found)
    assert all(0 < r["bits_per_byte"] < 8 for r in found)


def test_a_long_text_is_the_sum_of_its_pieces(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "AT_ONCE", 5000)
    rng = random.Random(9)
    texts = [prose(rng, 6000), "y" * 40_000, "short one", None, "z" * 3000 + " " + prose(rng, 3000)]
    seen = [[] for _ in texts]
    for low, rows, data, offsets, row, closes in context_mixing.parts_of(pa.array(texts)):
        assert len(data) <= 10_000 or "y" in bytes(data).decode()
        for k, r in enumerate(row.tolist()):
            seen[low + r].append((bytes(data[offsets[k] : offsets[k + 1]]).decode(), bool(closes[k])))
        assert rows == len(closes)
    assert ["".join(t for t, _ in x) for x in seen] == [t or "" for t in texts]
    assert all([c for _, c in x] == [False] * (len(x) - 1) + [True] for x in seen)
    assert [w for x in seen for t, _ in x for w in words(t)] == [w for t in texts for w in words(t)]
    df = documents(spark, list(enumerate(texts)))
    found = {r["doc_id"]: r for r in context_mixing.scored(df, F.lit(False)).collect()}
    assert [found[k]["n_tokens"] for k in range(5)] == [len(words(t)) + 1 for t in texts]
    assert found[0]["score"] > found[0]["n_tokens"] * -6


def test_first_weights_come_from_all_training_texts(spark, monkeypatch):
    """Every bit of every training text is counted, the end of a long one too; the weights are those of the plain regression, up to levels."""
    C = context_mixing
    monkeypatch.setattr(C, "TREE_WORDS", 60)
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 12)) for _ in range(700)] + [prose(rng, 14_000), None, ""]
    df, seen, trained, fit = documents(spark, list(enumerate(texts))), [], C.trained, C.Mixer.fit
    measure = lambda df: df.agg(F.count("*"), F.sum(F.length("text"))).first()
    monkeypatch.setattr(C, "trained", lambda texts, fit: seen.append((measure(texts), measure(fit))) or trained(texts, fit))
    C.scored(df, F.lit(False))
    assert seen[0][0] == seen[0][1] == (len(texts), sum(len(t or "") for t in texts))
    mixers = []
    monkeypatch.setattr(C.Mixer, "fit", lambda self, fit_: mixers.append(self))
    mixer = model(spark, texts)[0]
    assert mixers == [mixer]
    given = type("Given", (), {"value": mixer})
    rows = [r for b in C._levels(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]), given) for r in b.to_pylist()]
    held = {r["context"]: dict(zip(np.frombuffer(r["symbols"], "<u2").tolist(), np.frombuffer(r["n"], "<u8").tolist(), strict=True)) for r in rows}
    words_, (symbol, _, context, place, just) = sequence(mixer, texts)
    known, bit, gate, _ = mixer._inputs(context, just, *mixer._paths(symbol, mixer.tree.length[symbol]))
    expect, first = Counter(), C.GATES * C.LEVELS
    for x, y, g in zip(known.tolist(), bit.tolist(), gate.tolist(), strict=True):
        a, b, c = (round(v / C.LEVEL) + C.LEVELS // 2 for v in x)
        expect[g * C.LEVELS + a, (b * C.LEVELS + c) * 2 + y] += 1
    assert expect == {(c, k): n for c, x in held.items() if c < first for k, n in x.items()}
    rare = np.flatnonzero(symbol[place] >= mixer.vocabulary.words)
    letter, of, by = C.letters(words_[0], words_[1][rare], words_[2][rare])
    expect = Counter()
    for x, y in zip(*(v.tolist() for v in mixer._byte_inputs(letter, of, by)[:2]), strict=True):
        a, b, c, d, e = (round(v / C.BYTE_LEVEL) + C.BYTE_LEVELS // 2 for v in x)
        expect[first + a * C.BYTE_LEVELS + b, ((c * C.BYTE_LEVELS + d) * C.BYTE_LEVELS + e) * 2 + y] += 1
    assert expect == {(c, k): n for c, x in held.items() if c >= first for k, n in x.items()}
    prior, known = mixer.start[:, :-1].copy(), known / C.STEPS
    plain = [C.regression(known[gate == g], bit[gate == g].astype(float), np.ones((gate == g).sum()), prior[g]) for g in range(C.GATES)]
    fit(mixer, spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    cost = lambda w: sum(np.log1p(np.exp(-(2.0 * bit[gate == g] - 1) * (known[gate == g] @ w[g]))).sum() for g in range(C.GATES))
    assert cost(plain) <= cost(mixer.start[:, :-1]) + 1e-6 < 1.002 * cost(plain) < cost(prior)


def test_chunks_are_mixed_together(spark, monkeypatch):
    """The lanes of several chunks take their steps in one run, with the scores of each chunk by itself; a text in pieces and a chunk of more bits too."""
    C = context_mixing
    monkeypatch.setattr(C, "TREE_WORDS", 60)
    monkeypatch.setattr(C, "AT_ONCE", 3000)
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(60)] + [prose(rng, 4000), None, "", "y" * 9000] + [prose(rng, 40)]
    mixer, counts, _, _ = model(spark, texts)
    monkeypatch.setattr(C, "TaskContext", type("Context", (), {"get": classmethod(lambda cls: cls()), "partitionId": lambda self: 3}))
    given, table = (type("Given", (), {"value": v}) for v in (mixer, counts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts, pa.string())], ["doc_id", "held_out", "text"])
    runs, mix_ = [], C.Mixer._mix
    monkeypatch.setattr(C.Mixer, "_mix", lambda self, *given: runs.append(1) or mix_(self, *given))
    score = lambda: [r for b in C._score(iter([batch]), given, table) for r in b.to_pylist()]
    together = score()
    assert len(runs) == 1 < len(list(C.parts_of(batch.column(2))))
    for most in (1, 20_000):
        runs.clear()
        monkeypatch.setattr(C, "MIXED", most)
        found = score()
        assert len(runs) > 1
        assert [{**r, "score": None} for r in found] == [{**r, "score": None} for r in together]
        assert [r["score"] for r in found] == pytest.approx([r["score"] for r in together], rel=1e-5)
    assert [r["row"] for r in together] == [(3 << 40) + k for k in range(len(texts))]


def test_what_begins_alike_is_spelled_once(spark, monkeypatch):
    """Bytes of words that begin alike are looked up once, with the counts of all; words of one to many bytes, one in another."""
    C = context_mixing
    rng = random.Random(17)
    said = ["a", "ab", "a\x00", "abc", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "b", "é", "éa", "x" * 30, "x" * 31]
    said += ["inter" + "".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(200)] + ["".join(rng.choices("ab\x00", k=rng.randint(1, 4))) for _ in range(60)]
    rare, every, kept = C.Rare(), Counter(), Counter()
    for part in (said[:100], said[50:], said):
        data, offsets = text_bytes(pa.array([" ".join(part)]))
        found = C.split(data, offsets)
        rare.add(found, np.arange(len(found[1])))
        symbol, _, of = C.letters(found[0], found[1], found[2])
        every.update(zip(symbol.tolist(), *of.tolist(), strict=True))
        assert not rare.full()
    looked = 0
    for symbol, often, of in rare.taken():
        looked += len(symbol)
        for n, *key in zip(often.tolist(), symbol.tolist(), *of.tolist(), strict=True):
            kept[tuple(key)] += n
    assert kept == every
    assert looked < sum(len(w.encode()) + 1 for w in set(said)) / 2
    assert list(rare.taken()) == []


def test_distinct_words_by_sorted_values():
    C = context_mixing
    rng = np.random.default_rng(3)
    for low in (0, 1 << 40):  # names that differ in their last bits alone; names far apart
        name = rng.integers(low, low + 90 if not low else 1 << 63, 60, dtype=np.uint64)[rng.integers(0, 60, 500)]
        kind = (C.mix(name) % np.uint64(C.CLASSES)).astype(np.int64)
        expect = Counter(zip(name.tolist(), kind.tolist(), strict=True))
        assert dict(zip(zip(*(x.tolist() for x in C._counted(name, kind)[:2]), strict=True), C._counted(name, kind)[2].tolist(), strict=True)) == expect
    assert [len(x) for x in C._counted(name[:0], kind[:0])] == [0, 0, 0]
