"""Language identification with a string kernel.

The kernel of two texts is the number of byte n-grams (n = 1, 2, 3) that both
hold, each counted once, over the n-grams that the landmarks hold, divided by
the root of the two texts' own counts: a blended-spectrum presence kernel.  Its
Nystroem map onto the landmarks feeds one ridge regression per language against
the rest.  Everything behind the presence matrix P of a batch is linear, so the
landmark matrix, the inverse root of the landmark kernel and the ridge weights
fold into one matrix U, and a batch is scored as (P @ U) / sqrt(|P|).

A text is read whole, in blocks of BLOCK bytes with lower case and one space for
what is not a letter; its margins are the means over its blocks, weighted by
length, so a long text is compared at the landmarks' length and memory is bounded.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared, tidy

BLOCK = 4096
#: Blocks whose presence rows are in memory at once.
ROWS = 256
_GAP = re.compile(r"[\W\d_]+")
#: Languages whose counts the driver takes.
MAX_LANGUAGES = 10_000
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def normalised(text: str | None) -> bytes:
    """Lower case, one space for each run of what is not a letter, spaces at both ends; nothing if there is no letter."""
    kept = _GAP.sub(" ", text.lower()).strip() if text else ""
    if not any(map(str.isalpha, kept)):
        return b""
    return f" {kept} ".encode("utf-8", "replace")


def blocks_of(text: bytes) -> list[bytes]:
    """Nearly equal blocks of at most BLOCK bytes."""
    many = -(-len(text) // BLOCK)
    cut = [len(text) * k // many for k in range(many + 1)] if many else [0]
    return [text[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _codes(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram code below 2^24, block) for every n-gram with n = 1 to 3 inside a block; no byte of a text is 0."""
    data = np.frombuffer(b"".join(blocks), dtype=np.uint8).astype(np.int32)
    row = np.repeat(np.arange(len(blocks), dtype=np.int32), [len(b) for b in blocks])
    codes, rows = [data], [row]
    now = data
    for n in (1, 2):
        now = now[:-1] | data[n:] << 8 * n
        same = row[:-n] == row[n:]
        codes.append(now[same])
        rows.append(row[:-n][same])
    return np.concatenate(codes), np.concatenate(rows)


class KernelModel:
    """Vocabulary, folded weights U (n-grams by languages) and the languages."""

    def __init__(self, languages: list[str], vocabulary: np.ndarray, weights: np.ndarray):
        self.languages, self.vocabulary, self.weights = languages, vocabulary, weights
        self._table = None

    def __getstate__(self):
        return self.languages, self.vocabulary, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def presence(self, blocks: list[bytes]) -> np.ndarray:
        """The presence matrix of blocks over the vocabulary."""
        if self._table is None:
            self._table = np.full(1 << 24, -1, dtype=np.int32)
            self._table[self.vocabulary] = np.arange(len(self.vocabulary), dtype=np.int32)
        out = np.zeros((len(blocks), len(self.vocabulary)), dtype=np.float32)
        codes, row = _codes(blocks)
        at = self._table[codes]
        known = at >= 0
        out[row[known], at[known]] = 1
        return out

    def margins(self, blocks: list[bytes]) -> np.ndarray:
        out = np.zeros((len(blocks), len(self.languages)))
        for k in range(0, len(blocks), ROWS):
            p = self.presence(blocks[k : k + ROWS])
            out[k : k + ROWS] = (p @ self.weights) / np.sqrt(np.maximum(p.sum(axis=1), 1))[:, None]
        return out

    def classify(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of each normalised text; und and 0 for an empty one."""
        blocks = [blocks_of(t) for t in texts]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        flat = [b for some in blocks for b in some]
        owner = np.repeat(np.arange(len(texts)), [len(b) for b in blocks])
        weight = np.array([len(b) for b in flat], dtype=float)
        total = np.zeros((len(texts), len(self.languages)))
        np.add.at(total, owner, self.margins(flat) * weight[:, None] if flat else total[:0])
        total /= np.maximum(np.bincount(owner, weight, len(texts)), 1)[:, None]
        odds = np.exp(4 * (total - total.max(axis=1, keepdims=True)))
        odds /= odds.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        empty = [not t for t in texts]
        return ["und" if e else self.languages[k] for k, e in zip(best, empty, strict=True)], np.where(empty, 0.0, odds.max(axis=1))


def fit(sample: list[tuple[str, bytes]], landmarks: int = 256, ridge: float = 1e-2) -> KernelModel:
    """One-versus-rest kernel ridge regression on blocks of known language."""
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return KernelModel([], np.zeros(0, dtype=np.int64), np.zeros((0, 0), dtype=np.float32))
    label = np.array([languages.index(lang) for lang, _ in sample])
    blocks = [b for _, b in sample]
    # landmarks: the same number of each language, in the sample's order
    turn = np.zeros(len(label), dtype=int)
    for k in range(len(languages)):
        turn[label == k] = np.arange((label == k).sum())
    chosen = np.lexsort((label, turn))[:landmarks]
    marks = [blocks[k] for k in chosen]
    model = KernelModel(languages, np.unique(_codes(marks)[0]).astype(np.int64), np.zeros((0, 0), dtype=np.float32))
    basis = model.presence(marks)
    basis /= np.sqrt(np.maximum(basis.sum(axis=1, keepdims=True), 1))
    value, vector = np.linalg.eigh((basis @ basis.T).astype(float))
    keep = value > 1e-6 * value.max()
    root = (vector[:, keep] / np.sqrt(value[keep])) @ vector[:, keep].T
    gram, target = np.zeros((len(marks), len(marks))), np.zeros((len(marks), len(languages)))
    share = np.bincount(label, minlength=len(languages)).astype(float)
    for k in range(0, len(blocks), ROWS):
        p = model.presence(blocks[k : k + ROWS])
        phi = ((p @ basis.T) / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))) @ root
        own = label[k : k + ROWS]
        w = (1 / share[own])[:, None]
        gram += phi.T @ (phi * w)
        target += phi.T @ ((2.0 * (own[:, None] == np.arange(len(languages))) - 1) * w)
    weights = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), target)
    model.weights = (basis.T @ (root @ weights)).astype(np.float32)
    return model


@tidy
def _sample(batches, each):
    """Up to each blocks of a labelled document, evenly spaced."""
    for batch in batches:
        lang, out = [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            some = blocks_of(normalised(text))
            some = some if len(some) <= each else [some[len(some) * k // each] for k in range(each)]
            lang += [name] * len(some)
            out += some
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())], ["lang", "block"])


def train(labelled: DataFrame, *, documents: int = 1600, blocks: int = 3, landmarks: int = 256) -> KernelModel:
    """Fits on a sample of about `documents` rows of labelled(doc_id, text, lang), shared evenly among languages.

    Rows are drawn by the hash of doc_id where they are read; null languages are
    left out.  More than MAX_LANGUAGES languages are refused.
    """
    spark = labelled.sparkSession
    labelled = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    parts = [(r["lang"], int(min(1.0, documents / len(counts) / r["n"]) * (1 << 20))) for r in counts]
    share = F.broadcast(spark.createDataFrame(parts, "_lang string, _part long"))
    drawn = labelled.join(share, labelled["lang"] == share["_lang"]).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("_part"))
    rows = drawn.select(labelled["lang"], labelled["text"]).mapInArrow(lambda it: _sample(it, blocks), "lang string, block binary").toArrow()
    sample = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
    order = np.random.default_rng(0).permutation(len(sample))
    return fit([sample[k] for k in order], landmarks)


@tidy
def _predict(batches, model):
    model = model.value
    for batch in batches:
        names, scores = [], []
        texts = batch.column(2)
        for k in range(0, len(texts), 512):
            a, b = model.classify([normalised(t) for t in texts[k : k + 512].to_pylist()])
            names += a
            scores.append(b)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def identify(documents: DataFrame, held_out, model: KernelModel) -> DataFrame:
    """Per row of documents: doc_id, held_out (a Column), lang_pred, score.

    Null texts and texts without a letter are und with score 0.  Repeated rows
    and null ids are kept, other columns ignored; an empty table gives no rows.
    The broadcast model holds landmarks and weights alone.
    """
    params = shared(documents.sparkSession, model)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predict(it, params), SCHEMA)
