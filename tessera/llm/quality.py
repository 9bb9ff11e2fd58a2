"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

A document becomes the transformed statistics of its whole text (STATISTICS).
Each class has a mean and a covariance shrunk towards the pooled covariance and
its diagonal; the score is the logistic function of the difference of the two
log densities, from Mahalanobis distances under Cholesky factors computed once
when the model is fitted.  The moments are sums over all labelled training rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, hash_spans, hashed_words, shared, spans, stored, tidy

# byte classes
_LOWER, _UPPER, _DIGIT, _BLANK, _LINE, _STOP, _COMMA, _LOUD, _BAR, _SIGN, _PUNCT, _HIGH, _CONTROL = range(13)
_CLASS = np.full(256, _PUNCT, dtype=np.int64)
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", _LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("0123456789", _DIGIT), (" \t", _BLANK), ("\n\r", _LINE), (".", _STOP), (",", _COMMA), ("!?", _LOUD), ("|", _BAR), ("#$%&*@^~_=+<>{}[]\\/", _SIGN)):
    _CLASS[[ord(c) for c in _chars]] = _kind
_CLASS[128:] = _HIGH
_CLASS[[*range(9), 11, 12, *range(14, 32), 127]] = _CONTROL

STATISTICS = ["length", "upper", "digit", "line", "stop", "comma", "loud", "bar", "sign", "punct", "high", "control", "word_length", "distinct", "repeated", "distinct_lines", "top_word"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATISTICS of each row: logarithms of rates, with a floor; an empty text has the floors."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(rows), size)
    count = np.bincount(row * 13 + _CLASS[data], minlength=rows * 13).reshape(rows, 13).astype(float)
    word, at = hashed_words(data, offsets)
    words = np.bincount(at, minlength=rows).astype(float)
    pair = np.argsort(word + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
    key = word[pair] + at[pair].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=int)
    owner, many = at[pair][first], np.diff(np.append(first, len(key)))
    distinct = np.bincount(owner, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, owner, many)
    again = (word[1:] == word[:-1]) & (at[1:] == at[:-1])
    repeated = np.bincount(at[1:][again], minlength=rows)
    start, end, line_row = spans(data, offsets, (data != 10) & (data != 13))
    line = hash_spans(data, start, end) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lines = np.bincount(line_row, minlength=rows)
    by_line = np.argsort(line)
    fresh = np.concatenate([[True], line[by_line][1:] != line[by_line][:-1]]) if len(line) else np.zeros(0, dtype=bool)
    distinct_lines = np.bincount(line_row[by_line][fresh], minlength=rows)
    rate = lambda x, of, floor=2e-3: np.log(floor + x / np.maximum(of, 1))
    kinds = (_UPPER, _DIGIT, _LINE, _STOP, _COMMA, _LOUD, _BAR, _SIGN, _PUNCT, _HIGH, _CONTROL)
    return np.stack(
        [
            np.log1p(size),
            *(rate(count[:, k], size) for k in kinds),
            np.log1p((size - count[:, _BLANK] - count[:, _LINE]) / np.maximum(words, 1)),
            np.log((1 + distinct) / (1 + words)) / np.log(2 + words),
            rate(repeated, words, 1e-2),
            rate(distinct_lines, lines, 0.1),
            rate(top, words, 1e-2),
        ],
        axis=1,
    )


@tidy
def _measure(batches):
    for batch in batches:
        out = [statistics(data, offsets) for _, data, offsets in chunks(batch.column(1))]
        out = np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, k]) for k in range(len(STATISTICS)))], ["doc_id", *STATISTICS])


def measured(documents: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS of every row's whole text; null text counts as empty."""
    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, schema)


class Discriminant:
    """Means, Cholesky factors and log determinants of the two classes, and the log odds of their shares."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.2, diagonal: float = 0.1):
        size = len(STATISTICS)
        counts = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
        self.odds = float(np.log((counts[1] + 0.5) / (counts[0] + 0.5)))
        self.classes = []
        if min(counts.values()) < 2:
            return
        means, spread = {}, {}
        for k in (0, 1):
            n, total, squares = moments[k]
            means[k] = total / n
            spread[k] = squares / n - np.outer(means[k], means[k])
        pooled = (counts[0] * spread[0] + counts[1] * spread[1]) / sum(counts.values())
        for k in (0, 1):
            part = min(1.0, shrink + size / (counts[k] + size))
            cov = (1 - part) * spread[k] + part * pooled
            cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-3 * np.eye(size)
            factor = np.linalg.cholesky(cov)
            self.classes.append((means[k], factor, 2 * np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; the share of class 1 if a class was too rare to fit."""
        value = np.full(len(x), self.odds)
        for sign, (mean, factor, log_det) in zip((-1, 1), self.classes, strict=False):
            z = np.linalg.solve(factor, (x - mean).T)
            value += sign * -0.5 * ((z * z).sum(axis=0) + log_det)
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def fit(observed: DataFrame) -> Discriminant:
    """From rows (label, STATISTICS): the class moments over all rows, summed where the rows are."""
    size = len(STATISTICS)
    pairs = [(a, b) for a in range(size) for b in range(a, size)]
    sums = [F.sum(STATISTICS[a]) for a in range(size)] + [F.sum(F.col(STATISTICS[a]) * F.col(STATISTICS[b])) for a, b in pairs]
    rows = observed.where("label in (0, 1)").groupBy("label").agg(F.count("*"), *sums).collect()
    moments = {}
    for row in rows:
        squares = np.zeros((size, size))
        for (a, b), v in zip(pairs, row[2 + size :], strict=True):
            squares[a, b] = squares[b, a] = v
        moments[int(row[0])] = (float(row[1]), np.array(row[2 : 2 + size]), squares)
    return Discriminant(moments)


@tidy
def _score(batches, model, threshold):
    model = model.value
    for batch in batches:
        x = np.stack([batch.column(k).to_numpy() for k in range(2, batch.num_columns)], axis=1)
        score = model.score(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def scored(documents: DataFrame, labels: DataFrame, held_out: Column, *, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Per row of documents: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    held_out is a boolean Column over doc_id; labels of such rows are not
    learned.  A document with several labels counts once for each; null labels
    and labels other than 0 and 1 count for nothing.  Null and empty texts have
    a score like any text.  Repeated rows and null ids are kept, other columns
    ignored; an empty table gives no rows.  With fewer than two labelled rows of
    a class every score is the share of class 1.
    """
    spark = documents.sparkSession
    features = stored(measured(documents), "statistics").withColumn("held_out", held_out)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label is not null")
    model = shared(spark, fit(features.where("not held_out").join(known, "doc_id")))
    return features.select("doc_id", "held_out", *STATISTICS).mapInArrow(lambda it: _score(it, model, threshold), "doc_id long, held_out boolean, score double, predicted int")


@tidy
def _accept(batches, model, threshold, at):
    model = model.value
    for batch in batches:
        keep = [model.score(statistics(data, offsets)) >= threshold for _, data, offsets in chunks(batch.column(at))]
        yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, dtype=bool)))


def accepted(documents: DataFrame, labels: DataFrame, held_out: Column, *, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """documents without the rows that scored() predicts as 0; columns stay as they are.

    Rows are judged where they are read, so no text is moved.
    """
    text = F.col("text").cast("string").alias("text")
    learnt = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text).where(~held_out)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label is not null")
    model = shared(documents.sparkSession, fit(measured(learnt).join(known, "doc_id")))
    at = documents.columns.index("text")
    return documents.mapInArrow(lambda it: _accept(it, model, threshold, at), documents.schema)
