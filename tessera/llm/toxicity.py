"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are runs of letters, A-Z lower-cased, and the first PREFIXES bytes of longer
ones, which stand for stems.  Every term of a text counts, in its vector and in
the vector's length: (1 + ln tf) * idf, and for terms that examples hold this is
raised by a factor that grows with chi-squared between term and label, so a cosine
says more about the label than about function words.  Document frequencies are
sums over all documents.

The index holds every sampled example with all its terms, in blocks of BLOCK
examples with one label as far as can be.  The weights of the COMMON
terms are a matrix with the largest weight of each term in each block, those of
each other term are a posting list.  A query first takes its posting lists; what
they give, at most in a block, and its products with the block's maxima bound what
an example of the block can reach.  The blocks of the SEEDS largest bounds are
scored first; then all blocks whose bound is not below the k-th cosine found, so
the k nearest are exact.  Terms that no example holds add to the length of a query
alone; the frequencies of the most frequent of them are broadcast, the others are
joined.  Neighbours vote with the square of their cosine, weighted back from the
sampling of their class; a logistic curve fitted on the examples' leave-one-out
votes calibrates the vote.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _LOWER, chunks, give_back, hash_spans, mix, shared, spans, stored, tidy

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Lengths in bytes of the beginnings of words that are terms themselves.
PREFIXES = (5, 6, 7)
#: Terms of the most examples, whose weights are held as a matrix; the others' are lists of examples.
COMMON = 512
#: Examples of a block; blocks that are scored first.
BLOCK, SEEDS = 64, 8
#: Bytes of text, postings, and queries of a search that are in memory at once.
AT_ONCE = 2 << 20
POSTINGS = 1 << 19
ROWS = 128
#: Terms that no example holds, whose frequencies are broadcast; rarer ones are joined.
MAX_TERMS = 1 << 21
#: Distinct terms that a task gathers before it gives rows.
GATHERED = 1 << 21
#: The chi-squared from which a term's weight is raised.
CHI2 = 10.0


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct terms, row, place among the terms, tf) of the terms of each row, by row and place.

    Words are counted first; beginnings are taken from distinct words alone.
    """
    lowered = _LOWER[data]
    start, end, row = spans(lowered, offsets, _LETTER[lowered])
    word, first, place = np.unique(hash_spans(lowered, start, end), return_index=True, return_inverse=True)
    start, end = start[first], end[first]
    every, owner = [word], [np.arange(len(word))]
    for size in PREFIXES:
        long = np.flatnonzero(end - start > size)
        every.append(mix(hash_spans(lowered, start[long], start[long] + size) + np.uint64(size)))
        owner.append(long)
    names, at = np.unique(np.concatenate(every), return_inverse=True)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    at, cut = at[order], np.searchsorted(owner[order], np.arange(len(word) + 1))
    # row, word and how often, then row, term and how often, each sorted as one number
    key, tf = _tallied(row * (len(word) + 1) + place, np.ones(len(row), dtype=np.int64))
    row, place = np.divmod(key, len(word) + 1)
    entry, _ = _ranges(cut[place], cut[place + 1])
    many = cut[place + 1] - cut[place]
    key, tf = _tallied(np.repeat(row, many) * (len(names) + 1) + at[entry], np.repeat(tf, many))
    return names, *np.divmod(key, len(names) + 1), tf


def _tallied(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, sums of n); key and n are sorted as one number where they fit."""
    if not len(key):
        return key, n
    bits = int(n.max()).bit_length()
    if int(key.max()).bit_length() + bits < 63:
        both = np.sort(key << bits | n)
        key, n = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[start], np.add.reduceat(n, start)


def _counted(batch, column: int):
    """(first row, distinct terms, where each row's entries begin, place among the terms, tf) of chunk after chunk."""
    for low, data, offsets in chunks(batch.column(column), AT_ONCE):
        names, row, place, tf = terms(data, offsets)
        yield low, names, np.searchsorted(row, np.arange(len(offsets))), place, tf


@tidy
def _frequencies(batches, known):
    """(term, n, a, b): the documents that hold a term, and the sampled ones among them of label 1 and 0."""
    known = known.value
    held, size = [], 0
    for batch in batches:
        label = np.array([known.get(i, -1) for i in batch.column(0).to_pylist()], dtype=np.int64)
        for low, names, cut, place, _ in _counted(batch, 1):
            of = np.repeat(label[low : low + len(cut) - 1], np.diff(cut))
            held.append((names, np.stack([np.bincount(x, minlength=len(names)) for x in (place, place[of == 1], place[of == 0])])))
            size += len(names)
            if size > GATHERED:
                held = [_summed(held)]
                if 2 * len(held[0][0]) > GATHERED:
                    yield _frequency_rows(*held.pop())
                size = sum(len(n) for n, _ in held)
    if held:
        yield _frequency_rows(*_summed(held))


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    names, place = np.unique(np.concatenate([n for n, _ in parts]), return_inverse=True)
    counts = np.concatenate([c for _, c in parts], axis=1)
    return names, np.stack([np.bincount(place, c, len(names)).astype(np.int64) for c in counts])


def _frequency_rows(names, counts):
    return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *(pa.array(c, pa.int64()) for c in counts)], ["term", "n", "a", "b"])


@tidy
def _sampled(batches, known, table):
    """(doc_id, hash, at, tf): the terms of the sampled documents by their numbers, and their counts."""
    known, (names, at_of, *_) = known.value, table.value
    for batch in batches:
        batch = batch.filter(pa.array([i in known for i in batch.column(0).to_pylist()], pa.bool_()))
        for low, term, cut, place, tf in _counted(batch, 1):
            at = at_of[np.searchsorted(names, term)][place] if len(term) else np.zeros(0, dtype=np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int32())) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k)[low : low + len(cut) - 1] for k in (0, 2)), *lists], ["doc_id", "hash", "at", "tf"])


class Rows:
    """Sparse rows: entries cut[k] to cut[k + 1] are row k's terms and their weights."""

    def __init__(self, cut: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.cut, self.at, self.value = cut, at, value

    @classmethod
    def of(cls, dense: np.ndarray) -> Rows:
        row, at = np.nonzero(dense)
        return cls(np.searchsorted(row, np.arange(len(dense) + 1)), at, dense[row, at].astype(np.float32))

    def __len__(self) -> int:
        return len(self.cut) - 1

    def take(self, rows: np.ndarray) -> Rows:
        entry, cut = _ranges(self.cut[rows], self.cut[rows + 1])
        return Rows(cut, self.at[entry], self.value[entry])


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after another, and where each begins."""
    size = end - start
    cut = np.concatenate([[0], np.cumsum(size)])
    return np.arange(cut[-1]) + np.repeat(start - cut[:-1], size), cut


class ExampleIndex:
    """Labelled examples by term; k nearest by cosine; calibrated votes."""

    def __init__(self, ids, vectors: Rows | np.ndarray, labels: np.ndarray, weights: np.ndarray, idf: np.ndarray, empty: float, k: int, curve: tuple[float, float] | None = None):
        vectors = vectors if isinstance(vectors, Rows) else Rows.of(vectors)
        self.idf, self.empty, self.k, self.curve = idf, empty, k, curve
        common = np.argsort(-np.bincount(vectors.at, minlength=len(idf)), kind="stable")[:COMMON]
        self.column = np.full(len(idf), -1, dtype=np.int32)
        self.column[common] = np.arange(len(common))
        self.ids, self.labels, self.weights = np.asarray(ids), labels, weights
        self.dense = np.zeros((len(vectors), len(common)), dtype=np.float32)
        held: list[tuple] = []
        for low in range(0, len(vectors), 1024):  # as arrays of all entries would be large
            part = slice(vectors.cut[low], vectors.cut[min(low + 1024, len(vectors))])
            row = np.repeat(np.arange(low, min(low + 1024, len(vectors)), dtype=np.int32), np.diff(vectors.cut[low : low + 1025]))
            at, value = vectors.at[part], vectors.value[part]
            column = self.column[at]
            self.dense[row[column >= 0], column[column >= 0]] = value[column >= 0]
            # a posting is one number: the example above the bits of its weight
            held.append((at[column < 0].astype(np.int32), row[column < 0].astype(np.int64) << 32 | value[column < 0].view(np.uint32)))
        self.blocks = -(-len(vectors) // BLOCK)
        self.dense_most = np.maximum.reduceat(self.dense, np.arange(0, len(vectors), BLOCK)) if len(vectors) else self.dense
        term = np.concatenate([np.zeros(0, dtype=np.int32), *(h[0] for h in held)])
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(idf)))])
        order = np.argsort(term, kind="stable").astype(np.int32)
        del term
        postings = [np.zeros(0, dtype=np.int64), *(h[1] for h in held)]
        del held
        joined = np.concatenate(postings)
        del postings
        self.posting = joined[order]
        if curve is None:
            self.curve = curve_of(self.own_votes(vectors), self.labels, self.weights)

    def _common_of(self, vectors: Rows) -> np.ndarray:
        row, column = np.repeat(np.arange(len(vectors)), np.diff(vectors.cut)), self.column[vectors.at]
        out = np.zeros((len(vectors), min(COMMON, len(self.idf))), dtype=np.float32)
        out[row[column >= 0], column[column >= 0]] = vectors.value[column >= 0]
        return out

    def nearest(self, vectors: Rows | np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k nearest of each row; cosine 0 stands for no neighbour."""
        vectors = vectors if isinstance(vectors, Rows) else Rows.of(vectors)
        where, cosine = np.zeros((len(vectors), k), dtype=np.int64), np.zeros((len(vectors), k), dtype=np.float32)
        examples = len(self.ids)
        if not examples:
            return where, cosine
        for low in range(0, len(vectors), ROWS):
            high = min(low + ROWS, len(vectors))
            found = self._scored(vectors.take(np.arange(low, high)), k)
            top = np.argpartition(-found, min(k, examples) - 1, axis=1)[:, :k]
            found = np.take_along_axis(found, top, axis=1)
            order = np.lexsort((top, -found), axis=1)
            where[low:high, : top.shape[1]] = np.take_along_axis(top, order, axis=1)
            cosine[low:high, : top.shape[1]] = np.maximum(np.take_along_axis(found, order, axis=1), 0)
        return where, cosine

    def _listed(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """What the posting lists of some terms give each example; as many lists at once as POSTINGS allows."""
        out = np.zeros(len(self.ids))
        begin, end = self.begin[at], self.begin[at + 1]
        reach, low = np.concatenate([[0], np.cumsum(end - begin)]), 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(reach, reach[low] + POSTINGS, "right")) - 1)
            found = np.concatenate([self.posting[x] for x in map(slice, begin[low:high].tolist(), end[low:high].tolist())])
            given = np.repeat(value[low:high], end[low:high] - begin[low:high])
            given *= found.view(np.float32)[::2]
            found >>= 32
            out += np.bincount(found, given.astype(np.float64), len(out))
            low = high
        return out

    def _scored(self, some: Rows, k: int) -> np.ndarray:
        """Cosines of rows by examples; -1 in blocks that cannot hold one of the k nearest."""
        rows, examples = len(some), len(self.ids)
        q = self._common_of(some)
        rare = np.flatnonzero(self.column[some.at] < 0)
        cut = np.searchsorted(rare, some.cut).tolist()
        listed = np.empty((rows, examples), dtype=np.float32)
        for r in range(rows):
            own = rare[cut[r] : cut[r + 1]]
            listed[r] = self._listed(some.at[own], some.value[own])
        bound = q @ self.dense_most.T + np.maximum.reduceat(listed, np.arange(0, examples, BLOCK), axis=1)
        out = np.full((rows, examples), -1, dtype=np.float32)
        seeds = min(SEEDS, self.blocks)
        first = np.zeros((rows, self.blocks), dtype=bool)
        chosen = np.argpartition(-bound, seeds - 1, axis=1)[:, :seeds]
        np.put_along_axis(first, chosen, True, axis=1)
        self._fill(out, first, q, listed)
        seen = np.minimum((chosen[:, :, None] * BLOCK + np.arange(BLOCK)).reshape(rows, -1), examples)  # past the last example: nothing
        seen = np.where(seen < examples, np.take_along_axis(out, np.minimum(seen, examples - 1), axis=1), -1)
        least = np.maximum(np.partition(seen, -k, axis=1)[:, -k], 0)[:, None] if seen.shape[1] > k else np.zeros((rows, 1))
        self._fill(out, (bound * np.float32(1.0001) + np.float32(1e-6) >= least) & ~first, q, listed)
        return out

    def _fill(self, out, todo, q, listed) -> None:
        """Cosines of the rows with all examples of the blocks to do."""
        for block in np.flatnonzero(todo.any(axis=0)):
            rows, part = np.flatnonzero(todo[:, block]), slice(block * BLOCK, (block + 1) * BLOCK)
            out[rows, part] = q[rows] @ self.dense[part].T + listed[rows, part]

    def votes(self, where: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Share of label 1 in the distance-weighted votes, in log odds; the prior has the weight of a faint neighbour."""
        if not len(self.labels):
            return np.zeros(len(where))
        where = np.minimum(where, len(self.labels) - 1)
        weight = np.square(cosine) * self.weights[where]
        share, prior = min(max(self.empty, 0.01), 0.99), 0.02
        one = (weight * self.labels[where]).sum(axis=1) + prior * share
        zero = (weight * (1 - self.labels[where])).sum(axis=1) + prior * (1 - share)
        return np.log(one / zero)

    def own_votes(self, vectors: Rows) -> np.ndarray:
        """The votes on each example, in the order of the index, without itself."""
        if not len(self.labels):
            return np.zeros(0)
        where, cosine = self.nearest(vectors, self.k + 1)
        own = where == np.arange(len(vectors))[:, None]
        return self.votes(*self._without(where, cosine, own))

    def _without(self, where, cosine, own) -> tuple[np.ndarray, np.ndarray]:
        drop = np.where(own.any(axis=1), own.argmax(axis=1), self.k)
        keep = np.arange(self.k + 1) != drop[:, None]
        return where[keep].reshape(len(where), self.k), cosine[keep].reshape(len(where), self.k)

    def score(self, vectors: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, neighbours, cosines) of unit or zero vectors."""
        where, cosine = self.nearest(vectors, self.k)
        a, b = self.curve
        score = 1 / (1 + np.exp(-np.clip(a + b * self.votes(where, cosine), -30, 30))) if len(self.labels) else np.full(len(vectors), self.empty)
        return np.where(cosine[:, 0] > 0, score, self.empty), where, cosine


def curve_of(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """The logistic curve of votes x on labels y."""
    if not len(x):
        return 0.0, 1.0
    y, w = y.astype(float), weights / weights.sum() * len(weights)
    design, beta = np.stack([np.ones(len(x)), x], axis=1), np.array([0.0, 1.0])
    for _ in range(25):  # Newton steps, held near the uncalibrated vote by a ridge
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = design.T @ (w * (y - p)) - (beta - [0.0, 1.0])
        beta = beta + np.linalg.solve((design.T * (w * p * (1 - p))) @ design + np.eye(2), np.clip(step, -1e6, 1e6))
    return (float(beta[0]), float(beta[1])) if np.isfinite(beta).all() and beta[1] > 0 else (0.0, 1.0)


class Examples:
    """The rows that an index is made from, packed; they travel, and a worker makes the index when it first asks for it."""

    def __init__(self, ids, vectors: Rows, labels, weights, idf, empty: float, k: int):
        packer, steps = zlib.compressobj(1), []
        for low in range(0, len(vectors.at), AT_ONCE):
            part = vectors.at[low : low + AT_ONCE]
            steps.append(packer.compress(np.diff(part, prepend=vectors.at[low - 1] if low else 0).astype("<i4").tobytes()))
        self.steps = b"".join([*steps, packer.flush()])
        self.cut, self.value, self.rest = vectors.cut, vectors.value, (labels, weights, idf, empty, k)
        self.ids, self._index = np.asarray(ids), None

    def __getstate__(self):
        return self.__dict__ | {"_index": None}

    @property
    def rows(self) -> Rows:
        return Rows(self.cut, np.cumsum(np.frombuffer(zlib.decompress(self.steps), dtype="<i4"), dtype=np.int32), self.value)

    @property
    def index(self) -> ExampleIndex:
        if self._index is None:
            self._index = ExampleIndex(np.arange(len(self.ids)), self.rows, *self.rest, (0.0, 1.0))
        return self._index


@tidy
def _own_votes(batches, examples):
    """(example, x): the votes on examples, without themselves."""
    examples = examples.value
    index, rows = examples.index, examples.rows
    for batch in batches:
        some = batch.column(0).to_numpy()
        where, cosine = index.nearest(rows.take(some), index.k + 1)
        x = index.votes(*index._without(where, cosine, index.ids[where] == some[:, None]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], ["example", "x"])


def unit(cut: np.ndarray, at: np.ndarray, tf: np.ndarray, idf: np.ndarray, more: np.ndarray | float = 0.0) -> Rows:
    """TF-IDF rows of length 1, or without an entry: (1 + ln tf) * idf; more is the squared length of terms that no example holds."""
    value = (1 + np.log(tf)) * idf[at]
    row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    norm = np.sqrt(np.bincount(row, np.square(value), len(cut) - 1) + more)
    return Rows(cut, at, (value / norm[row]).astype(np.float32))


@tidy
def _weigh(batches, table):
    """(row, doc_id, held_out, at, tf, more, rest, rest_tf): the counts of terms that examples hold, the squared length of the
    others as far as their frequency is known here, and the terms (with counts) whose frequency is to be joined."""
    names, at_of, square, once, joined = table.value
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        for low, term, cut, place, tf in _counted(batch, 1):
            rows = len(cut) - 1
            where = np.minimum(np.searchsorted(names, term), max(0, len(names) - 1))
            found = names[where] == term if len(names) else np.zeros(len(term), dtype=bool)
            at = np.where(found, at_of[where], -1)[place] if len(names) else np.full(len(place), -1)
            more = np.where(found, square[where], once)[place] if len(names) else np.full(len(place), once)
            row = np.repeat(np.arange(rows), np.diff(cut))
            inside, rest = at >= 0, ~found[place] if joined else np.zeros(len(place), dtype=bool)
            outside = ~inside & ~rest
            squares = np.bincount(row[outside], np.square(1 + np.log(tf[outside])) * more[outside], rows)
            lists = []
            for mask, values, kind in ((inside, at, pa.int32()), (inside, tf, pa.int32()), (rest, term.view(np.int64)[place], pa.int64()), (rest, tf, pa.int32())):
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row[mask], np.arange(rows + 1)), pa.int32()), pa.array(values[mask], kind)))
            yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(rows)), batch.column(0)[low : low + rows], batch.column(2)[low : low + rows], lists[0], lists[1], pa.array(squares, pa.float64()), lists[2], lists[3]], ["row", "doc_id", "held_out", "at", "tf", "more", "rest", "rest_tf"])
            number += rows


@tidy
def _weigh_and_score(batches, table, examples, curve, threshold):
    """Both in one worker, where no frequency is to be joined."""
    weighed = (b.select(["doc_id", "held_out", "at", "tf", "more"]) for b in _weigh(batches, table))
    yield from _score(weighed, examples, curve, threshold)


@tidy
def _score(batches, examples, curve, threshold):
    examples = examples.value
    index = examples.index
    index.curve = curve
    for batch in batches:
        cut = batch.column(2).offsets.to_numpy()
        at, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        more = batch.column(4).to_numpy()
        cut = cut - cut[0]
        keys = [at[a:b].tobytes() + tf[a:b].tobytes() + m.tobytes() for a, b, m in zip(cut, cut[1:], more, strict=False)]
        place = {key: n for n, key in enumerate(dict.fromkeys(keys))}
        first = {key: k for k, key in reversed(list(enumerate(keys)))}
        rows = np.array([first[key] for key in place], dtype=np.int64)
        entry, to = _ranges(cut[rows], cut[rows + 1])
        score, where, cosine = index.score(unit(to, at[entry], tf[entry], index.idf, more[rows]))
        near = [examples.ids[index.ids[w[c > 0]]].tolist() for w, c in zip(where[:, :5], cosine[:, :5], strict=True)]
        weight = [c[c > 0].astype(float).tolist() for c in cosine[:, :5]]
        back = [place[key] for key in keys]
        score = score[back] if len(back) else score
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array([near[k] for k in back], pa.list_(pa.int64())), pa.array([weight[k] for k in back], pa.list_(pa.float64()))],
            ["doc_id", "held_out", "score", "predicted", "neighbours", "cosines"],
        )


def scored(documents: DataFrame, labels: DataFrame, held_out: Column, *, label: str = "toxic", threshold: float = 0.7, examples: int = 8000, k: int = 15) -> DataFrame:
    """Per row of documents: doc_id, held_out, score (0 to 1), predicted (score >= threshold), and as evidence the
    doc_ids and cosines of the five nearest examples.

    held_out is a boolean Column over doc_id; labels of such rows are not
    learned.  About `examples` labelled rows of each class, drawn by the hash of
    doc_id, are learned and indexed with all their terms.  A document
    labelled more than once has its largest label.  Texts that share no term with
    an example, null and empty ones too, get the share of label 1 among examples
    without a term, drawn towards its share among all.
    Repeated rows and null ids are kept, other columns ignored; an empty table
    gives no rows; without labels every score is 0.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out)
    known = known.join(documents.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    share = {r["label"]: min(1.0, examples / r["n"]) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    part = F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20)).toArrow()
    sample = dict(zip(drawn.column(0).to_pylist(), drawn.column(1).to_pylist(), strict=True))
    ids = shared(spark, sample)

    seen = texts.mapInArrow(lambda it: _frequencies(it, ids), "term long, n long, a long, b long").groupBy("term")
    seen = stored(seen.agg(*(F.sum(c).alias(c) for c in ("n", "a", "b"))), "frequencies")
    # terms of examples, and of the others the most frequent, are broadcast; a term that is left out and alone in its document needs no table
    other = seen.where("a + b = 0 and n > 1").select("term", "n")
    joined = other.count() > MAX_TERMS
    other = other.orderBy(F.desc("n"), "term").limit(MAX_TERMS).toArrow()
    inside = seen.where("a + b > 0").toArrow()
    total, one, zero = texts.count(), float(sum(sample.values())), float(len(sample) - sum(sample.values()))
    a, b = (inside.column(c).to_numpy().astype(float) for c in ("a", "b"))
    idf = (np.log((1 + total) / (1 + inside.column("n").to_numpy())) + 1) * stress(a, b, one, zero)
    names = np.concatenate([t.column("term").to_numpy() for t in (inside, other)]).astype(np.int64).view(np.uint64)
    order = np.argsort(names)
    at_of = np.concatenate([np.arange(len(idf)), np.full(len(other), -1)]).astype(np.int32)
    square = np.concatenate([np.zeros(len(idf)), np.square(np.log((1 + total) / (1 + other.column("n").to_numpy())) + 1)])
    once = float(np.square(np.log((1 + total) / 2) + 1))
    table = shared(spark, (names[order], at_of[order], square[order].astype(np.float32), once, joined))
    del names, order, at_of, square, other, inside, a, b
    give_back()
    hashed = texts.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    rows = hashed.mapInArrow(lambda it: _sampled(it, ids, table), "doc_id long, hash long, at array<int>, tf array<int>")
    # of an id that stands for several texts, the one of the least hash
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("hash", "at", "tf")).alias("r")).select("doc_id", "r.at", "r.tf").join(known, "doc_id").orderBy("label", "doc_id").toArrow()
    own = np.array([sample[i] for i in rows.column(0).to_pylist()], dtype=np.int64)
    weight = np.array([1 / share[y] for y in own.tolist()], dtype=float)
    found = np.array(rows.column(0).to_pylist(), dtype=np.int64)
    cut = np.concatenate([[0], np.cumsum(pc.list_value_length(rows.column(1)).to_numpy())]).astype(np.int64)
    vectors = Rows(cut, np.empty(cut[-1], dtype=np.int32), np.empty(cut[-1], dtype=np.float32))
    for low in range(0, len(rows), 512):  # as copies of all lists, and their arrays of doubles, would be large
        at, tf = (rows.column(c).slice(low, 512).combine_chunks().flatten().to_numpy() for c in (1, 2))
        part = cut[low : low + 513]
        vectors.at[part[0] : part[-1]] = at
        vectors.value[part[0] : part[-1]] = unit(part - part[0], at, tf, idf).value
    at = tf = None
    del rows
    give_back()
    some = np.diff(cut) > 0
    base = float((weight * own).sum() / max(1e-9, weight.sum()))
    empty = float(((weight * own)[~some].sum() + base) / (weight[~some].sum() + 1.0))
    index = shared(spark, Examples(found, vectors, own, weight, idf, empty, k))
    del vectors
    give_back()
    votes = spark.range(len(found)).mapInArrow(lambda it: _own_votes(it, index), "example long, x double").toArrow().to_pandas().sort_values("example")
    curve = curve_of(votes["x"].to_numpy(), own, weight)

    asked, schema = texts.withColumn("held_out", held_out), "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, cosines array<double>"
    if not joined:
        return asked.mapInArrow(lambda it: _weigh_and_score(it, table, index, curve, threshold), schema)
    counted = stored(asked.mapInArrow(lambda it: _weigh(it, table), "row long, doc_id long, held_out boolean, at array<int>, tf array<int>, more double, rest array<long>, rest_tf array<int>"), "terms")
    rest = counted.select("row", F.explode(F.arrays_zip("rest", "rest_tf")).alias("x")).select("row", F.col("x.rest").alias("term"), F.col("x.rest_tf").alias("f"))
    rest = rest.join(seen.where("a + b = 0").select("term", "n"), "term")
    length = F.pow((1 + F.log("f")) * (F.log(F.lit(1.0 + total) / (1 + F.col("n"))) + 1), 2)
    rest = rest.groupBy("row").agg(F.sum(length).alias("length"))
    counted = counted.join(rest, "row", "left").withColumn("more", F.col("more") + F.coalesce("length", F.lit(0.0)))
    return counted.select("doc_id", "held_out", "at", "tf", "more").mapInArrow(lambda it: _score(it, index, curve, threshold), schema)


def stress(a: np.ndarray, b: np.ndarray, one: float, zero: float) -> np.ndarray:
    """At least 1: how much a term in a and b examples of the classes weighs for its dependence on the label, by chi-squared."""
    a, b = np.minimum(a, one), np.minimum(b, zero)  # rows of an id that is repeated count once
    total = a + b
    chi2 = (one + zero) * np.square(a * zero - b * one) / np.maximum(1e-9, one * zero * total * (one + zero - total))
    return np.sqrt(1 + chi2 / CHI2)
