"""Benchmark decontamination: short test items found inside long documents.

The items are partitioned by the size of their shingle sets, class c holding
sizes 2^(c-1)+1 to 2^c.  An item's signature is the k smallest of its min-wise
hashed shingles.  With k = size - ceil(threshold * size) + 1 a document that
contains the threshold's part of the item must hold at least one of them, however
long it is, so unlike banded MinHash the search loses nothing when a document is
a thousand times the item.  A document probes the class only if it is large
enough for that class.  Items found are verified by exact containment of the word
shingles themselves, not of their hashes.

The index is broadcast.  Its bound is the parameter max_index (signature
values); more items are taken in blocks of that size, each against all documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import UPPER, WORD, chunks, hashed_words, shared, shingle_sets, shingles, tidy

_LOWER = str.maketrans(UPPER, UPPER.lower())
_FLAGS = 1 << 20
SCHEMA = "doc_id long, item_id long, n_item long, n_common long, containment double"


def word_shingles(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    """The distinct n-word shingles; fewer words give one, no words none."""
    words = re.findall(WORD, (text or "").translate(_LOWER))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


class ItemIndex:
    """A block of items: signatures by size class, and the texts for verification."""

    def __init__(self, items: list[tuple[int, str]], percent: int, n: int):
        self.items, self.percent, self.n = items, percent, n
        sets = [s for _, some in shingle_sets(pa.array([t for _, t in items], pa.string()), n) for s in some]
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.classes = []
        self.flags = np.zeros(_FLAGS, dtype=bool)
        size_class = np.ceil(np.log2(np.maximum(self.sizes, 1))).astype(int)
        for c in np.unique(size_class[self.sizes > 0]):
            members = np.flatnonzero((size_class == c) & (self.sizes > 0))
            values, owners = [], []
            for m in members:
                size = len(sets[m])
                k = size - -(-percent * size // 100) + 1
                values.append(sets[m][:k])
                owners.append(np.full(k, m))
            values, owners = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(values, kind="stable")
            self.classes.append((-(-percent * int(self.sizes[members].min()) // 100), values[order], owners[order]))
            self.flags[(values & np.uint64(_FLAGS - 1)).astype(np.int64)] = True
        self._words: dict[int, set] = {}

    def candidates(self, sums: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Distinct (row, item) pairs of which the row holds a signature value."""
        many = np.bincount(row, minlength=rows)
        keep = self.flags[(sums & np.uint64(_FLAGS - 1)).astype(np.int64)]
        sums, row = sums[keep], row[keep]
        found = []
        for least, values, owners in self.classes:
            large = many[row] >= least
            low, high = np.searchsorted(values, sums[large]), np.searchsorted(values, sums[large], "right")
            hit = high - low
            if hit.any():
                first = np.repeat(low, hit) + np.arange(hit.sum()) - np.repeat(np.cumsum(hit) - hit, hit)
                found.append(np.stack([np.repeat(row[large], hit), owners[first]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)

    def words_of(self, item: int) -> set:
        if item not in self._words:
            self._words[item] = word_shingles(self.items[item][1], self.n)
        return self._words[item]


def _found(ids, texts, index, n):
    """(row, item, common) of every item of the index that a row contains."""
    for low, data, offsets in chunks(texts):
        rows = len(offsets) - 1
        last, have = -1, set()
        for row, item in index.candidates(*shingles(*hashed_words(data, offsets), rows, n), rows).tolist():
            if row != last:
                last, have = row, word_shingles(texts[low + row].as_py(), n)
            wanted = index.words_of(item)
            common = len(wanted & have)
            if 100 * common >= index.percent * len(wanted):
                yield low + row, item, common


@tidy
def _search(batches, index, n):
    index = index.value
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    for batch in batches:
        ids = batch.column(0)
        out = []
        for row, item, common in _found(ids, batch.column(1), index, n):
            size = len(index.words_of(item))
            out.append((ids[row].as_py(), index.items[item][0], size, common, common / size))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "n_item", "n_common", "containment"])


@tidy
def _clean(batches, index, n, at):
    index = index.value
    for batch in batches:
        keep = np.ones(len(batch), dtype=bool)
        for row, _, _ in _found(None, batch.column(at), index, n):
            keep[row] = False
        yield batch.filter(pa.array(keep))


def _blocks(items: DataFrame, percent: int, n: int, max_index: int):
    """Broadcast indexes of at most about max_index signature values that together hold every item."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    values = items.agg(F.sum(F.regexp_count("text", F.lit(WORD)) * (100 - percent) / 100 + 1)).first()[0] or 0
    blocks = max(1, -(-int(values) // max_index))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield shared(items.sparkSession, ItemIndex([tuple(r) for r in part.collect()], percent, n))


def contained_items(documents: DataFrame, items: DataFrame, *, percent: int = 80, n: int = 5, max_index: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, n_item, n_common, containment where a document holds at least percent of an item's shingles.

    Shingles are n words, lower-cased in A-Z; an item or document of 1 to n-1
    words has one shingle, its whole sequence; null or empty texts match
    nothing.  Repeated rows of either table each give rows.  Other columns are
    ignored; an empty table gives no rows.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = None
    for index in _blocks(items, percent, n, max_index):
        found = texts.mapInArrow(lambda it, index=index: _search(it, index, n), SCHEMA)
        result = found if result is None else result.unionByName(found)
    return result


def without_contaminated(documents: DataFrame, items: DataFrame, *, percent: int = 80, n: int = 5, max_index: int = 2_000_000) -> DataFrame:
    """documents without the rows that contain an item; columns are unchanged and no text is moved."""
    at = documents.columns.index("text")
    for index in _blocks(items, percent, n, max_index):
        documents = documents.mapInArrow(lambda it, index=index: _clean(it, index, n, at), documents.schema)
    return documents
