"""Target-distribution importance resampling over hashed word runs.

Features are the runs of 1 to `longest` consecutive words, each hashed to a
bucket by the crc32 of its bytes.  A bucket's gain is an array entry: the log
ratio of its share in the target texts to its share in all documents, in
thousandths, rounded down.  A document's weight is the sum of gains over its
features, and a score adds noise that depends on the id alone, so the highest
scores are a draw without replacement.

The draw needs no sort of the documents.  Scores are integers, so their
histogram is exact; it is dealt by ranges of scores, its counts are summed from
the top, first over the ranges (one row each goes to the driver) and then
inside each, and the score at which the draw ends is read off.  Only documents
at or above it are numbered, by doc_id within each score.

Equal scores are rare among different ids: the noise spreads documents of one
weight over thousands of scores, the fullest of which takes one in 2,700.  Rows
that repeat an id are counted before they are dealt, so they fill no task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, released, shared, stored, tidy

BUCKETS = 10_000
#: Bytes of a text that are split into words at once.
SLICE = 1 << 20
#: Rows that one row of a counted group is turned into at once.
COPIES = 1 << 16

#: Bytes of words stay, A-Z lower-cased; all others become blanks.
_AS_WORDS = bytes(k + 32 if 0x41 <= k <= 0x5A else k if 0x30 <= k <= 0x39 or 0x61 <= k <= 0x7A or k >= 0x80 else 0x20 for k in range(256))


def _slices(row: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about SLICE bytes of it at a time."""
    at = 0
    while at < len(row):
        end = row.find(b" ", at + SLICE)
        end = len(row) if end < 0 else end
        yield row[at:end].split()
        at = end


def features(row: bytes, buckets: int = BUCKETS, longest: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of the features that end in them) of a text whose bytes went through _AS_WORDS."""
    before: list[bytes] = []
    for words in _slices(row):
        run, found = before + words, []
        for n in range(1, longest + 1):
            first = max(0, len(before) - n + 1)
            runs = run[first:] if n == 1 else [b" ".join(run[k : k + n]) for k in range(first, len(run) - n + 1)]
            found.append(np.fromiter(map(crc32, runs), np.uint32, len(runs)) % buckets)
        yield len(words), np.concatenate(found)
        before = run[len(run) - longest + 1 :] if longest > 1 else []


def _rows(column: pa.Array) -> Iterator[bytes]:
    for _, data, offsets in chunks(column):
        whole = data.tobytes().translate(_AS_WORDS)
        for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield whole[low:high]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """How many features of the column text fall into each bucket.  Tasks send their sums, at most a row for each bucket."""

    @tidy
    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for row in _rows(batch.column(0)):
                for _, found in features(row, buckets, longest):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets, in doubles."""
    many, all_source, all_target = len(source), float(source.sum() + len(source)), float(target.sum() + len(source))
    ratio = [(float(t + 1) * all_source) / (float(s + 1) * all_target) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    assert len(ratio) == many
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) of a u in (0, 1) from the first 32 bits of sha256('seed:id'); a null id counts as empty."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighted(documents: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    spark = documents.sparkSession
    array = shared(spark, gain)  # one number for each bucket

    @tidy
    def weigh(batches):
        table = array.value
        for batch in batches:
            out = []
            for row in _rows(batch.column(1)):
                words = many = weight = 0
                for new, found in features(row, len(table), longest):
                    words, many, weight = words + new, many + len(found), weight + int(table[found].sum())
                out.append((words, many, weight))
            sums = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(3))], ["doc_id", "n_words", "n_features", "weight"])

    out = stored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long"), "weighted")
    released(array)
    return out


def offsets(scores: DataFrame) -> tuple[DataFrame, int]:
    """((score, above), rows): for each score of the column, how many rows have a greater one.

    The histogram is written once, dealt by ranges of scores; the driver sees one row for each range.
    """
    spark = scores.sparkSession
    counts = scores.groupBy("score").agg(F.count("*").alias("n"))
    histogram = stored(counts.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()), "histogram")
    above, parts = 0, []
    for part, n, _ in sorted(histogram.groupBy("part").agg(F.sum("n"), F.max("score")).collect(), key=lambda r: -r[2]):
        parts.append((part, above))
        above += n
    firsts = F.broadcast(spark.createDataFrame(parts, "part int, first long"))  # a row for each range of scores
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    return histogram.join(firsts, "part").select("score", (F.col("first") + F.coalesce(inside, F.lit(0))).alias("above")), above


def ranked(rows: DataFrame, above: DataFrame) -> DataFrame:
    """rows (doc_id, n_features, weight, score) with rank: the rows with a greater score, and the place by doc_id among equals.

    above has every score of rows.  Null ids come last of a score; rows that are alike in all columns are counted
    before they are dealt and take ranks one after another.
    """
    alike = ["score", "doc_id", "n_features", "weight"]
    groups = rows.groupBy(*alike).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("place", F.coalesce(F.sum("copies").over(order), F.lit(0))).join(above, "score")
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    here = F.sequence(F.col("block") * COPIES, F.least(F.col("copies"), (F.col("block") + 1) * COPIES) - 1)
    return blocks.withColumn("copy", F.explode(here)).select("doc_id", "n_features", "weight", "score", (F.col("above") + F.col("place") + F.col("copy") + 1).alias("rank"))


def resampled(documents: DataFrame, target: DataFrame, *, percent: int = 10, least_words: int = 20, buckets: int = BUCKETS, longest: int = 1, seed: int = 2024) -> DataFrame:
    """A row (doc_id, n_features, weight, score, rank) for each row of documents (doc_id, text); target has a column text.

    floor(percent / 100 of the rows with at least least_words words) rows are
    drawn, those with the highest scores, and have ranks 1, 2, 3 ...; all others
    have a null rank.  Ties of a score go to the smaller doc_id, then to fewer
    features and the smaller weight; null ids come last and count as '' in the
    noise.  Null and empty texts have no words, weight 0 and are never drawn,
    unless least_words is 0.  Repeated rows are drawn and ranked each for itself.
    Empty documents give no rows; without target texts the gains are those of a
    flat target.  Other columns are not looked at.
    """
    if not 0 <= percent <= 100 or buckets < 1 or longest < 1:
        raise ValueError("percent must be 0 to 100, buckets and longest at least 1")
    gain = gains(bucket_counts(documents, buckets, longest), bucket_counts(target, buckets, longest))
    scored = weighted(documents, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    eligible = F.col("n_words") >= least_words
    above, rows = offsets(scored.where(eligible))
    drawn = percent * rows // 100
    surviving = above.where(F.col("above") < drawn)
    least = surviving.agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long")
    columns = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    if least is None:
        return scored.select(*columns, none.alias("rank"))
    stays = eligible & (F.col("score") >= least)
    numbered = ranked(scored.where(stays), surviving)
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return numbered.unionByName(scored.where(~stays).select(*columns, none.alias("rank")))
