"""What the text operators share: scratch tables, Arrow batches, hashed words and shingles.

Words are the runs of bytes outside 0x20 and 0x09-0x0D after lower-casing A-Z
alone.  Both rules are byte rules that never split a UTF-8 sequence, so a whole
Arrow batch is treated as one byte array and no Python object is made per word.
A word or shingle is identified by a 64-bit hash; two different shingles of a
pair of documents agree by chance with probability below 1e-10.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the numpy kernels take at once; bounds a worker's memory.
CHUNK_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


# --- scratch tables -----------------------------------------------------------


#: Folders of our own, by application; for tests and single machines.
_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(_remove, spark, _OWN[app])
        root = _OWN[app]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the session's Python process ends."""
    path = f"{scratch_root(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM has gone; the folder is the cluster's to clean
        return


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        _remove(spark, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    return stored_at(df, label)[0]


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


# --- columns ------------------------------------------------------------------


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, UPPER.lower())


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


# --- bytes of Arrow batches ---------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole rows of about size bytes; a longer row comes alone."""
    data, offsets = text_bytes(column)
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        high = min(high, rows)
        yield low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; by sorting, which is several times as fast as numpy's hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes where inside holds; runs end with their row."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], eight bytes of every span at a time."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = end - start
    h = mix(length.astype(np.uint64) + _M2)
    block = words[start] & _LOW_BYTES[np.minimum(length, 8)]
    h = mix(h ^ block * _M1)
    live, at = np.flatnonzero(length > 8), 8
    while len(live):
        left = length[live] - at
        block = words[start[live] + at] & _LOW_BYTES[np.minimum(left, 8)]
        h[live] = mix(h[live] ^ block * _M1)
        at += 8
        live = live[left > 8]
    return h


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word in order."""
    lowered = _LOWER[data]
    start, end, row = spans(lowered, offsets, _IS_WORD[lowered])
    return hash_spans(lowered, start, end), row


def shingles(words: np.ndarray, row: np.ndarray, rows: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the n-word shingles; a row of 1 to n-1 words has one, its whole sequence."""
    scale = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    sums, at = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if len(words) >= n:
        total = words[: len(words) - n + 1] * scale[0]
        for k in range(1, n):
            total += words[k : len(words) - n + 1 + k] * scale[k]
        whole = row[: len(row) - n + 1] == row[n - 1 :]
        sums, at = mix(total[whole]), row[: len(row) - n + 1][whole]
    count = np.bincount(row, minlength=rows)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        first = np.searchsorted(row, few)
        total = mix(count[few].astype(np.uint64) + _M1)
        for k in range(n - 1):
            has = count[few] > k
            total[has] += words[first[has] + k] * scale[k]
        sums, at = np.concatenate([sums, mix(total)]), np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        sums, at = sums[order], at[order]
    return sums, at


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct shingle hashes of each row) for chunk after chunk of a text column."""
    for low, data, offsets in chunks(column):
        rows = len(offsets) - 1
        sums, at = shingles(*hashed_words(data, offsets), rows, n)
        cut = np.searchsorted(at, np.arange(rows + 1))
        yield low, [distinct(sums[cut[k] : cut[k + 1]]) for k in range(rows)]


def shared(spark: SparkSession, value):
    """A broadcast value; callers state its bound."""
    return spark.sparkContext.broadcast(value)


def released(*values) -> None:
    """Frees broadcast values that no later action needs, on executors and driver."""
    for value in values:
        value.destroy()


def give_back() -> None:
    """Returns memory that arrays no longer take to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(function):
    """For a function from Arrow batches to Arrow batches: when a task ends, the memory that its arrays took goes back to the
    system, as a worker waits for its next task beside others."""

    @functools.wraps(function)
    def run(*args, **options):
        try:
            yield from function(*args, **options)
        finally:
            give_back()

    return run


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"
