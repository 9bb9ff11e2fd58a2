"""Whole-buffer scan: records of numbers in files of any bytes, read by ranges of bytes side by side.

A number begins at a digit, a minus sign or a point outside a number and takes
what fits `-?[0-9]*(.[0-9]*)?`; every other byte only ends it.  Lines mean
nothing: a record is the next numbers of the stream, wherever they stand.  A sign
or point without digits is 0.  Whole columns take a number's whole part, null if
it needs more than 64 bits; the others the nearest double.

A range cannot know whether its first bytes go on with a number, nor how many
numbers are before it.  So each range is read as a function: from the state that
it is entered in (outside a number, in its whole part, in its fraction) to the
state that it is left in and the numbers that begin in it.  The functions of a
file's ranges are composed in order, which tells each range how it is entered
and the place of its first number.  Then each range gives the records that begin
in it, and reads on past its end for the last one.

Ranges may be far smaller than what a task should read, so tasks are dealt by
bytes: each takes neighbouring ranges, and reads those of one file as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import shared
from tessera.schema import WEATHER

#: Bytes of a range, and of a block that is looked at at once.
RANGE = 64 << 20
BLOCK = 1 << 20
#: Bytes that are read at first past the end of a range.
BEYOND = 1 << 12
OUTSIDE, WHOLE, FRACTION = 0, 1, 2
_OTHER, _DIGIT, _MINUS, _POINT = 0, 1, 2, 3
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[48:58], _KIND[45], _KIND[46] = _DIGIT, _MINUS, _POINT


# --- bytes --------------------------------------------------------------------


def states(kind: np.ndarray, entered: int) -> np.ndarray:
    """The state after each byte.  A minus sign or other byte sets it whatever was before; a point leads to the fraction."""
    place = np.arange(len(kind), dtype=np.int64)
    sets = np.maximum.accumulate(np.where((kind == _OTHER) | (kind == _MINUS), place, -1))
    points = np.cumsum(kind == _POINT)
    since = points - np.where(sets >= 0, points[sets], 0)
    fraction = (since > 0) | ((sets < 0) & (entered == FRACTION))
    return np.where(kind == _OTHER, OUTSIDE, np.where(fraction, FRACTION, WHOLE))


def begins(kind: np.ndarray, entered: int) -> tuple[np.ndarray, int]:
    """(where numbers begin, the state after the last byte)."""
    if not len(kind):
        return np.zeros(0, dtype=np.int64), entered
    after = states(kind, entered)
    before = np.concatenate([[entered], after[:-1]])
    new = (kind == _MINUS) | ((kind == _DIGIT) & (before == OUTSIDE)) | ((kind == _POINT) & (before != WHOLE))
    return np.flatnonzero(new), int(after[-1])


def function(blocks: Iterator[bytes]) -> list[tuple[int, int]]:
    """(state it is left in, numbers that begin) of some bytes for each of the three states that they are entered in."""
    now = [(s, 0) for s in range(3)]
    for block in blocks:
        kind = _KIND[np.frombuffer(block, dtype=np.uint8)]
        sets = (kind == _OTHER) | (kind == _MINUS)
        same = int(sets.argmax()) if sets.any() else len(kind)  # from the first byte that sets the state on, nothing depends on what was before
        for part, entered in ((kind[:same], {s for s, _ in now}), (kind[same:], {OUTSIDE})):
            if len(part):
                made = {s: begins(part, s) for s in entered}
                now = [(after, n + len(first)) for (first, after), n in ((made.get(s) or made[OUTSIDE], n) for s, n in now)]
    return now


def texts(blocks: Iterator[bytes], entered: int) -> Iterator[pa.Array]:
    """The numbers that begin in some bytes entered in a state, as text; what goes on with a number from before is left out."""
    rest = b""
    for block in blocks:
        data = np.frombuffer(rest + block, dtype=np.uint8)
        kind = _KIND[data]
        first, left = begins(kind, OUTSIDE if rest else entered)
        entered = left
        if not len(first):  # all of it goes on with a number from before
            continue
        whole = len(first) - (left != OUTSIDE)  # the last number may go on
        rest = data[first[-1] :].tobytes() if whole < len(first) else b""
        if whole:
            yield _cut(data, kind, first[: whole + 1])[:whole]
    if rest:
        yield pa.array([rest.decode()], pa.large_string())


def _cut(data: np.ndarray, kind: np.ndarray, first: np.ndarray) -> pa.Array:
    inside = np.flatnonzero(kind[first[0] :] != _OTHER) + first[0]
    offsets = np.append(np.searchsorted(inside, first), len(inside)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes()))


def numbers(text: pa.Array, kind: T.DataType) -> pa.Array:
    """Numbers of their text."""
    if isinstance(kind, T.LongType):
        text = pc.replace_substring_regex(text, r"\..*", "")
        text = pc.if_else(pc.is_in(text, pa.array(["", "-"], pa.large_string())), "0", text)
        try:
            return text.cast(pa.int64())
        except pa.ArrowInvalid:
            return pa.array([v if -(2**63) <= (v := int(x)) < 2**63 else None for x in text.to_pylist()], pa.int64())
    return pc.if_else(pc.is_in(text, pa.array(["", "-", ".", "-."], pa.large_string())), "0", text).cast(pa.float64())


# --- files --------------------------------------------------------------------


def _blocks(path: str, low: int, high: int | None = None) -> Iterator[bytes]:
    where, name = shared.arrow_place(path)
    with where.open_input_file(name) as f:
        yield from _read(f, low, high)


def _read(f, low: int, high: int | None) -> Iterator[bytes]:
    f.seek(low)
    while (high is None or low < high) and (block := f.read(BLOCK if high is None else min(BLOCK, high - low))):
        low += len(block)
        yield block


def _onwards(path: str, low: int, high: int) -> Iterator[bytes]:
    """The bytes from low to high, and then those behind them by steps that double, for as long as they are asked for."""
    where, name = shared.arrow_place(path)
    with where.open_input_file(name) as f:
        yield from _read(f, low, high)
        step = BEYOND
        while block := f.read(step):
            yield block
            step = min(2 * step, BLOCK)


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges dealt to tasks by their bytes, neighbours together and in order."""
    bytes_, many = (int(v or 0) for v in ranges.agg(F.sum(F.col("high") - F.col("low")), F.count("*")).first())
    least = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(many, max(least, -(-bytes_ // RANGE)), 100_000)
    return ranges.repartitionByRange(max(1, tasks), "file", "low").sortWithinPartitions("file", "low")


def _runs(ranges: list[dict]) -> Iterator[dict]:
    """Entries of ranges, neighbours in a file made one."""
    run: dict = {}
    for r in ranges:
        if run and (run["file"], run["high"]) == (r["file"], r["low"]):
            run |= {"high": r["high"], "many": run["many"] + r["many"]}
            continue
        if run:
            yield run
        run = dict(r)
    if run:
        yield run


_FUNCTION = ", ".join(f"left{s} int, begins{s} long" for s in range(3))


def _functions(batches):
    for batch in batches:
        out = []
        for path, ranges in groupby(batch.to_pylist(), lambda r: r["file"]):
            where, name = shared.arrow_place(path)
            with where.open_input_file(name) as f:
                for r in ranges:
                    made = function(_read(f, r["low"], r["high"]))
                    out.append(r | {f"left{s}": v for s, (v, _) in enumerate(made)} | {f"begins{s}": n for s, (_, n) in enumerate(made)})
        yield pa.RecordBatch.from_pylist(out, _FUNCTIONS)


_FUNCTIONS = pa.schema([("file", pa.string()), ("low", pa.int64()), ("high", pa.int64()), *(f for s in range(3) for f in ((f"left{s}", pa.int32()), (f"begins{s}", pa.int64())))])
_ENTRIES = pa.schema([("file", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("entered", pa.int32()), ("first", pa.int64()), ("many", pa.int64())])


def _composed(batches):
    """Ranges sorted by file and place: how each is entered, the place of its first number and how many begin in it."""
    file, state, first = None, OUTSIDE, 0
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["file"] != file:
                file, state, first = r["file"], OUTSIDE, 0
            many = r[f"begins{state}"]
            out.append({"file": file, "low": r["low"], "high": r["high"], "entered": state, "first": first, "many": many})
            state, first = r[f"left{state}"], first + many
        yield pa.RecordBatch.from_pylist(out, _ENTRIES)


def entries(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(file, low, high, entered, first, many) of each range of the files at path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    low = F.explode(F.expr(f"sequence(0L, length - 1, {int(range_bytes)}L)")).alias("low")
    ranges = files.select("file", low, "length").select("file", "low", F.least(F.col("low") + range_bytes, "length").alias("high"))
    found = _dealt(ranges).mapInArrow(_functions, f"file string, low long, high long, {_FUNCTION}")
    ordered = shared.stored(found, "functions").repartition("file").sortWithinPartitions("file", "low")
    return ordered.mapInArrow(_composed, "file string, low long, high long, entered int, first long, many long")


def scan(spark: SparkSession, path: str, schema: T.StructType = WEATHER, skip: int = 3, range_bytes: int = RANGE) -> DataFrame:
    """Records with the columns of schema (long and double) of the numbers in each file at path, after skip numbers of its head.

    Files are streams of their own.  What is left at a file's end and is no whole record gives no row; empty files give none.
    """
    width, kinds, names = len(schema), [f.dataType for f in schema], schema.names
    from_record = lambda place: skip + width * -(-max(0, place - skip) // width)

    def rows(batches):
        for batch in batches:
            for r in _runs(batch.to_pylist()):
                yield from _records(r, from_record(r["first"]), from_record(r["first"] + r["many"]))

    def _records(r, begin, end):
        place, held = r["first"], []
        if begin >= end:
            return
        for text in texts(_onwards(r["file"], r["low"], r["high"]), r["entered"]):  # past the range's end, as far as its last record goes
            here = text.slice(max(0, begin - place), max(0, end - max(begin, place)))
            place += len(text)
            held.append(here)
            own = pa.concat_arrays(held)
            whole = len(own) // width * width
            if whole:
                at = np.arange(0, whole, width)
                yield pa.RecordBatch.from_arrays([numbers(own.take(pa.array(at + c)), kind) for c, kind in enumerate(kinds)], names)
            held = [own.slice(whole)]
            if place >= end:
                return

    known = shared.stored(entries(spark, path, range_bytes), "entries")
    return _dealt(known).mapInArrow(rows, schema)


def leading(path: str, many: int = 3) -> list[float]:
    """The first numbers of a file, the head of a record file; read from its beginning on."""
    out: list[float] = []
    for text in texts(_blocks(path, 0), OUTSIDE):
        out += numbers(text.slice(0, many - len(out)), T.DoubleType()).to_pylist()
        if len(out) == many:
            break
    return out
