"""Versioned documents: an ordered fold of operations for each name.

Operations (schema.EDIT) are `create` (position and text: the content is text)
and `insert`.  They apply in the order of seq, those with the same seq in the
order of op, position, text and edited_by (ORDER), nulls first.  Outcomes:
CREATED, APPLIED, ALREADY_EXISTS, INVALID_ARGUMENT (blank name),
NOT_FOUND, OUT_OF_RANGE.  A refused operation changes nothing and takes no version.

The operations of one name are one sorted stream in one task, as each depends on
the length of the text before it; the sort spills, and neither they nor the
versions of a text are held together.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rope import Rope
from tessera.schema import VERSION

ACCEPTED = ("CREATED", "APPLIED")
#: The order of operations of one name.
ORDER = ["seq", "op", "position", "text", "edited_by"]
#: What counts as white space around a name; fixed values: the characters that Unicode calls white space, and the four separators of ASCII.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of finished documents that a task holds before it sends them.
HELD = 1 << 22


def plain_name(name: str | None) -> str:
    """A name without outer white space, as documents are stored under it."""
    return (name or "").strip(SPACES)


def plain(name: Column) -> Column:
    """plain_name of a column."""
    return F.btrim(name, F.lit(SPACES))


def step(state: tuple[str, int] | None, op: str, name: str | None, position: int | None, text: str | None) -> tuple[tuple[str, int] | None, str]:
    """(state, status) after an operation; a state is (content, version), or None where there is no document."""
    text = text or ""
    status = judged(None if state is None else len(state[0]), op, name, position)
    if status == "CREATED":
        return (text, 1), status
    if status == "APPLIED":
        content, version = state
        return (content[:position] + text + content[position:], version + 1), status
    return state, status


def judged(length: int | None, op: str, name: str | None, position: int | None) -> str:
    """The status of an operation on a document of so many characters, None where there is no document."""
    if op == "create":
        if not plain_name(name):
            return "INVALID_ARGUMENT"
        return "CREATED" if length is None else "ALREADY_EXISTS"
    if length is None:
        return "NOT_FOUND"
    return "APPLIED" if position is not None and 0 <= position <= length else "OUT_OF_RANGE"


class Document:
    """A document that takes many operations; its text is a rope."""

    def __init__(self, content: str | None = None, version: int = 0):
        self.text, self.version = None if content is None else Rope(content), version

    def apply(self, op: str, name: str | None, position: int | None, text: str | None) -> str:
        """The status of the operation, which is applied if it can be."""
        status = judged(None if self.text is None else len(self.text), op, name, position)
        if status == "CREATED":
            self.text, self.version = Rope(text or ""), 1
        elif status == "APPLIED":
            self.text.insert(position, text or "")
            self.version += 1
        return status


def named(ops: DataFrame) -> DataFrame:
    """Names of creates without outer white space, as documents are stored under them."""
    return ops.withColumn("name", F.when(F.col("op") == "create", plain(F.col("name"))).otherwise(F.col("name")))


def _walk(batches):
    """Rows sorted by name and ORDER: one state at a time, however long a document's history."""
    last, state = object(), None
    for batch in batches:
        out = []
        for seq, op, name, position, text, by in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != last:
                last, state = name, None
            state, status = step(state, op, name, position, text)
            ok = status in ACCEPTED
            out.append({"seq": seq, "name": name, "op": op, "status": status, "version": state[1] if state else None, "content": state[0] if ok else None, "edited_by": by})
        yield pa.RecordBatch.from_pylist(out, _VERSION)


_VERSION = pa.schema([("seq", pa.int64()), ("name", pa.string()), ("op", pa.string()), ("status", pa.string()), ("version", pa.int64()), ("content", pa.string()), ("edited_by", pa.int64())])
_STATE = pa.schema([("name", pa.string()), ("content", pa.string()), ("version", pa.int64())])


def outcomes(ops: DataFrame) -> DataFrame:
    """A row (schema.VERSION) for every operation, in the order of seq within a name."""
    rows = named(ops).select("seq", "op", "name", "position", "text", "edited_by")
    return rows.repartition("name").sortWithinPartitions("name", *ORDER).mapInArrow(_walk, VERSION)


def history(ops: DataFrame) -> DataFrame:
    """The accepted versions: name, version, content, edited_by, seq."""
    return outcomes(ops).where(F.col("status").isin(*ACCEPTED)).select("name", "version", "content", "edited_by", "seq")


def rejected(ops: DataFrame) -> DataFrame:
    """The refused operations: seq, name, op, status."""
    return outcomes(ops).where(~F.col("status").isin(*ACCEPTED)).select("seq", "name", "op", "status")


def _fold(batches):
    """Rows sorted by name, a state (first) before its operations: the last state of each name, through one rope at a time."""
    last, document, out, held = None, None, [], 0

    def ended():
        nonlocal held
        if document is not None and document.text is not None:
            out.append({"name": last, "content": str(document.text), "version": document.version})
            held += len(document.text)

    for batch in batches:
        for first, op, name, position, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if document is None or name != last:
                ended()
                last, document = name, Document()
                if held >= HELD:
                    yield pa.RecordBatch.from_pylist(out, _STATE)
                    out, held = [], 0
            if first:
                document = Document(text, position)
            else:
                document.apply(op, name, position, text)
    ended()
    yield pa.RecordBatch.from_pylist(out, _STATE)


def final_state(ops: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """(name, content, version) of every document after ops.

    since has the same columns and is the state before ops, so that a history is
    folded from its last checkpoint on; documents without new operations stay.
    """
    rows = named(ops).where((F.col("op") != "create") | (F.col("name") != "")).select(F.lit(False).alias("first"), *ORDER[:-1], "edited_by", "name")
    if since is not None:
        none = F.lit(None).cast("long")
        rows = rows.unionByName(since.select(F.lit(True).alias("first"), none.alias("seq"), F.lit(None).cast("string").alias("op"), F.col("version").alias("position"), F.col("content").alias("text"), none.alias("edited_by"), "name"))
    dealt = rows.repartition("name").sortWithinPartitions("name", F.desc("first"), *ORDER)
    return dealt.select("first", "op", "name", "position", "text").mapInArrow(_fold, "name string, content string, version long")


def latest(versions: DataFrame) -> DataFrame:
    """(name, content, version): the largest version of each name in a feed."""
    return versions.groupBy("name").agg(F.max_by("content", "version").alias("content"), F.max("version").alias("version"))


def listing(documents: DataFrame) -> DataFrame:
    """(name, version, length in code points)."""
    return documents.select("name", "version", F.char_length("content").cast("long").alias("length"))


def monotone(feed: DataFrame) -> DataFrame:
    """A feed (seq, name, version, ...) without updates whose version an earlier one has reached."""
    seen = F.max("version").over(Window.partitionBy("name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    flagged = feed.select(F.struct(*(F.col(f"`{c}`") for c in feed.columns)).alias("row"), (seen.isNull() | (F.col("version") > seen)).alias("new"))
    return flagged.where("new").select("row.*")


def session_stats(results: DataFrame) -> DataFrame:
    """Per edited_by: operations, accepted and refused ones, documents touched."""
    ok = F.col("status").isin(*ACCEPTED)
    return results.groupBy("edited_by").agg(F.count("*").alias("commands"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("refused"), F.countDistinct("name").alias("documents"))
