"""Folders and small files that driver and executors share, on any file system that Hadoop knows."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application; for tests and single machines.
_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own where that is unset and the master is this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(_remove, spark, _OWN[app])
    return _OWN[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the session's Python process ends."""
    path = f"{scratch_root(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM has gone; the folder is the cluster's to clean
        return


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- small files --------------------------------------------------------------


def place(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    there, where = place(spark, path)
    there.delete(where, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where it isn't there."""
    there, where = place(spark, folder)
    return sorted(f.getPath().getName() for f in there.listStatus(where)) if there.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    there, where = place(spark, path)
    stream = there.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def create_json(spark: SparkSession, path: str, value: dict) -> bool:
    """Writes a file that is there as a whole or not at all; False, with nothing changed, where the path is taken."""
    jvm = spark._jvm
    there, part = place(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = there.create(part, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(part, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        there.delete(part, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def arrow_place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """(file system, path) of Arrow, for tasks that read bytes; a path without a scheme is local."""
    uri = re.sub("^file:/+", "file:///", path) if path.startswith("file:") else path if "://" in path else f"file://{path}"
    return pyarrow.fs.FileSystem.from_uri(uri)
