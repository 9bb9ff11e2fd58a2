"""Column sets of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

MEASURES = ["temperature", "humidity", "pressure", "rainfall", "wind_speed"]

#: A sensor record.
WEATHER = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("station_id", T.LongType()), *(T.StructField(m, T.DoubleType()) for m in MEASURES)])

#: A matrix as coordinates, counted from 0.
COORDINATES = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("v", T.DoubleType())])

#: An operation on a document: create, or insert text at a position.
EDIT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("edited_by", T.LongType()),
    ]
)

#: An outcome of an operation; content is set for accepted ones.
VERSION = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("edited_by", T.LongType()),
    ]
)

#: A row of a stream benchmark's log.
SWEEP = "records long, workers long, batch_size long, rep long, elapsed_s double, recs_per_s double, query_latency_ms double"
