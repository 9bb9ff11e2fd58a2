"""The engine's queries over the driver's tables, and the same in DuckDB SQL.

events stands in for sensor records, embeddings for matrices, conversations for
operations on documents and lineitem for a benchmark log.  The measures are on a
grid of one half and matrix cells are integers, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import shared
from tessera.functions import parts_of, setting
from tessera.operators import benchlog, documents, matrix, weather
from tessera.plans import render
from tessera.schema import MEASURES, WEATHER
from tessera.sources import matrices, numbers
from tessera.sources import weather as weather_source
from tessera.streaming import documents as document_stream
from tessera.streaming import replay
from tessera.streaming import weather as weather_stream
from tessera.streaming.tables import ChangeTable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- sensor records -----------------------------------------------------------


def as_weather(events: DataFrame) -> DataFrame:
    """Sensor records from events: the measures are integer arithmetic on event_id."""
    grid = lambda a, m, low: (F.col("event_id") * a % m) * F.lit(0.5) + F.lit(float(low))
    return events.select(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("user_id").alias("station_id"), grid(37, 161, -30).alias("temperature"),
        grid(53, 201, 0).alias("humidity"), grid(71, 201, 950).alias("pressure"), grid(29, 101, 0).alias("rainfall"), grid(43, 81, 0).alias("wind_speed"),
    )


W = """WITH w AS (SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS "timestamp", user_id AS station_id,
  (event_id * 37 % 161) * 0.5e0 - 30 AS temperature, (event_id * 53 % 201) * 0.5e0 AS humidity, 950 + (event_id * 71 % 201) * 0.5e0 AS pressure,
  (event_id * 29 % 101) * 0.5e0 AS rainfall, (event_id * 43 % 81) * 0.5e0 AS wind_speed FROM events)
"""


def _w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_weather(_table(spark, sf_dir, "events"))


_GLOBAL = ", ".join(["CAST(count(*) AS BIGINT) AS n", *(f"{f}({m}) AS {f}_{m}" for f in ("sum", "avg", "min", "max") for m in MEASURES), "CAST(count(*) FILTER (WHERE temperature >= 40 OR temperature <= 0) AS BIGINT) AS extreme"])
_HOT, _COLD = ("temperature, \"timestamp\", station_id FROM w ORDER BY temperature " + d + ", \"timestamp\", station_id LIMIT 1" for d in ("DESC", "ASC"))
_INTERVAL = "\"timestamp\" // 60 AS \"interval\", CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1"
_STATIONS = "SELECT station_id, CAST(count(*) AS BIGINT) AS n, sum(temperature) AS sum_temperature, sum(rainfall) AS sum_rainfall FROM w"
_TOP = "SELECT station_id, n, sum_temperature / n AS avg_temperature, sum_rainfall FROM ({}) ORDER BY n DESC, station_id LIMIT {}"


def _report_sql(where: str, k: int) -> str:
    keys = [("TOTAL_MEASUREMENTS", None, "n")]
    for m in ("temperature", "humidity", "pressure"):
        keys += [(f"{a}_{m.upper()}", f"{b}_{m}", None) for a, b in (("AVERAGE", "avg"), ("MIN", "min"), ("MAX", "max"))]
    keys += [("TOTAL_RAINFALL", "sum_rainfall", None), ("MAX_RAINFALL", "max_rainfall", None), ("AVERAGE_WIND_SPEED", "avg_wind_speed", None), ("MAX_WIND_SPEED", "max_wind_speed", None), ("EXTREME_TEMPERATURE_EVENTS", None, "extreme")]
    row = "SELECT {} AS line, '{}' AS key, CAST({} AS DOUBLE) AS value, CAST({} AS DOUBLE) AS rain, CAST({} AS BIGINT) AS station_id, CAST({} AS BIGINT) AS \"at\", CAST({} AS BIGINT) AS n"
    parts = [row.format(k_, key, f"coalesce({v}, 0)" if v else "NULL", "NULL", "NULL", "NULL", n or "NULL") + " FROM g" for k_, (key, v, n) in enumerate(keys)]
    line = len(keys)
    for name, table in (("HOTTEST_MEASUREMENT", "hot"), ("COLDEST_MEASUREMENT", "cold")):
        parts.append(row.format(line, name, "coalesce(max(temperature), 0)", "NULL", "coalesce(max(station_id), 0)", 'coalesce(max("timestamp"), 0)', "NULL") + f" FROM {table}")
        line += 1
    parts.append(row.format(line, "BUSIEST_INTERVAL", "NULL", "NULL", "NULL", 'coalesce(max("interval"), -1)', "coalesce(max(n), 0)") + " FROM busy")
    parts.append(row.format(line + 1, "TOP_STATIONS", "avg_temperature", "sum_rainfall", "station_id", "NULL", "n") + " FROM top")
    base = W.replace("FROM events)", f"FROM events {where})")
    return (
        f"{base}, g AS (SELECT {_GLOBAL} FROM w), hot AS (SELECT {_HOT}), cold AS (SELECT {_COLD}), busy AS (SELECT * FROM (SELECT {_INTERVAL}) ORDER BY n DESC, \"interval\" LIMIT 1), "
        f"top AS ({_TOP.format(_STATIONS + ' GROUP BY station_id', k)})\n" + "SELECT line, key, coalesce(value, 0) AS value, coalesce(rain, 0) AS rain, coalesce(station_id, 0) AS station_id, coalesce(\"at\", 0) AS \"at\", coalesce(n, 0) AS n FROM (\n" + "\nUNION ALL ".join(parts) + ")"
    )


def weather_partial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global aggregate from the partials of eight parts."""
    events = _table(spark, sf_dir, "events")
    parted = as_weather(events.select("*")).withColumn("part", F.pmod(F.xxhash64("timestamp", "station_id", *MEASURES), F.lit(8)))
    return weather.merge(*weather.partials(parted, "part"))[0]


def weather_partial_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = _w(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("timestamp", "station_id", *MEASURES), F.lit(8)))
    return weather.merge(*weather.partials(parted, "part"))[2]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as a line of text; every seventh event gives a malformed line, a blank one or a header besides."""
    events = _table(spark, sf_dir, "events")
    w = as_weather(events)
    text = w.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in WEATHER.names)).alias("value"))
    odd = events.where("event_id % 7 = 0").select(F.element_at(F.array(F.lit("10 10 10"), F.lit(" "), F.lit("1 2 3 4 5 6 x"), F.lit("1 2 3 4 5 6"), F.lit("1 2 3 4 5 6 NaN")), (F.col("event_id") % 5 + 1).cast("int")).alias("value"))
    return text.unionByName(odd)


def weather_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.global_metrics(weather_source.records(_lines(spark, sf_dir)))


def weather_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather_source.malformed(_lines(spark, sf_dir))


def _stream_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over one of the driver's Parquet tables, whole."""
    schema = _table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir.rstrip('/')}/{name}.parquet*")


def _streamed(spark: SparkSession, result: DataFrame, keys: list[str]) -> DataFrame:
    """The result of a stateful stream once it has taken what there is, as executors have written it."""
    table = ChangeTable(spark, shared.scratch(spark, "stream"), result.schema, keys)
    table.fold(result).awaitTermination()
    return table.read()


def _stream_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, weather_stream.grouped(as_weather(_stream_source(spark, sf_dir, "events"))), ["level", "interval", "station_id"])


def weather_stream_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _stream_groups(spark, sf_dir).where("level = 3").drop("interval", "station_id", "level")
    return one.withColumns({f"avg_{m}": F.col(f"sum_{m}") / F.col("n") for m in MEASURES})


def weather_stream_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_groups(spark, sf_dir).where("level = 2").select("station_id", "n", "sum_temperature", "sum_rainfall")


def weather_stream_busiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_groups(spark, sf_dir).where("level = 1").select("interval", "n").orderBy(F.desc("n"), "interval").limit(1)


def weather_whole_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as numbers among junk bytes, records running over lines and lines over records; read by ranges of a few kilobytes."""
    w = as_weather(_table(spark, sf_dir, "events"))
    between = lambda k: F.element_at(F.array(*map(F.lit, (" ", "; ", "\n", "\t|", " x\n#"))), (F.pmod(F.xxhash64("timestamp", "station_id", F.lit(k)), F.lit(5)) + 1).cast("int"))
    parts = [x for k, c in enumerate(WEATHER.names) for x in (F.col(c).cast("decimal(20,1)").cast("string") if k > 1 else F.col(c).cast("string"), between(k))]
    path = shared.scratch(spark, "buffer")
    w.select(F.concat(*parts).alias("value")).write.option("lineSep", " ").text(path)
    return weather.global_metrics(numbers.scan(spark, path, WEATHER, skip=0, range_bytes=4096))


def weather_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live report of a replay in batches of a quarter of the records, in the order of time."""
    folder = shared.scratch(spark, "replay")
    rows = replay.prepare(_w(spark, sf_dir), folder, 20_000)
    live = weather_stream.LiveReport(spark, shared.scratch(spark, "live"))
    query = live.ingest(replay.replayed(spark, folder, live.checkpoint, batch_size=max(1, -(-rows // 4))), every="0 seconds")
    try:
        live.drain(3600)
    finally:
        query.stop()
    return live.view().whole


def weather_live_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one view of a live report says of all records: as a whole, and summed over its stations and over its intervals."""
    live = weather_stream.LiveReport(spark, shared.scratch(spark, "live"))
    live.ingest(as_weather(_stream_source(spark, sf_dir, "events"))).awaitTermination()
    view = live.view()
    level = lambda name, df: df.agg(F.sum("n").alias("n"), F.count("*").alias("groups")).select(F.lit(name).alias("level"), "n", "groups")
    return level("whole", view.whole).unionByName(level("station", view.stations)).unionByName(level("interval", view.intervals))


def weather_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by station in the state store after two batches of half the events each, and what either batch changed."""
    folder, events = shared.scratch(spark, "halves"), _table(spark, sf_dir, "events")
    stream = None
    for half in (0, 1):
        part = as_weather(events.where(F.col("event_id") % 3 == 0 if half else F.col("event_id") % 3 != 0)).select("station_id")
        part.coalesce(1).write.mode("append").parquet(folder)
        if stream is None:
            stream = spark.readStream.schema(part.schema).parquet(folder).groupBy("station_id").count()
            kept = ChangeTable(spark, shared.scratch(spark, "state"), stream.schema, ["station_id"])
        kept.fold(stream).awaitTermination()
    state = weather_stream.state_of(spark, kept.checkpoint).select(F.lit("state").alias("kind"), "key.station_id", F.col("value.count").alias("n"), F.lit(1).cast("long").alias("batch"))
    changes = weather_stream.state_changes(spark, kept.checkpoint, 0, 1).select(F.lit("change").alias("kind"), "key.station_id", F.col("value.count").alias("n"), F.col("batch_id").cast("long").alias("batch"))
    return state.unionByName(changes)


def live_counters_by_worker(spark: SparkSession, sf_dir: str, workers: int = 4) -> DataFrame:
    """Batches of 500 events dealt round robin: records and batches of each worker."""
    batch = F.expr("event_id div 500")
    dealt = _table(spark, sf_dir, "events").select(batch.alias("batch"), (batch % workers).alias("worker"))
    return dealt.groupBy("worker").agg(F.count("*").alias("records"), F.countDistinct("batch").alias("batches"))


# --- matrices -----------------------------------------------------------------


def cells_of(embeddings: DataFrame, rows: int | None = 64) -> DataFrame:
    """Coordinates of hundredfold, rounded embeddings; rows keeps the first of them, as many as the inner index has values, for a right operand."""
    out = embeddings.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), F.round(F.col("x").cast("double") * 100).alias("v"))
    return out if rows is None else out.where(F.col("i") < rows)


M = """WITH every AS (SELECT vec_id AS i, CAST(unnest(range(0, len(embedding))) AS BIGINT) AS j, unnest(embedding) AS x FROM embeddings),
c AS (SELECT i, j, round(CAST(x AS DOUBLE) * 100) AS v FROM every), m AS (SELECT * FROM c WHERE i < 64)
"""
_PRODUCT = "SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {} a JOIN {} b ON a.j = b.i GROUP BY a.i, b.j HAVING sum(a.v * b.v) <> 0"


def _m(spark: SparkSession, sf_dir: str, rows: int | None = 64) -> DataFrame:
    return cells_of(_table(spark, sf_dir, "embeddings"), rows)


def _as_text(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.array_join(F.transform("row", lambda v: v.cast("long").cast("string")), " ").alias("line"))


def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.product(_m(spark, sf_dir, None), _m(spark, sf_dir))


def matrix_product_dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _m(spark, sf_dir, None)
    return _as_text(matrix.to_rows(matrix.product(left, _m(spark, sf_dir)), matrix.dims(left).first()["rows"], 64))


def matrix_product_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same product with both sides shuffled on the inner index."""
    return matrix.product(_m(spark, sf_dir, None), _m(spark, sf_dir), broadcast_cells=0)


def matrix_to_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda x: F.round(x.cast("double") * 100)).alias("row"))
    return matrix.from_rows(rows)


def matrix_to_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _m(spark, sf_dir, None)
    return _as_text(matrix.to_rows(cells.where("v > 0"), matrix.dims(cells).first()["rows"], 64))


def _dense_files(spark: SparkSession, sf_dir: str) -> str:
    """The whole matrix as dense text in several files, rows in order, with blank lines between."""
    path = shared.scratch(spark, "dense")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("long").cast("string")), " ").alias("line"))
    ordered = rows.repartitionByRange(5, "vec_id").sortWithinPartitions("vec_id")
    ordered.select(F.when(F.col("vec_id") % 10 == 0, F.concat(F.lit("\n \t\n"), "line")).otherwise(F.col("line")).alias("value")).write.text(path)
    return path


def matrix_dense_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of dense files whose rows are numbered over all files."""
    return matrices.read_dense(spark, _dense_files(spark, sf_dir))[0]


def matrix_files_of_both_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product whose left side is read from dense files and whose right side from sparse ones, each told by its first line."""
    sparse = shared.scratch(spark, "sparse")
    render.write_sparse(_m(spark, sf_dir), sparse)
    return matrix.product(matrices.read(spark, _dense_files(spark, sf_dir)), matrices.read(spark, sparse))


def matrix_dense_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense files read twice as one matrix: the rows of the second follow those of the first."""
    path = _dense_files(spark, sf_dir)
    return matrices.read(spark, path, path)


def matrix_sparse_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells as the sparse sink writes them, read back line by line."""
    path = shared.scratch(spark, "sink")
    render.write_sparse(_m(spark, sf_dir, None), path)
    cells = F.split("value", "\t")
    return spark.read.text(path).select(cells[0].cast("long").alias("i"), cells[1].cast("long").alias("j"), cells[2].cast("double").alias("v"))


def matrix_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix by its transpose-shaped square part, by tiles, with one dense row put in; nothing is broadcast."""
    left = _m(spark, sf_dir, None)
    dense = spark.range(64).select(F.lit(-1).cast("long").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    return matrix.tiled_product(left.unionByName(dense).withColumn("i", F.col("i") + 1), _m(spark, sf_dir), 16)


def matrix_encoded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells from texts `i:j:v`; every fifth is a setting `K=i` and every seventh lacks a part, which are left out."""
    text = F.when(F.col("i") % 5 == 4, F.concat(F.lit("K="), "i")).when((F.col("i") + F.col("j")) % 7 == 6, F.concat_ws(":", "i", "v")).otherwise(F.concat_ws(":", "i", "j", F.col("v").cast("string")))
    cell = parts_of(F.col("text"), ["long", "long", "double"])
    found = _m(spark, sf_dir, None).select(text.alias("text")).select(cell.alias("c"), setting(F.col("text"), "K").cast("long").alias("k"))
    return found.where("c is not null or k is not null").select(F.coalesce("c.p0", "k").alias("i"), F.col("c.p1").alias("j"), F.col("c.p2").alias("v"))


def matrix_dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the matrix and its square part, and whether they can be multiplied in either order."""
    a, b = matrix.dims(_m(spark, sf_dir, None)).toDF("m", "n"), matrix.dims(_m(spark, sf_dir)).toDF("p", "q")
    return a.crossJoin(F.broadcast(b)).select("m", "n", "p", "q", (F.col("n") == F.col("p")).alias("fits"), (F.col("q") == F.col("m")).alias("fits_turned"))  # one row each


# --- documents ----------------------------------------------------------------


def as_ops(conversations: DataFrame) -> DataFrame:
    """Operations from conversations: turn 0 creates, later turns insert; some positions lie outside, a repeated turn 0 is refused."""
    place = F.expr("(conv_id * 7 + turn * 131) % (turn * 700 + 2) - case when conv_id % 5 = 0 then 1 else 0 end")
    return conversations.select(
        F.col("turn").alias("seq"), F.when(F.col("turn") == 0, "create").otherwise("insert").alias("op"), F.col("conv_id").cast("string").alias("name"),
        place.alias("position"), F.coalesce("text", F.lit("")).alias("text"), (F.col("conv_id") % 3).alias("edited_by"),
    )


D = """WITH RECURSIVE ops AS (SELECT conv_id, turn AS seq, coalesce(text, '') AS text, conv_id % 3 AS edited_by,
  (conv_id * 7 + turn * 131) % (turn * 700 + 2) - CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS position, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
fold AS (
  SELECT conv_id, k, seq, edited_by, 'create' AS op, 'CREATED' AS status, text AS content, CAST(1 AS BIGINT) AS version FROM ops WHERE k = 1
  UNION ALL
  SELECT o.conv_id, o.k, o.seq, o.edited_by, 'insert', CASE WHEN o.position BETWEEN 0 AND length(f.content) THEN 'APPLIED' ELSE 'OUT_OF_RANGE' END,
    CASE WHEN o.position BETWEEN 0 AND length(f.content) THEN substring(f.content, 1, o.position) || o.text || substring(f.content, o.position + 1) ELSE f.content END,
    f.version + CASE WHEN o.position BETWEEN 0 AND length(f.content) THEN 1 ELSE 0 END
  FROM fold f JOIN ops o ON o.conv_id = f.conv_id AND o.k = f.k + 1)
"""
_FINAL = D + ", r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS back FROM fold) SELECT CAST(conv_id AS VARCHAR) AS name, content, version FROM r WHERE back = 1"


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ops(_table(spark, sf_dir, "conversations"))


def docs_stream_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, document_stream.states(as_ops(_stream_source(spark, sf_dir, "conversations"))), ["name"])


def docs_checkpointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final states from a checkpoint after the operations of the first two turns and those that follow."""
    ops = _ops(spark, sf_dir)
    since = shared.stored(documents.final_state(ops.where("seq < 2")), "states")
    return documents.final_state(ops.where("seq >= 2"), since)


def docs_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscriber who comes after the first two turns is told: the state then, and each later version in order."""
    ops = _ops(spark, sf_dir)
    history = shared.stored(documents.history(ops), "history")
    then = documents.latest(history.where("seq < 2")).select("name", "version", "content", F.lit(True).alias("snapshot"))
    later = history.where("seq >= 2").select("name", "version", "content", F.lit(False).alias("snapshot"))
    return then.unionByName(later)


def docs_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.listing(documents.final_state(_ops(spark, sf_dir)))


def docs_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names asked for, half of them unknown, with the document's length or NOT_FOUND."""
    stored = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    asked = _table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).cast("string").alias("name"))
    found = asked.join(stored, "name", "left")
    return found.select("name", F.when(F.col("text").isNull(), "NOT_FOUND").otherwise("OK").alias("status"), F.coalesce(F.char_length("text").cast("long"), F.lit(-1)).alias("length"))


def docs_feed_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a feed whose versions go back now and then; what a reader keeps."""
    feed = _table(spark, sf_dir, "conversations").select(F.col("turn").alias("seq"), F.col("conv_id").cast("string").alias("name"), F.expr("turn - case when (conv_id + turn) % 3 = 0 then 2 else 0 end").alias("version"))
    return documents.monotone(feed)


def docs_create_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn creates a document: two conversations share a name padded with blanks, tabs or other spaces, every fourth turn's name is blank."""
    pad = F.element_at(F.array(*map(F.lit, ("  ", "\t", " \u00a0\n", "\u2003"))), (F.col("conv_id") % 4 + 1).cast("int"))
    name = F.when(F.col("turn") % 4 == 3, pad).otherwise(F.concat(pad, F.expr("conv_id div 2"), F.lit("\t ")))
    ops = _table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit("create").alias("op"), name.alias("name"), F.lit(0).cast("long").alias("position"), F.coalesce("text", F.lit("")).alias("text"), (F.col("conv_id") % 3).alias("edited_by"),
    )
    return documents.outcomes(ops).select("seq", "name", "status")


# --- benchmark logs -----------------------------------------------------------


def as_log(lineitem: DataFrame) -> DataFrame:
    """A stream benchmark's log from lineitem: time is the quantity, throughput its inverse in grid steps."""
    workers = F.element_at(F.array(*(F.lit(w).cast("long") for w in (1, 2, 4, 8))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return lineitem.select((F.col("l_partkey") % 3).alias("records"), workers.alias("workers"), (F.col("l_linenumber") % 3).cast("long").alias("batch_size"), F.col("l_orderkey").alias("rep"), F.col("l_quantity").alias("elapsed_s"), (F.lit(6400.0) - F.col("l_quantity") * 64).alias("recs_per_s"))


L = """WITH log AS (SELECT l_partkey % 3 AS records, CAST([1, 2, 4, 8][l_suppkey % 4 + 1] AS BIGINT) AS workers, CAST(l_linenumber % 3 AS BIGINT) AS batch_size,
  l_orderkey AS rep, l_quantity AS elapsed_s, 6400 - l_quantity * 64 AS recs_per_s FROM lineitem)
"""
_CONFIG = ["records", "workers", "batch_size"]
_MEDIANS = "SELECT records, workers, batch_size, CAST(count(*) AS BIGINT) AS reps, median({0}) AS median, min({0}) AS best, max({0}) AS worst, median({0}) - min({0}) AS below, max({0}) - median({0}) AS above FROM log GROUP BY 1, 2, 3"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(_table(spark, sf_dir, "lineitem"))


def bench_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = benchlog.medians(_log(spark, sf_dir), _CONFIG, "recs_per_s").select(*_CONFIG, "median")
    return benchlog.speedups(summary, ["records", "batch_size"], "workers", "median")


def bench_best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = benchlog.medians(_log(spark, sf_dir), _CONFIG, "recs_per_s")
    return benchlog.best_configuration(summary, ["records"], ["workers", "batch_size"], "median")


def bench_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the planned workers 1 to 16 for each size and batch, what the log has not."""
    log = _log(spark, sf_dir)
    sizes = log.select("records", "batch_size").distinct()
    planned = sizes.select("records", "batch_size", F.explode(F.array(*(F.lit(w).cast("long") for w in (1, 2, 4, 8, 16)))).alias("workers"))
    return benchlog.still_to_run(planned, log, _CONFIG)


QUERIES = {
    "weather_total": lambda s, d: weather.global_metrics(_w(s, d)).select("n"),
    "weather_avg": lambda s, d: weather.global_metrics(_w(s, d)).select(*(f"avg_{m}" for m in MEASURES)),
    "weather_min": lambda s, d: weather.global_metrics(_w(s, d)).select(*(f"min_{m}" for m in MEASURES)),
    "weather_max": lambda s, d: weather.global_metrics(_w(s, d)).select(*(f"max_{m}" for m in MEASURES)),
    "weather_rain_total": lambda s, d: weather.global_metrics(_w(s, d)).select("sum_rainfall"),
    "weather_extreme_events": lambda s, d: weather.global_metrics(_w(s, d)).select("extreme"),
    "weather_hottest": lambda s, d: weather.hottest(_w(s, d)),
    "weather_coldest": lambda s, d: weather.coldest(_w(s, d)),
    "weather_interval_histogram": lambda s, d: weather.interval_histogram(_w(s, d)),
    "weather_busiest_interval": lambda s, d: weather.busiest_interval(_w(s, d)),
    "weather_station_stats": lambda s, d: weather.station_stats(_w(s, d)),
    "weather_top_stations": lambda s, d: weather.top_stations(_w(s, d), 10),
    "weather_top_stations_bounded": lambda s, d: weather.top_stations(_w(s, d), 10, 50),
    "weather_report": lambda s, d: weather.report(_w(s, d), 10).fillna(0),
    "weather_empty_report": lambda s, d: weather.report(_w(s, d).where("false"), 10).fillna(0),
    "weather_partial_merge": weather_partial_merge,
    "weather_partial_stations": weather_partial_stations,
    "weather_from_text": weather_from_text,
    "weather_malformed": weather_malformed,
    "weather_stream_final": weather_stream_final,
    "weather_stream_stations": weather_stream_stations,
    "weather_stream_busiest": weather_stream_busiest,
    "weather_whole_buffer": weather_whole_buffer,
    "weather_replay": weather_replay,
    "weather_live_levels": weather_live_levels,
    "weather_state_changes": weather_state_changes,
    "live_counters_by_worker": live_counters_by_worker,
    "matrix_dense_file": matrix_dense_file,
    "matrix_files_of_both_formats": matrix_files_of_both_formats,
    "matrix_dense_union": matrix_dense_union,
    "matrix_sparse_sink": matrix_sparse_sink,
    "matrix_tiles": matrix_tiles,
    "matrix_dimension_check": matrix_dimension_check,
    "matrix_encoded_cells": matrix_encoded_cells,
    "docs_checkpointed": docs_checkpointed,
    "docs_subscription": docs_subscription,
    "matrix_product": matrix_product,
    "matrix_product_shuffled": matrix_product_shuffled,
    "matrix_product_dense_rows": matrix_product_dense_rows,
    "matrix_to_sparse": matrix_to_sparse,
    "matrix_to_dense": matrix_to_dense,
    "matrix_dims": lambda s, d: matrix.dims(_m(s, d, None)),
    "matrix_reducer_count": lambda s, d: matrix.reducer_count(_m(s, d, None)),
    "matrix_single_row": lambda s, d: matrix.product(_m(s, d).where("i = 0"), _m(s, d)),
    "matrix_single_column": lambda s, d: matrix.product(_m(s, d, None), _m(s, d).where("j = 0")),
    "matrix_row_times_vector": lambda s, d: matrix.product(_m(s, d).where("i = 0"), _m(s, d).where("j = 0")),
    "matrix_sum_duplicates": lambda s, d: matrix.checked(_m(s, d, None).select((F.col("i") % 16).alias("i"), "j", "v"), "sum"),
    "docs_final_state": lambda s, d: documents.final_state(_ops(s, d)),
    "docs_version_history": lambda s, d: documents.history(_ops(s, d)),
    "docs_rejected_edits": lambda s, d: documents.rejected(_ops(s, d)),
    "docs_latest": lambda s, d: documents.latest(documents.history(_ops(s, d))),
    "docs_list": docs_list,
    "docs_lookup": docs_lookup,
    "docs_feed_monotone": docs_feed_monotone,
    "docs_create_outcomes": docs_create_outcomes,
    "docs_stream_final": docs_stream_final,
    "docs_session_stats": lambda s, d: documents.session_stats(documents.outcomes(_ops(s, d))),
    "bench_median": lambda s, d: benchlog.medians(_log(s, d), _CONFIG, "elapsed_s"),
    "bench_speedup": bench_speedup,
    "bench_best_config": bench_best_config,
    "bench_latest": lambda s, d: benchlog.latest(_log(s, d), ["workers"], "rep", ["batch_size", "elapsed_s"]),
    "bench_resume": bench_resume,
    "bench_placement": lambda s, d: benchlog.placement(_table(s, d, "lineitem").select(F.concat(F.lit("host"), F.col("l_suppkey") % 5).alias("host"))),
}


def _columns(*names: str) -> str:
    return f"{W}SELECT {', '.join(names)} FROM (SELECT {_GLOBAL} FROM w)"


_DENSE = """, spine AS (SELECT r.i, s.range AS j FROM (SELECT unnest(range((SELECT max(i) + 1 FROM c))) AS i) r, range(64) s)
SELECT spine.i, string_agg(CAST(CAST(coalesce(p.v, 0) AS BIGINT) AS VARCHAR), ' ' ORDER BY spine.j) AS line FROM spine LEFT JOIN p USING (i, j) GROUP BY spine.i"""

ORACLE_SQL = {
    "weather_total": _columns("n"),
    "weather_avg": _columns(*(f"avg_{m}" for m in MEASURES)),
    "weather_min": _columns(*(f"min_{m}" for m in MEASURES)),
    "weather_max": _columns(*(f"max_{m}" for m in MEASURES)),
    "weather_rain_total": _columns("sum_rainfall"),
    "weather_extreme_events": _columns("extreme"),
    "weather_hottest": f"{W}SELECT {_HOT}",
    "weather_coldest": f"{W}SELECT {_COLD}",
    "weather_interval_histogram": f"{W}SELECT {_INTERVAL}",
    "weather_busiest_interval": f'{W}SELECT * FROM (SELECT {_INTERVAL}) ORDER BY n DESC, "interval" LIMIT 1',
    "weather_station_stats": f"{W}{_STATIONS} GROUP BY station_id",
    "weather_top_stations": W + _TOP.format(_STATIONS + " GROUP BY station_id", 10),
    "weather_top_stations_bounded": W + _TOP.format(_STATIONS + " WHERE station_id BETWEEN 0 AND 49 GROUP BY station_id", 10),
    "weather_report": _report_sql("", 10),
    "weather_empty_report": _report_sql("WHERE false", 10),
    "weather_partial_merge": _columns("*"),
    "weather_partial_stations": f"{W}{_STATIONS} GROUP BY station_id",
    "weather_from_text": _columns("*"),
    "weather_malformed": "SELECT CAST(count(*) FILTER (WHERE event_id % 7 = 0 AND event_id % 5 >= 2) AS BIGINT) AS malformed FROM events",
    "weather_stream_final": _columns("*"),
    "weather_stream_stations": f"{W}{_STATIONS} GROUP BY station_id",
    "weather_stream_busiest": f'{W}SELECT * FROM (SELECT {_INTERVAL}) ORDER BY n DESC, "interval" LIMIT 1',
    "weather_whole_buffer": _columns("*"),
    "weather_replay": _columns("*"),
    "weather_live_levels": f"""{W}, s AS (SELECT station_id, count(*) AS n FROM w GROUP BY 1), i AS (SELECT {_INTERVAL})
SELECT 'whole' AS level, CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS groups FROM w
UNION ALL SELECT 'station', CAST(sum(n) AS BIGINT), CAST(count(*) AS BIGINT) FROM s UNION ALL SELECT 'interval', CAST(sum(n) AS BIGINT), CAST(count(*) AS BIGINT) FROM i""",
    "weather_state_changes": """WITH c AS (SELECT user_id AS station_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE event_id % 3 <> 0) AS BIGINT) AS first, count(*) FILTER (WHERE event_id % 3 = 0) AS second FROM events GROUP BY 1)
SELECT 'state' AS kind, station_id, n, CAST(1 AS BIGINT) AS batch FROM c UNION ALL SELECT 'change', station_id, first, 0 FROM c WHERE first > 0 UNION ALL SELECT 'change', station_id, n, 1 FROM c WHERE second > 0""",
    "matrix_dense_file": M + "SELECT i, j, v FROM c WHERE v <> 0",
    "matrix_files_of_both_formats": M + _PRODUCT.format("c", "m"),
    "matrix_dense_union": M + "SELECT i, j, v FROM c WHERE v <> 0 UNION ALL SELECT i + (SELECT max(i) + 1 FROM c), j, v FROM c WHERE v <> 0",
    "matrix_sparse_sink": M + "SELECT i, j, v FROM c WHERE v <> 0",
    "matrix_tiles": M + ", l AS (SELECT i + 1 AS i, j, v FROM c UNION ALL SELECT 0, range, 1 FROM range(64)) " + _PRODUCT.format("l", "m"),
    "matrix_dimension_check": M + "SELECT *, n = p AS fits, q = m AS fits_turned FROM (SELECT max(i) + 1 AS m, max(j) + 1 AS n FROM c), (SELECT max(i) + 1 AS p, max(j) + 1 AS q FROM m)",
    "matrix_encoded_cells": M + "SELECT i, CASE WHEN i % 5 <> 4 THEN j END AS j, CASE WHEN i % 5 <> 4 THEN v END AS v FROM c WHERE i % 5 = 4 OR (i + j) % 7 <> 6",
    "docs_checkpointed": _FINAL,
    "docs_subscription": D + """, v AS (SELECT CAST(conv_id AS VARCHAR) AS name, version, content, seq, status FROM fold WHERE status <> 'OUT_OF_RANGE'),
t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS back FROM v WHERE seq < 2)
SELECT name, version, content, true AS snapshot FROM t WHERE back = 1 UNION ALL SELECT name, version, content, false FROM v WHERE seq >= 2""",
    "live_counters_by_worker": "SELECT event_id // 500 % 4 AS worker, CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT event_id // 500) AS BIGINT) AS batches FROM events GROUP BY 1",
    "matrix_product": M + _PRODUCT.format("c", "m"),
    "matrix_product_shuffled": M + _PRODUCT.format("c", "m"),
    "matrix_product_dense_rows": M + ", p AS (" + _PRODUCT.format("c", "m") + ")" + _DENSE,
    "matrix_to_sparse": M + "SELECT i, j, v FROM c WHERE v <> 0",
    "matrix_to_dense": M + ", p AS (SELECT * FROM c WHERE v > 0)" + _DENSE,
    "matrix_dims": M + "SELECT max(i) + 1 AS rows, max(j) + 1 AS columns FROM c",
    "matrix_reducer_count": M + "SELECT CAST(least(64, greatest(1, count(DISTINCT i))) AS BIGINT) AS reducers FROM c",
    "matrix_single_row": M + _PRODUCT.format("(SELECT * FROM m WHERE i = 0)", "m"),
    "matrix_single_column": M + _PRODUCT.format("c", "(SELECT * FROM m WHERE j = 0)"),
    "matrix_row_times_vector": M + _PRODUCT.format("(SELECT * FROM m WHERE i = 0)", "(SELECT * FROM m WHERE j = 0)"),
    "matrix_sum_duplicates": M + "SELECT i % 16 AS i, j, sum(v) AS v FROM c GROUP BY 1, 2",
    "docs_final_state": _FINAL,
    "docs_version_history": D + "SELECT CAST(conv_id AS VARCHAR) AS name, version, content, edited_by, seq FROM fold WHERE status <> 'OUT_OF_RANGE'",
    "docs_rejected_edits": D + "SELECT seq, CAST(conv_id AS VARCHAR) AS name, op, status FROM fold WHERE status = 'OUT_OF_RANGE'",
    "docs_latest": _FINAL,
    "docs_list": f"SELECT name, version, CAST(length(content) AS BIGINT) AS length FROM ({_FINAL})",
    "docs_lookup": "SELECT CAST(a.doc_id * 2 AS VARCHAR) AS name, CASE WHEN b.text IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status, coalesce(CAST(length(b.text) AS BIGINT), -1) AS length FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id * 2",
    "docs_feed_monotone": """WITH feed AS (SELECT turn AS seq, CAST(conv_id AS VARCHAR) AS name, turn - CASE WHEN (conv_id + turn) % 3 = 0 THEN 2 ELSE 0 END AS version FROM conversations),
s AS (SELECT *, max(version) OVER (PARTITION BY name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM feed)
SELECT seq, name, version FROM s WHERE seen IS NULL OR version > seen""",
    "docs_create_outcomes": """WITH o AS (SELECT conv_id * 1000 + turn AS seq, CASE WHEN turn % 4 = 3 THEN '' ELSE CAST(conv_id // 2 AS VARCHAR) END AS name FROM conversations)
SELECT seq, name, CASE WHEN name = '' THEN 'INVALID_ARGUMENT' WHEN row_number() OVER (PARTITION BY name ORDER BY seq) = 1 THEN 'CREATED' ELSE 'ALREADY_EXISTS' END AS status FROM o""",
    "docs_stream_final": _FINAL,
    "docs_session_stats": D + "SELECT edited_by, CAST(count(*) AS BIGINT) AS commands, CAST(count(*) FILTER (WHERE status <> 'OUT_OF_RANGE') AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE status = 'OUT_OF_RANGE') AS BIGINT) AS refused, CAST(count(DISTINCT conv_id) AS BIGINT) AS documents FROM fold GROUP BY edited_by",
    "bench_median": L + _MEDIANS.format("elapsed_s"),
    "bench_speedup": L + f", s AS ({_MEDIANS.format('recs_per_s')}) SELECT a.records, a.workers, a.batch_size, a.median, a.median / b.median AS ratio FROM s a LEFT JOIN s b ON b.workers = 1 AND a.records = b.records AND a.batch_size = b.batch_size",
    "bench_best_config": L + f", s AS ({_MEDIANS.format('recs_per_s')}), r AS (SELECT *, row_number() OVER (PARTITION BY records ORDER BY median DESC, workers, batch_size) AS k FROM s) SELECT records, workers, batch_size, median FROM r WHERE k = 1",
    "bench_latest": L + ", r AS (SELECT *, row_number() OVER (PARTITION BY workers ORDER BY rep DESC, batch_size DESC, elapsed_s DESC) AS k FROM log) SELECT workers, rep, batch_size, elapsed_s FROM r WHERE k = 1",
    "bench_resume": L + ", p AS (SELECT DISTINCT records, batch_size, unnest([1, 2, 4, 8, 16]) AS workers FROM log) SELECT records, CAST(workers AS BIGINT) AS workers, batch_size FROM p ANTI JOIN log USING (records, workers, batch_size)",
    "bench_placement": "SELECT 'host' || (l_suppkey % 5) AS host, CAST(count(*) AS BIGINT) AS tasks FROM lineitem GROUP BY 1",
}
