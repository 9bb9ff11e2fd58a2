"""The sensor report: counts, sums, averages, extremes, busiest interval, top stations.

Every operator takes a DataFrame with the columns of schema.WEATHER and stays
inside built-in aggregates.  Keyed aggregates hold fixed-width buffers, so they
run as hash aggregates with a partial step before the shuffle; the two extreme
readings compare structs and are computed without a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import interval_of, is_extreme
from tessera.schema import MEASURES

#: Rows of the top list where neither data nor caller say otherwise.
DEFAULT_K = 10


def check_k(k: int) -> int:
    if k < 0:
        raise ValueError("k must not be negative")
    return k


def global_metrics(records: DataFrame) -> DataFrame:
    """One row: n, sum_*, avg_*, min_*, max_* of every measure and extreme, the number of extreme temperatures.  Empty input: n and extreme 0, the rest null."""
    per = [f(m).alias(f"{name}_{m}") for name, f in (("sum", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max)) for m in MEASURES]
    return records.agg(F.count("*").alias("n"), *per, F.count_if(is_extreme(F.col("temperature"))).alias("extreme"))


def _extreme(order: Column) -> Column:
    """Of the reading with the largest order: t, -timestamp, -station and temperature; the smallest time, then station, of equals."""
    return F.max(F.struct(order.alias("t"), (-F.col("timestamp")).alias("ts"), (-F.col("station_id")).alias("id"), F.col("temperature").alias("temperature")))


def _reading(records: DataFrame, order: Column) -> DataFrame:
    return records.agg(_extreme(order).alias("b")).where("b is not null").select(F.col("b.temperature").alias("temperature"), (-F.col("b.ts")).alias("timestamp"), (-F.col("b.id")).alias("station_id"))


def hottest(records: DataFrame) -> DataFrame:
    """The reading with the largest temperature; then the smallest time, then the smallest station.  No row for empty input."""
    return _reading(records, F.col("temperature"))


def coldest(records: DataFrame) -> DataFrame:
    """The reading with the smallest temperature; then the smallest time, then the smallest station.  No row for empty input."""
    return _reading(records, -F.col("temperature"))


def interval_histogram(records: DataFrame) -> DataFrame:
    """(interval, n) by minute."""
    return records.groupBy(interval_of(F.col("timestamp")).alias("interval")).agg(F.count("*").alias("n"))


def busiest_interval(records: DataFrame) -> DataFrame:
    """The interval with the most records, the smaller one of equals."""
    return interval_histogram(records).orderBy(F.desc("n"), "interval").limit(1)


def within(records: DataFrame, stations: int | None) -> DataFrame:
    """Records of stations 0 to stations - 1; all of them for None."""
    return records if stations is None else records.where(F.col("station_id").between(0, stations - 1))


def station_stats(records: DataFrame, stations: int | None = None) -> DataFrame:
    """(station_id, n, sum_temperature, sum_rainfall)."""
    return within(records, stations).groupBy("station_id").agg(F.count("*").alias("n"), F.sum("temperature").alias("sum_temperature"), F.sum("rainfall").alias("sum_rainfall"))


def top_stations(records: DataFrame, k: int = DEFAULT_K, stations: int | None = None) -> DataFrame:
    """The k stations with the most records, smaller ids first among equals, with average temperature and total rainfall."""
    top = station_stats(records, stations).orderBy(F.desc("n"), "station_id").limit(check_k(k))
    return top.select("station_id", "n", (F.col("sum_temperature") / F.col("n")).alias("avg_temperature"), "sum_rainfall")


def _levels(records: DataFrame, stations: int | None) -> DataFrame:
    """Aggregates over all (level 3), by interval (1) and by station (2) from one scan.

    The columns pass a generator, which keeps them together: each use of the
    result then has the same exchange below it, and Spark runs it once.
    """
    bound = "true" if stations is None else f"station_id BETWEEN 0 AND {int(stations) - 1}"
    keyed = records.select(interval_of(F.col("timestamp")).alias("interval"), F.expr(f"CASE WHEN {bound} THEN station_id END AS station_id"), F.expr(f"{bound} AS inside"), *MEASURES)
    sets = keyed.groupingSets([[], ["interval"], ["station_id", "inside"]], "interval", "station_id", "inside")
    per = [f"{f}({m}) AS {f}_{m}" for f in ("sum", "avg", "min", "max") for m in MEASURES]
    made = sets.agg(F.grouping_id().alias("id"), F.expr("count(*) AS n"), *map(F.expr, per), F.count(F.when(is_extreme(F.col("temperature")), 1)).alias("extreme"))
    rest = ", ".join(c for c in made.columns if c != "id")
    return made.selectExpr(f"inline(array(struct(CASE id WHEN 7 THEN 3 WHEN 3 THEN 1 ELSE 2 END AS level, {rest})))")


#: Lines of the report that are one number: name, the aggregate, and whether it is a count; fixed values.
SINGLES = [
    ("TOTAL_MEASUREMENTS", "n", True),
    *((f"{name}_{m.upper()}", f"{f}_{m}", False) for m in MEASURES[:3] for name, f in (("AVERAGE", "avg"), ("MIN", "min"), ("MAX", "max"))),
    ("TOTAL_RAINFALL", "sum_rainfall", False), ("MAX_RAINFALL", "max_rainfall", False), ("AVERAGE_WIND_SPEED", "avg_wind_speed", False), ("MAX_WIND_SPEED", "max_wind_speed", False),
    ("EXTREME_TEMPERATURE_EVENTS", "extreme", True),
]
_LINE = "struct({} AS line, '{}' AS key, cast({} AS double) AS value, cast(NULL AS double) AS rain, cast({} AS long) AS station_id, cast({} AS long) AS at, cast({} AS long) AS n)"


def report(records: DataFrame, k: int = DEFAULT_K, stations: int | None = None) -> DataFrame:
    """The whole report as rows (line, key, value, rain, station_id, at, n): at is a time or an interval.  Empty input has zeros and busiest interval -1.

    Two scans: one for all that is summed, one for the two extreme readings.
    """
    levels, last = _levels(records, stations), len(SINGLES)
    wanted = ", ".join(c for _, c, _ in SINGLES)
    found = levels.agg(F.expr(f"max(struct({wanted})) FILTER (WHERE level = 3) AS g"), F.expr("max(struct(n, -interval AS i)) FILTER (WHERE level = 1) AS b"))  # a row for empty input too
    lines = [_LINE.format(line, key, *("NULL", "NULL", "NULL", f"coalesce(g.{c}, 0)") if count else (f"coalesce(g.{c}, 0)", "NULL", "NULL", "NULL")) for line, (key, c, count) in enumerate(SINGLES)]
    lines.append(_LINE.format(last + 2, "BUSIEST_INTERVAL", "NULL", "NULL", "coalesce(-b.i, -1)", "coalesce(b.n, 0)"))
    out = found.selectExpr(f"inline(array({', '.join(lines)}))")
    both = records.agg(_extreme(F.col("temperature")).alias("hot"), _extreme(-F.col("temperature")).alias("cold"))
    ends = [_LINE.format(last + k_, key, f"coalesce({c}.temperature, 0)", f"coalesce(-{c}.id, 0)", f"coalesce(-{c}.ts, 0)", "NULL") for k_, (key, c) in enumerate((("HOTTEST_MEASUREMENT", "hot"), ("COLDEST_MEASUREMENT", "cold")))]
    out = out.unionByName(both.selectExpr(f"inline(array({', '.join(ends)}))"))
    top = levels.where("level = 2 and inside").orderBy(F.desc("n"), "station_id").limit(check_k(k))
    return out.unionByName(top.selectExpr(f"{last + 3} AS line", "'TOP_STATIONS' AS key", "sum_temperature / n AS value", "sum_rainfall AS rain", "station_id", "cast(NULL AS long) AS at", "n"))


# --- partial aggregates -------------------------------------------------------


def partials(records: DataFrame, *by: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(global, by interval, by station) aggregates for each value of the columns by; merge() adds them up again."""
    sums = [F.sum(m).alias(f"sum_{m}") for m in MEASURES]
    ends = [f(m).alias(f"{name}_{m}") for name, f in (("min", F.min), ("max", F.max)) for m in MEASURES]
    one = records.groupBy(*by).agg(F.count("*").alias("n"), *sums, *ends, F.count_if(is_extreme(F.col("temperature"))).alias("extreme"))
    intervals = records.groupBy(*by, interval_of(F.col("timestamp")).alias("interval")).agg(F.count("*").alias("n"))
    stations = records.groupBy(*by, "station_id").agg(F.count("*").alias("n"), F.sum("temperature").alias("sum_temperature"), F.sum("rainfall").alias("sum_rainfall"))
    return one, intervals, stations


def merge(one: DataFrame, intervals: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The aggregates of all parts together: the same rows as partials() of all records, with averages."""
    sums = [F.sum(f"sum_{m}").alias(f"sum_{m}") for m in MEASURES]
    ends = [f(f"{name}_{m}").alias(f"{name}_{m}") for name, f in (("min", F.min), ("max", F.max)) for m in MEASURES]
    whole = one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *sums, *ends, F.coalesce(F.sum("extreme"), F.lit(0)).alias("extreme"))
    whole = whole.withColumns({f"avg_{m}": F.try_divide(F.col(f"sum_{m}"), F.col("n")) for m in MEASURES})
    return (
        whole,
        intervals.groupBy("interval").agg(F.sum("n").alias("n")),
        stations.groupBy("station_id").agg(F.sum("n").alias("n"), F.sum("sum_temperature").alias("sum_temperature"), F.sum("sum_rainfall").alias("sum_rainfall")),
    )
