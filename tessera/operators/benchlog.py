"""Analytics over benchmark logs: repetitions, speed-ups, best and latest configurations, what is left to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bins of a round of selection, and rounds.
BINS = 1024
ROUNDS = 1


def _bin(value: Column, low: Column, high: Column) -> Column:
    """The bin of a value between low and high, 0 to BINS - 1; larger values have no smaller bins.  Infinite ends and NaN put all between them into one."""
    share = F.nanvl((value - low) / (high - low), F.lit(0.0))
    inner = F.least(F.greatest(F.floor(share * (BINS - 2)), F.lit(0)), F.lit(BINS - 3)).cast("int") + 1
    return F.when(value == high, BINS - 1).when(value == low, 0).otherwise(inner)


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right of the same keys, nulls alike; without keys right is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"of_{k}" for k in keys})
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys], how).drop(*(f"of_{k}" for k in keys))


def _held(rows: DataFrame, span: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, v) within the span (keys, low, high, ...) of their keys."""
    return _beside(rows, span, keys).where(F.col("v").between(F.col("low"), F.col("high")))


def selected(log: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per keys: rows (with a null value too), n values, the smallest, largest and median one, by selection.

    No group is held or sorted as a whole.  Equal values are counted before they
    are dealt; a round then counts the values of each group by bins, and running
    sums name the bins that hold the middle ranks; what is left between these is
    put in order.
    """
    given, keys = keys, [f"k{n}" for n, _ in enumerate(keys)]
    log = log.select(*(F.col(old).alias(new) for old, new in zip(given, keys, strict=True)), F.col(value).cast("double").alias("v"))
    counts = log.groupBy(*keys, "v").agg(F.count("*").alias("many"))
    ends = counts.groupBy(*keys).agg(F.sum("many").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("many"))), F.lit(0).cast("long")).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    first, second = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")  # the middle ranks, one for odd n
    running = lambda order: F.sum("many").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    span = ends.select(*keys, "n", "low", "high", F.lit(0).cast("long").alias("below"))
    for _ in range(ROUNDS):
        bins = _held(counts, span, keys).withColumn("bin", _bin(F.col("v"), F.col("low"), F.col("high"))).groupBy(*keys, "n", "below", "bin").agg(F.sum("many").alias("many"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = bins.withColumn("upto", F.col("below") + running("bin"))
        middle = upto.where((F.col("upto") >= first) & (F.col("upto") - F.col("many") < second))
        span = middle.groupBy(*keys, "n").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.col("upto") - F.col("many")).alias("below"))
    upto = _held(counts, span, keys).withColumn("upto", F.col("below") + running("v"))
    at = lambda rank: F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("many") < rank), F.col("v")))
    middle = upto.groupBy(*keys).agg((at(first) * 0.5 + at(second) * 0.5).alias("median"))
    both = _beside(ends, middle, keys, "left")
    return both.select(*(F.col(new).alias(old) for old, new in zip(given, keys, strict=True)), "rows", "n", "low", "high", "median")


def medians(log: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per configuration: median, best (smallest), and the distances from the median to both ends."""
    found = selected(log, keys, value)
    out = found.toDF(*keys, "reps", "n", "best", "worst", "median").select(*keys, "reps", "median", "best", "worst")
    return out.withColumns({"below": F.col("median") - F.col("best"), "above": F.col("worst") - F.col("median")})


def speedups(summary: DataFrame, keys: list[str], workers: str, value: str, base: int = 1) -> DataFrame:
    """summary with the ratio of value to that of the row with `base` workers and the same keys; null where there is none."""
    ground = "base"
    while ground in summary.columns:
        ground += "_"
    other = summary.where(F.col(workers) == base).select(*keys, F.col(value).alias(ground))
    return summary.join(other, keys, "left").withColumn("ratio", F.try_divide(F.col(value), F.col(ground))).drop(ground)


def best_configuration(summary: DataFrame, keys: list[str], config: list[str], value: str) -> DataFrame:
    """Per keys the configuration of the largest value; the smallest configuration of equals."""
    first = F.min(F.struct((-F.col(value)).alias("_v"), *config)).alias("b")
    return summary.groupBy(*keys).agg(first).select(*keys, *(F.col(f"b.{c}").alias(c) for c in config), (-F.col("b._v")).alias(value))


def latest(log: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Per keys the columns of the row with the largest order."""
    return log.groupBy(*keys).agg(F.max(F.struct(order, *columns)).alias("b")).select(*keys, F.col(f"b.{order}").alias(order), *(F.col(f"b.{c}").alias(c) for c in columns))


def still_to_run(planned: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Planned configurations of which the log has none."""
    return planned.join(recorded.select(*keys).distinct(), keys, "left_anti")


def placement(tasks: DataFrame) -> DataFrame:
    """Tasks per host."""
    return tasks.groupBy("host").agg(F.count("*").alias("tasks"))
