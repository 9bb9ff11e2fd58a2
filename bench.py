"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import functions as F

from tessera import queries, session
from tessera.operators import matrix, weather
from tessera.sources import matrices, weather as weather_source

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Runs of each query after a first one that compiles it and is not counted; the median counts.
REPEAT = 3
HEADLINE = [
    "weather_report", "weather_interval_histogram", "weather_top_stations", "weather_from_text", "weather_stream_final", "matrix_product",
    "matrix_product_dense_rows", "docs_final_state", "docs_version_history", "docs_stream_final", "bench_median", "bench_speedup",
]


def main() -> None:
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = session.session(
        "bench", spark__master=f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=f"{folder}/shared"
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds: dict[str, float] = {}

    def timed(name, run) -> None:
        run()
        runs = []
        for _ in range(REPEAT):
            began = time.time()
            run()
            runs.append(time.time() - began)
        seconds[name] = round(sorted(runs)[REPEAT // 2], 3)

    for name in HEADLINE:
        timed(name, lambda f=queries.QUERIES[name]: f(spark, SF_DIR).write.format("noop").mode("overwrite").save())
    # the published sizes: a million records on 500 stations, as Parquet and as text, and a 400 by 400 product
    records = weather_source.synthetic(spark, 1_000_000, 500)
    records.write.parquet(f"{folder}/w")
    records.select(F.concat_ws(" ", *records.columns).alias("value")).write.text(f"{folder}/t")
    timed("report_1m_parquet", lambda: weather.report(spark.read.parquet(f"{folder}/w")).collect())
    timed("report_1m_text", lambda: weather.report(weather_source.read_weather(spark, f"{folder}/t")[1]).collect())
    a, b = (spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "i long, row array<double>") for m in matrices.generated(400, 400, 400, 42))
    for name, m in (("a", a), ("b", b)):
        matrix.from_rows(m).write.parquet(f"{folder}/{name}")
    timed("matrix_400", lambda: matrix.product(spark.read.parquet(f"{folder}/a"), spark.read.parquet(f"{folder}/b")).write.format("noop").mode("overwrite").save())
    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    sys.exit(main())
