import duckdb
import pytest

import __spark_entry__ as entry
from tessera import queries

SMALL = "/root/testdata/sf0.001"
TABLES = ["events", "embeddings", "conversations", "documents", "lineitem"]


def test_names_agree():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 18


@pytest.mark.parametrize("name", ["weather_report", "weather_from_text", "weather_stream_final", "matrix_product_dense_rows", "docs_final_state", "docs_stream_final", "bench_speedup"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, SMALL)
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(ours.columns)
    assert sorted(map(repr, map(tuple, ours.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
