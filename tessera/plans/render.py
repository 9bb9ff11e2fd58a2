"""Text of reports and matrices, formatted in Python from a few collected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import matrix, weather


def report(records: DataFrame, k: int = weather.DEFAULT_K, stations: int | None = None) -> str:
    """The report's fixed lines and its top stations, six decimals throughout."""
    rows = weather.report(records, k, stations).collect()
    lines, top = {}, []
    for r in rows:
        if r["key"] == "TOP_STATIONS":
            top.append(r)
        elif r["key"] == "BUSIEST_INTERVAL":
            lines[r["line"]] = f"{r['key']} {r['at']} {r['n']}"
        elif r["at"] is not None:
            lines[r["line"]] = f"{r['key']} {r['value']:.6f} {r['station_id']} {r['at']}"
        elif r["n"] is not None:
            lines[r["line"]] = f"{r['key']} {r['n']}"
        else:
            lines[r["line"]] = f"{r['key']} {r['value']:.6f}"
    top.sort(key=lambda r: (-r["n"], r["station_id"]))
    out = [lines[n] for n in sorted(lines)] + ["TOP_STATIONS"]
    out += [f"{r['station_id']} {r['n']} {r['value']:.6f} {r['rain']:.6f}" for r in top]
    return "\n".join(out) + "\n"


def number(value: float) -> str:
    """Ten significant digits, without trailing zeros or a negative zero."""
    return f"{value + 0.0:.10g}"


def dense(cells: DataFrame, rows: int, columns: int) -> str:
    """A line of numbers for each row."""
    held = matrix.to_rows(cells, rows, columns).orderBy("i").toLocalIterator()
    return "".join(" ".join(map(number, r["row"])) + "\n" for r in held)


def sparse(cells: DataFrame) -> str:
    """A line i, j, v for each nonzero cell in row-major order."""
    held = matrix.row_major(cells.where("v <> 0")).toLocalIterator()
    return "".join(f"{r['i']}\t{r['j']}\t{number(r['v'])}\n" for r in held)


def write_dense(cells: DataFrame, rows: int, columns: int, path: str) -> None:
    """The lines as text files in row order, written where they are made; numbers as Spark prints them."""
    line = F.array_join(F.transform("row", lambda v: v.cast("string")), " ")
    matrix.to_rows(cells, rows, columns).orderBy("i").select(line.alias("value")).write.text(path)


def write_sparse(cells: DataFrame, path: str) -> None:
    matrix.row_major(cells.where("v <> 0")).write.csv(path, sep="\t")


def dashboard(summary: dict, text: str, workers: str = "") -> str:
    """Counters of a live stream and its workers above its report."""
    head = [f"{key:<22}{summary[key]}" for key in ("records", "batches", "records_per_second", "active") if key in summary]
    return "\n".join([*head, "", *([workers, ""] if workers else []), text])
