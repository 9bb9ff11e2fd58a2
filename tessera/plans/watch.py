"""Watching a live report from its folder: `python -m tessera.plans.watch FOLDER [--once | --watch SECONDS] [--csv FILE]`."""

from __future__ import annotations

import argparse
import csv
import time
from collections.abc import Callable
from pathlib import Path

from tessera.operators.weather import DEFAULT_K
from tessera.plans import metrics, render
from tessera.schema import MEASURES
from tessera.session import session
from tessera.streaming.weather import LiveReport

COUNTERS = ("records", "batches", "elapsed_s", "records_per_second", "active")


def text(live: LiveReport) -> str:
    """Totals, averages, busiest interval and top stations of the batches so far."""
    view = live.view()
    one = view.whole.first()
    lines = [f"TOTAL_MEASUREMENTS {one['n']}", *(f"AVERAGE_{m.upper()} {one[f'avg_{m}'] or 0.0:.6f}" for m in MEASURES)]
    lines += [f"BUSIEST_INTERVAL {r['interval']} {r['n']}" for r in view.busiest_interval().collect()]
    top = [f"{r['station_id']} {r['n']} {r['avg_temperature']:.6f} {r['sum_rainfall']:.6f}" for r in view.top_stations(live.k).collect()]
    return "\n".join([*lines, "TOP_STATIONS", *top]) + "\n"


def append_counters(path: str, summary: dict, now: float | None = None) -> None:
    """Adds a line of counters to a local CSV file, after a header where the file is new."""
    new = not Path(path).exists()
    with Path(path).open("a", newline="") as out:
        lines = csv.writer(out)
        if new:
            lines.writerow(["unix_time", *COUNTERS])
        lines.writerow([f"{time.time() if now is None else now:.3f}", *(summary[c] for c in COUNTERS)])


def watch(live: LiveReport, seconds: float | None = None, counters: str | None = None, show: Callable[[str], None] = print, times: int | None = None) -> None:
    """Shows the report once, or every so many seconds until interrupted or shown so many times."""
    shown = 0
    while True:
        summary = live.summary()
        workers = metrics.worker_table(metrics.workers(live.spark))
        show(render.dashboard(summary, text(live) if summary["batches"] else "nothing was ingested\n", workers))
        if counters:
            append_counters(counters, summary)
        shown += 1
        if seconds is None or shown == times:
            return
        time.sleep(seconds)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("--watch", type=float, default=2.0, metavar="SECONDS")
    parser.add_argument("--once", action="store_true")
    parser.add_argument("--csv")
    parser.add_argument("--k", type=int, default=DEFAULT_K)
    args = parser.parse_args(argv)
    watch(LiveReport(session("watch"), args.folder, args.k), None if args.once else args.watch, args.csv)


if __name__ == "__main__":
    main()
