"""Timed runs of actions: the rows that the benchmark statistics take."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.model import RUNS


def resident_bytes() -> int:
    """Resident memory of this process, 0 where the system does not tell."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096
    except OSError:
        return 0


def timed(action: Callable[[], int], runs: int) -> list[tuple[int, int, int, int, int]]:
    """(run, nanoseconds, memory before, memory after, result) of each run; one more goes first and is dropped if there are several."""
    if runs > 1:
        action()
    rows = []
    for k in range(1, runs + 1):
        before, began = resident_bytes(), time.perf_counter_ns()
        got = action()
        rows.append((k, time.perf_counter_ns() - began, before, resident_bytes(), got))
    return rows


def run_table(spark: SparkSession, actions: dict[str, tuple[Callable[[], int], int, int]]) -> DataFrame:
    """RUNS rows of named actions, each with its number of vertices and of runs; an action returns its number of results."""
    rows = [(name, k, ns, before, after, vertices, got) for name, (action, vertices, runs) in sorted(actions.items()) for k, ns, before, after, got in timed(action, runs)]
    return spark.createDataFrame(rows, RUNS)
