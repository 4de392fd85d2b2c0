"""Streaming traces: per-key running cost over events as they arrive, and resumable ingestion of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

EVENTS = "graph_id string, elapsed long"
OUT = "graph_id string, n long, elapsed long, incremental long, cumulative_avg long"


def _running(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State of a key: how many outputs, and elapsed time at the last one."""
    n, last = state.get if state.exists else (0, 0)
    events = pd.concat(list(frames)).sort_values("elapsed", kind="stable")["elapsed"].to_numpy()
    rows = []
    for x in events:
        n += 1
        rows.append((key[0], n, int(x), int(x - last), int(x // n)))
        last = int(x)
    state.update((n, last))
    yield pd.DataFrame(rows, columns=["graph_id", "n", "elapsed", "incremental", "cumulative_avg"])


def running_costs(events: DataFrame) -> DataFrame:
    """Trace rows of a stream of (graph_id, elapsed); within a batch events count in order of elapsed."""
    return events.groupBy("graph_id").applyInPandasWithState(_running, OUT, "n long, last long", "append", "NoTimeout")


def read_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Take up all files that are there and stop; run again, it goes on after the last one."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, checkpoint: str, hook: Callable[[DataFrame, int], None]) -> None:
    """Call ``hook`` on the rows of every batch of the files that are there."""
    stream.writeStream.foreachBatch(hook).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_records(stream: DataFrame, key: str = "graph_id") -> DataFrame:
    """Only the first record of each key over the whole stream."""
    return stream.dropDuplicates([key])
