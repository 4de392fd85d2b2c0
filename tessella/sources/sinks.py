"""Writers of results, reports and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import edges as E
from tessella.functions import fmt


def result_lines(rows: DataFrame) -> DataFrame:
    """Text lines of one graph's triangulations: a header with their number, then one line each."""
    head = rows.agg(F.concat(F.lit("Total triangulations in biconnected component: "), F.count(F.lit(1)).cast("string")).alias("value"))
    return head.withColumn("_o", F.lit(0)).unionByName(rows.select(E.chord_text(F.col("chords")).alias("value"), F.lit(1).alias("_o"))).orderBy("_o", "value").select("value")


def write_results(rows: DataFrame, path: str) -> None:
    result_lines(rows).write.mode("overwrite").text(path)


def diff_lines(diff: DataFrame, status: str) -> DataFrame:
    """Lines [MATCH], [EXTRA] and [MISSING] of a bag difference over ``row``, one per instance, and the status last."""
    each = diff.select(F.concat(F.lit("["), "label", F.lit("] "), "row").alias("value"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("value")
    return each.unionByName(diff.sparkSession.createDataFrame([(f"[STATUS] {status}",)], "value string"))


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").csv(path, header=True)


def rewrite_csv(rows: DataFrame, path: str, key: str = "filename") -> None:
    """One sorted file; for result tables, which have a row per input file."""
    rows.orderBy(key).coalesce(1).write.mode("overwrite").csv(path, header=True)


def trace_rows(series: DataFrame, start_micros: int) -> DataFrame:
    """Trace columns from graph_id, n, elapsed, incremental and cumulative_avg."""
    return series.select(
        "graph_id", F.col("n").cast("long").alias("triangulation_n"), fmt.wall_clock(F.lit(start_micros), F.col("elapsed")).alias("wall_clock"),
        F.col("elapsed").alias("elapsed_since_start_ns"), F.col("incremental").alias("incremental_ns"), F.col("cumulative_avg").alias("cumulative_avg_ns"),
    )


def write_traces(series: DataFrame, path: str, start_micros: int) -> None:
    """One folder per graph."""
    trace_rows(series, start_micros).repartition("graph_id").sortWithinPartitions("graph_id", "triangulation_n").write.mode("append").partitionBy("graph_id").csv(path, header=True)


def console_table(results: DataFrame) -> DataFrame:
    """Results as short texts, with bands for time and memory."""
    return results.select(
        fmt.short(F.col("filename")).alias("name"), "vertices", "triangulations", fmt.fixed(F.col("meanTime"), 6).alias("mean"), fmt.fixed(F.col("perTriangNs"), 0).alias("ns"),
        fmt.format_bytes(F.col("peakMemory")).alias("memory"), fmt.time_band(F.col("meanTime")).alias("time_band"), fmt.memory_band(F.col("memoryPerVertex")).alias("memory_band"),
    )


def chart_series(results: DataFrame) -> DataFrame:
    """The one row that a report page needs: labels (quotes plain) and numbers in file order. Result tables have a row per input file."""
    row = F.struct("filename", fmt.plain_quotes(F.col("filename")).alias("label"), "meanTime", "medianTime", "minTime", "perTriangNs")
    rows = F.array_sort(F.collect_list(row))
    column = lambda c: F.transform(rows, lambda r: r[c]).alias(c)
    return results.agg(*[column(c) for c in ("label", "meanTime", "medianTime", "minTime", "perTriangNs")])
