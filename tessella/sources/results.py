"""Result files and traces in CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import fmt
from tessella.model import RESULTS, TRACE


def read_previous(spark: SparkSession, path: str) -> DataFrame:
    """Earlier results: malformed rows are dropped, and of a file's rows the first in reading order counts."""
    rows = spark.read.csv(path, schema=RESULTS, header=True, mode="DROPMALFORMED").where(F.col("filename").isNotNull() & F.col("vertices").isNotNull())
    at = rows.withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    order = Window.partitionBy("filename").orderBy("_at")
    return at.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_at", "_r")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of any age: an old ``avgTime`` stands for the mean, and the mean for statistics that are missing."""
    rows = spark.read.csv(path, header=True)
    have = set(rows.columns)
    mean = F.coalesce(*[F.col(c).cast("double") for c in ("meanTime", "avgTime") if c in have] or [F.lit(None).cast("double")])
    or_mean = lambda c: F.coalesce(F.col(c).cast("double"), mean) if c in have else mean
    own = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    deviation = F.coalesce(F.col("stddevTime").cast("double"), F.lit(0.0)) if "stddevTime" in have else F.lit(0.0)
    return rows.select(
        "filename", own("vertices", "int"), own("triangulations", "decimal(38,0)"), mean.alias("meanTime"),
        *[or_mean(c).alias(c) for c in ("medianTime", "minTime", "maxTime")], deviation.alias("stddevTime"), own("peakMemory", "long"),
    )


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """All traces under a folder with the file's stem as label, sorted by it; a missing average is the running mean."""
    rows = spark.read.csv(path, schema=TRACE, header=True).select(fmt.stem(F.col("_metadata.file_path")).alias("label"), "*")
    w = Window.partitionBy("label").orderBy("triangulation_n").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("incremental_ns").over(w) / F.col("triangulation_n")
    return rows.withColumn("avg_ms", F.coalesce(F.col("cumulative_avg_ns").cast("double"), running) / 1e6)


def pending(inputs: DataFrame, done: DataFrame, key: str = "graph_id") -> DataFrame:
    """Inputs whose output does not exist yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")
