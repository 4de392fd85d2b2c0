"""Statistics of timed runs and scaling laws over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import fmt


def spread(x: Column) -> dict[str, Column]:
    """Mean, exact median, least, greatest and sample deviation (0 for one value) of a group."""
    return {"mean": F.avg(x), "median": F.median(x), "min": F.min(x), "max": F.max(x), "stddev": F.coalesce(F.stddev_samp(x), F.lit(0.0))}


def describe(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(x).alias("runs"), *[c.alias(k) for k, c in spread(x).items()])


def results(runs: DataFrame) -> DataFrame:
    """One row per file in the columns of RESULTS, from the timed runs: seconds, ns per output, and the largest memory growth."""
    s = F.col("dur_ns") / 1e9
    own = {k: F.round(c, 9) for k, c in spread(s).items()}
    out = runs.groupBy("filename").agg(
        F.max("vertices").alias("vertices"), F.max("triangulations").cast("decimal(38,0)").alias("triangulations"),
        *[own[k].alias(f"{k}Time") for k in ("mean", "median", "min", "max", "stddev")],
        F.avg(s).alias("_mean"), F.max(F.greatest(F.col("mem_after") - F.col("mem_before"), F.lit(0))).alias("peakMemory"),
    )
    per = F.bround(fmt.ratio(F.col("_mean"), F.col("triangulations"), 1e9), 0).alias("perTriangNs")
    times = [f"{k}Time" for k in ("mean", "median", "min", "max", "stddev")]
    return out.select("filename", "vertices", "triangulations", *times, per, "peakMemory", F.round(fmt.ratio(F.col("peakMemory"), F.col("vertices")), 6).alias("memoryPerVertex"))


def power_law(df: DataFrame, x: Column, y: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """slope and intercept of log10 y on log10 x by least squares, rows with x, y > 0."""
    fit = df.where((x > 0) & (y > 0)).groupBy(*keys)
    return fit.agg(F.regr_slope(F.log10(y), F.log10(x)).alias("slope"), F.regr_intercept(F.log10(y), F.log10(x)).alias("intercept"))


def envelope(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """The power law's slope and intercept, and the largest and smallest y relative to it; the law is one row, sent to all."""
    law = power_law(df, x, y)
    both = df.where((x > 0) & (y > 0)).select(x.cast("double").alias("x"), y.cast("double").alias("y")).join(F.broadcast(law), F.lit(True))
    over = F.col("y") / F.pow(F.lit(10.0), F.col("intercept") + F.col("slope") * F.log10("x"))
    return both.groupBy("slope", "intercept").agg(F.max(over).alias("upper"), F.min(over).alias("lower"))


def success_rates(df: DataFrame, successful: str, total: str) -> Column:
    return fmt.ratio(F.col(successful), F.col(total), 100.0)


def resume(inputs: DataFrame, done: DataFrame, key: str = "filename") -> DataFrame:
    """Inputs that have no result yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    from pyspark.sql.window import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
