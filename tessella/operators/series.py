"""Window functions over timing traces and result series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def incremental(trace: DataFrame, keys: list[str], order: list[str], elapsed: str = "elapsed") -> DataFrame:
    """n, incremental (first less 0), running sum, and cumulative average by floor division."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = trace.withColumns({"n": F.row_number().over(w), "incremental": F.col(elapsed) - F.lag(elapsed, 1, 0).over(w)})
    out = out.withColumn("running", F.sum("incremental").over(upto))
    return out.withColumn("cumulative_avg", F.expr("running div n"))


def first_n(series: DataFrame, keys: list[str], n: int, ordinal: str = "n", value: str = "cumulative_avg") -> DataFrame:
    """Rows up to ordinal ``n`` with the last row's value of the whole series beside them."""
    if n < 1:
        raise ValueError("n is at least 1")
    last = series.groupBy(*keys).agg(F.max_by(value, ordinal).alias("final"), F.max(ordinal).alias("total"))
    return series.where(F.col(ordinal) <= n).join(last, keys)


def smoothed(df: DataFrame, order: list[str], columns: list[str], keys: list[str] | None = None, width: int = 3) -> DataFrame:
    """Centred moving averages, shorter at both ends. Without keys the series is one ordered list: meant for aggregates."""
    half = width // 2
    w = Window.partitionBy(*(keys or [])).orderBy(*order).rowsBetween(-half, half)
    return df.withColumns({f"{c}_smooth": F.avg(c).over(w) for c in columns})


def smoothed_envelope(df: DataFrame, order: list[str], mean: str, dev: str, keys: list[str] | None = None) -> DataFrame:
    """Moving averages of mean, mean + deviation and mean - deviation."""
    out = df.withColumns({"upper": F.col(mean) + F.col(dev), "lower": F.col(mean) - F.col(dev)})
    return smoothed(out, order, [mean, "upper", "lower"], keys)
