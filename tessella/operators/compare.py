"""Comparison of result bags: equality, containment and classified differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import fmt


def multiplicities(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For every distinct row how often each side has it: one shuffle on the row, whatever the bag sizes."""
    side = lambda df, l, r: df.select(*keys, F.lit(l).alias("l"), F.lit(r).alias("r"))  # noqa: E731,E741
    return side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def bag_diff(engine: DataFrame, oracle: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label (MATCH, EXTRA or MISSING) and n: how many instances of the row are on both sides, or on one only."""
    m = multiplicities(engine, oracle, keys)
    parts = F.array(
        F.struct(F.lit("MATCH").alias("label"), F.least("n_left", "n_right").alias("n")),
        F.struct(F.lit("EXTRA").alias("label"), F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0)).alias("n")),
        F.struct(F.lit("MISSING").alias("label"), F.greatest(F.col("n_right") - F.col("n_left"), F.lit(0)).alias("n")),
    )
    return m.select(*keys, F.inline(parts)).where("n > 0")


def summary(engine: DataFrame, oracle: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """Per ``by``: both totals, matches, extras, missing, ratio, and both verdicts.

    ``contained`` is MATCHED where the oracle's bag is within the engine's, extras allowed; ``equal`` where both are the same.
    """
    m = multiplicities(engine, oracle, [by, *keys])
    total = m.groupBy(by).agg(
        F.sum("n_left").alias("engine_total"), F.sum("n_right").alias("oracle_total"), F.sum(F.least("n_left", "n_right")).alias("matches"),
        F.sum(F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0))).alias("extra"), F.sum(F.greatest(F.col("n_right") - F.col("n_left"), F.lit(0))).alias("missing"),
    )
    return total.withColumns({
        "ratio": F.round(fmt.ratio(F.col("engine_total"), F.col("oracle_total")), 4),
        "contained": fmt.status(F.col("missing") == 0),
        "equal": fmt.status((F.col("missing") == 0) & (F.col("extra") == 0)),
    })


def positional(left: DataFrame, right: DataFrame, by: str, row: str) -> DataFrame:
    """Per ``by``: equal position by position after sorting both lists, which is to have every row equally often; nothing is sorted."""
    return multiplicities(left, right, [by, row]).groupBy(by).agg(F.min(F.col("n_left") == F.col("n_right")).alias("equal"))


def search_report(counters: DataFrame) -> DataFrame:
    """The report's 13 columns from filename, engine_total, oracle_total, checks, successful, invalid and missing."""
    c = lambda name: F.col(name)
    traversals: Column = c("invalid") + c("engine_total")
    return counters.select(
        c("filename").alias("Filename"), c("engine_total").alias("Algo Total"), c("oracle_total").alias("Brute Force Total"),
        F.round(fmt.ratio(c("engine_total"), c("oracle_total")), 4).alias("Ratio (Algo/BF)"),
        c("checks").alias("Total Checks"), c("successful").alias("Successful Checks"), (c("checks") - c("successful")).alias("Failed Checks"),
        F.round(fmt.ratio(c("successful"), c("checks"), 100.0), 2).alias("Check Success Rate (%)"),
        traversals.alias("Total Traversals"), c("engine_total").alias("Successful Traversals"), c("invalid").alias("Invalid Traversals"),
        F.round(fmt.ratio(c("engine_total"), traversals, 100.0), 2).alias("Traversal Success Rate (%)"),
        fmt.status(c("missing") == 0).alias("Status"),
    )
