"""Whole plans: cross-validation of the engine, and benchmark aggregation with resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import benchstats, combine, compare, trace_mode


def cross_validate(graphs: DataFrame, counters: bool = False) -> DataFrame:
    """Engine against brute force per graph; with counters in the columns of the search report."""
    found = compare.summary(combine.triangulate(graphs), combine.brute_force(graphs), "graph_id", ["chords"])
    every = graphs.select("graph_id").join(found, "graph_id", "left").fillna(0).fillna("MATCHED")
    if not counters:
        return every
    both = every.join(trace_mode.trace(graphs), "graph_id")
    return compare.search_report(both.withColumnRenamed("graph_id", "filename"))


def benchmark(runs: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Results of the files that have none yet, followed by the previous ones."""
    todo = benchstats.resume(runs, previous) if previous is not None else runs
    new = benchstats.results(todo)
    return new.unionByName(previous.select(new.columns)) if previous is not None else new.select("*")


def answered(graphs: DataFrame) -> DataFrame:
    """Graphs that have at least one face and no empty one."""
    return graphs.where((F.size("faces") > 0) & F.forall("faces", lambda f: F.size(f) > 0))
