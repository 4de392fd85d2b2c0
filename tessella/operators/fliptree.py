"""The flip graph and the genealogical tree of a polygon's triangulations, by positions, as columns and relations.

Input rows have n and index_chords (sorted structs i < j). The root is the fan at position 0. A blocking chord has position 0 as its
outer third corner; the leftmost one is that with the largest smaller end b. The parent flips it, and the
children flip the chords (0, j) with j >= b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import edges as E


def _pair(c: Column) -> Column:
    return F.struct(c["i"].alias("i"), c["j"].alias("j"))


def flipped(chords: Column, c: Column) -> Column:
    """The triangulation after the chord of ``c`` (with k_in, k_out) gives way to its opposite pair."""
    new = F.struct(F.least(c["k_in"], c["k_out"]).alias("i"), F.greatest(c["k_in"], c["k_out"]).alias("j"))
    return F.array_sort(F.concat(F.filter(chords, lambda d: (d["i"] != c["i"]) | (d["j"] != c["j"])), F.array(new)))


def with_apexes(tri: DataFrame) -> DataFrame:
    return tri.withColumn("apexes", E.apexes(F.col("index_chords"), F.col("n")))


def flip_neighbors(tri: DataFrame) -> DataFrame:
    """One row per triangulation and chord: chord, opposite and neighbor."""
    out = with_apexes(tri).withColumn("flip", F.explode("apexes")).drop("apexes")
    c = F.col("flip")
    opposite = F.struct(F.least(c["k_in"], c["k_out"]).alias("i"), F.greatest(c["k_in"], c["k_out"]).alias("j"))
    return out.withColumns({"chord": _pair(c), "opposite": opposite, "neighbor": flipped(F.col("index_chords"), c)}).drop("flip")


def blocking(apexes: Column) -> Column:
    return F.filter(apexes, lambda c: (c["i"] > 0) & (c["k_out"] == 0))


def leftmost(apexes: Column) -> Column:
    """The leftmost blocking chord, null at the root."""
    found = F.array_sort(F.transform(blocking(apexes), lambda c: F.struct(c["i"], c["j"], c["k_in"], c["k_out"])))
    return F.get(found, F.size(found) - 1)


def generating_set(apexes: Column) -> Column:
    """Chords of position 0 from the leftmost blocking chord's smaller end on."""
    b = F.coalesce(F.array_max(F.transform(blocking(apexes), lambda c: c["i"])), F.lit(0))
    return F.filter(apexes, lambda c: (c["i"] == 0) & (c["j"] >= b))


def valid_generating_set(apexes: Column, face: Column, present: Column) -> Column:
    """Those of the generating set whose opposite pair, by vertices, is neither an edge of the graph nor a chord in use."""
    used = E.labelled(face, apexes)
    opposite = lambda c: E.edge(F.get(face, c["k_in"]), F.get(face, c["k_out"]))
    return F.filter(generating_set(apexes), lambda c: ~F.array_contains(present, opposite(c)) & ~F.array_contains(used, opposite(c)))


def tree(tri: DataFrame) -> DataFrame:
    """depth, parent (null at the root) and n_children of every triangulation."""
    out = with_apexes(tri)
    at = leftmost(F.col("apexes"))
    root_chords = F.size(F.filter("index_chords", lambda c: c["i"] == 0))
    return out.withColumns(
        {"depth": F.col("n") - 3 - root_chords, "parent": F.when(at.isNotNull(), flipped(F.col("index_chords"), at)), "n_children": F.size(generating_set(F.col("apexes")))}
    ).drop("apexes")


def children(tri: DataFrame) -> DataFrame:
    """One row per triangulation and child."""
    out = with_apexes(tri).withColumn("flip", F.explode(generating_set(F.col("apexes")))).drop("apexes")
    return out.withColumn("child", flipped(F.col("index_chords"), F.col("flip"))).drop("flip")


def degrees(chords: Column, n: Column) -> Column:
    """Degree of every position, sides of the polygon included."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda v: F.size(F.filter(chords, lambda c: (c["i"] == v) | (c["j"] == v))) + 2)


def canonical_degrees(chords: Column, n: Column) -> Column:
    """The greatest degree sequence under rotation and reflection; equal exactly for triangulations alike up to relabelling."""
    own = degrees(chords, n)
    turns = lambda d: F.transform(F.sequence(F.lit(0), n - 1), lambda r: E.rotated(d, r))
    return F.array_max(F.concat(turns(own), turns(F.reverse(own))))


def unlabelled(tri: DataFrame, *keys: str) -> DataFrame:
    """Classes of triangulations under rotation and reflection, with their sizes."""
    return tri.groupBy(*keys, "n", canonical_degrees(F.col("index_chords"), F.col("n")).alias("degrees")).agg(F.count(F.lit(1)).alias("members"))
