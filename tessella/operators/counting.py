"""Counts in closed form: two copies of one cycle, and products over faces that share no chord."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import edges as E

from .combine import count_triangulations

#: Digits of a count.
DIGITS = 38


@lru_cache(None)
def cycle_pairs(n: int) -> int:
    """Ordered pairs of triangulations of an n-gon without a common chord, either orientation of the second.

    A pair is a dissection by its common chords with such a pair in every cell, so squared Catalan numbers are the compositional
    series of the wanted ones; Lagrange inversion of that series gives each count.
    """
    if n < 3:
        raise ValueError("a cycle has at least three vertices")
    if n == 3:
        return 1
    k = n - 1
    squares = [Fraction((comb(2 * m, m) // (m + 1)) ** 2) for m in range(k)]  # f(x) / x
    inverse = [Fraction(1)]
    for i in range(1, k):
        inverse.append(-sum(squares[j] * inverse[i - j] for j in range(1, i + 1)))
    power = [Fraction(1)] + [Fraction(0)] * (k - 1)
    for _ in range(k):
        power = [sum(power[j] * inverse[i - j] for j in range(i + 1)) for i in range(k)]
    return int(-power[k - 1] / k)


def is_cycle_pair(faces):
    """Two faces that are one cycle read from any vertex in either direction, without a repeated vertex."""
    a, b = F.get(faces, F.lit(0)), F.get(faces, F.lit(1))
    same = (F.size(faces) == 2) & (F.size(a) == F.size(b)) & (F.size(F.array_distinct(a)) == F.size(a))
    return same & (F.size(F.array_except(E.face_edges(a), E.face_edges(b))) == 0)


def count_graphs(graphs: DataFrame) -> DataFrame:
    """graph_id and triangulations, by closed form for pairs of one cycle and by masks for all others."""
    cycles = graphs.where(is_cycle_pair(F.col("faces"))).select("graph_id", F.size(F.get("faces", F.lit(0))).alias("n"))
    counts = {r["n"]: cycle_pairs(r["n"]) for r in cycles.select("n").distinct().collect()}  # a row for each size that occurs
    too_large = [n for n, c in counts.items() if c >= 10**DIGITS]
    if too_large:
        raise ValueError(f"pairs of cycles of {min(too_large)} vertices have more triangulations than {DIGITS} digits tell")
    sizes = graphs.sparkSession.createDataFrame([(n, str(c)) for n, c in counts.items()], "n int, t string")
    closed = cycles.join(F.broadcast(sizes), "n", "left").select("graph_id", F.col("t").cast("decimal(38,0)").alias("triangulations"))
    return closed.unionByName(count_triangulations(graphs.where(~is_cycle_pair(F.col("faces")))))

