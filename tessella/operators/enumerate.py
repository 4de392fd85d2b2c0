"""Triangulations of single faces.

A face of n vertices has open interval (0, n-1). A step takes the first open interval (i, j), explodes its apex k, and opens
(i, k) and (k, j) where they are wider than an edge; each opened interval is a new chord. After n - 2 steps every triangulation of
the n-gon has been made exactly once, so nothing is deduplicated, and the steps are narrow: no shuffle, one chain of generators.

Constraints are applied to the step's new chords, so whole subtrees of an invalid choice are never made: a chord that joins equal
labels, is an edge of the graph (both looked up in one table per face), or (in a closed walk) is already a chord of the face.
Intervals are whole numbers, i * 4096 + j, and a step is two projections, which keeps rows and plans small. Faces of any size are
taken: what is made follows what is valid. Every CUT_STEPS steps of a large face the state is checkpointed, which bounds the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import edges as E
from tessella.session import shared_folder

#: Largest face whose intervals can be numbered.
LARGEST = 4095
CUT_STEPS = 16
#: Rows are spread over the cluster after this step when faces are at least this large: one face starts as one row.
SPREAD_STEP, SPREAD_SIZE = 4, 11


def explode_faces(graphs: DataFrame) -> DataFrame:
    """graph_id, face_id, face, n and n_faces; graphs without faces have no row."""
    return graphs.select("graph_id", F.size("faces").alias("n_faces"), F.posexplode("faces").alias("face_id", "face")).withColumn("n", F.size("face"))


def repeats(face: Column) -> Column:
    """A closed walk that comes to a vertex twice."""
    return F.size(F.array_distinct(face)) < F.size(face)


def bounds(faces: DataFrame) -> tuple[int, bool]:
    """The largest face and whether any is a closed walk that repeats a vertex."""
    n, walk = faces.agg(F.max("n"), F.max(repeats(F.col("face")))).first()
    return n or 0, bool(walk)


def triangulate_faces(faces: DataFrame, largest: int | None = None, constrained: bool = True, walks: bool | None = None) -> DataFrame:
    """All triangulations of the faces: input columns without ``present``, chords (by vertices, in order) and index_chords.

    ``largest``: an upper bound of n, and ``walks``: whether vertices may repeat in a face, if known; else they are looked up.
    Unconstrained, validity is not asked for.
    """
    if largest is None or (constrained and walks is None):
        found = bounds(faces)
        largest = found[0] if largest is None else largest
        walks = found[1] if walks is None else walks
    if largest > LARGEST:
        raise ValueError(f"a face has {largest} vertices; intervals are numbered up to {LARGEST}")
    walks = bool(walks) and constrained
    keep = [c for c in faces.columns if c != "present"]
    n = F.col("n")
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    label = lambda i, j: E.edge(F.get("face", i), F.get("face", j))
    free = lambda i, j: (F.get("face", i) != F.get("face", j)) & ~F.array_contains("present", label(i, j))
    ok = F.flatten(F.transform(every, lambda i: F.transform(every, lambda j: free(i, j)))) if constrained else F.lit(None).cast("array<boolean>")
    first = F.transform("face", lambda v: (F.array_position("face", v) - 1).cast("int")) if walks else F.lit(None).cast("array<int>")
    state = faces.select(*keep, ok.alias("_ok"), first.alias("_first"), F.expr("IF(n >= 3, array(n - 1), CAST(array() AS array<int>)) AS _open"), F.expr("CAST(array() AS array<int>) AS _made"), F.expr("CAST(array() AS array<int>) AS _used"))
    for level in range(max(0, largest - 2)):
        state = _step(state, keep, constrained, walks)
        if level + 1 == SPREAD_STEP and largest >= SPREAD_SIZE:
            state = state.repartition(F.col("graph_id"), F.col("face_id"), F.xxhash64("_made"))
        if (level + 1) % CUT_STEPS == 0 and level + 1 < largest - 2:
            shared_folder(state.sparkSession)
            state = state.checkpoint()
    chords = F.array_sort(F.transform("_made", lambda c: label(F.shiftright(c, 12), c.bitwiseAND(4095))))
    index = F.transform(F.array_sort("_made"), lambda c: F.struct(F.shiftright(c, 12).alias("i"), c.bitwiseAND(4095).cast("int").alias("j")))
    return state.select(*keep, chords.alias("chords"), index.alias("index_chords"))


def _step(state: DataFrame, keep: list[str], constrained: bool, walks: bool) -> DataFrame:
    kept = [f"`{c}`" for c in keep]
    hold = [*kept, "_ok", "_first", "_made", "_used"]
    split = state.selectExpr(*hold, "_open", "CAST(IF(size(_open) = 0, 0, shiftright(_open[0], 12)) AS int) AS _i", "CAST(IF(size(_open) = 0, 0, _open[0] & 4095) AS int) AS _j")
    grown = split.selectExpr(*hold, "_i", "_j", "IF(size(_open) = 0, _open, slice(_open, 2, size(_open))) AS _rest", "explode(IF(size(_open) = 0, array(-1), sequence(_i + 1, _j - 1))) AS _k")
    test = "(_k < 0 OR ((_k - _i < 2 OR _ok[_i * n + _k]) AND (_j - _k < 2 OR _ok[_k * n + _j])))" if constrained else "true"
    new = "concat(IF(_k >= 0 AND _k - _i >= 2, array(_i * 4096 + _k), CAST(array() AS array<int>)), IF(_k >= 0 AND _j - _k >= 2, array(_k * 4096 + _j), CAST(array() AS array<int>)))"
    out = grown.where(test).selectExpr(*hold, f"{new} AS _new", "_rest")
    used = "_used"
    if walks:
        marks = "transform(_new, c -> least(_first[shiftright(c, 12)], _first[c & 4095]) * 4096 + greatest(_first[shiftright(c, 12)], _first[c & 4095]))"
        out = out.selectExpr(*hold, "_rest", "_new", f"{marks} AS _marks").where("NOT arrays_overlap(_marks, _used) AND size(array_distinct(_marks)) = size(_marks)")
        used = "concat(_used, _marks) AS _used"
    return out.selectExpr(*kept, "_ok", "_first", "concat(_new, _rest) AS _open", "concat(_made, _new) AS _made", used)

