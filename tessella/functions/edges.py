"""Column functions on faces (array of vertices) and chords (structs a, b). Positions in a face count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_EDGES = "array<struct<a:int,b:int>>"


def edge(x: Column, y: Column) -> Column:
    """The unordered pair of two vertices."""
    return F.struct(F.least(x, y).cast("int").alias("a"), F.greatest(x, y).cast("int").alias("b"))


def no_edges() -> Column:
    return F.array().cast(EMPTY_EDGES)


def face_edges(face: Column) -> Column:
    """The edges of a face in order, the closing one included; none for an empty face."""
    n = F.size(face)
    walk = F.transform(F.sequence(F.lit(0), n - 1), lambda i: edge(F.get(face, i), F.get(face, (i + 1) % n)))
    return F.when(n > 0, walk).otherwise(no_edges())


def boundary(faces: Column) -> Column:
    """The distinct edges of all faces of a graph."""
    return F.array_distinct(F.flatten(F.transform(faces, face_edges)))


def distinct_vertices(faces: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(faces)))


def rotated(face: Column, root: Column) -> Column:
    """The face from position ``root`` on, around."""
    n = F.size(face)
    return F.concat(F.slice(face, root + 1, n - root), F.slice(face, F.lit(1), root))


def labelled(face: Column, chords: Column) -> Column:
    """Chords between positions (i, j) as chords between vertices."""
    return F.transform(chords, lambda c: edge(F.get(face, c["i"]), F.get(face, c["j"])))


def root_fan(n: Column) -> Column:
    """The chords (0, j) of the fan at position 0."""
    return F.when(n >= 4, F.transform(F.sequence(F.lit(2), n - 2), lambda j: F.struct(F.lit(0).alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))


def safe_root(face: Column, present: Column, high: bool = True) -> Column:
    """Where a fan meets no present edge: two pointers close a gap by one in each of exactly max(0, n - 3) steps."""
    n = F.size(face)
    steps = F.when(n > 3, F.sequence(F.lit(1), n - 3)).otherwise(F.array().cast("array<int>"))
    start = F.struct(*((n - 1, F.lit(1)) if high else (F.lit(0), n - 2)))
    start = F.struct(start["col1"].cast("int").alias("s"), start["col2"].cast("int").alias("e"))

    def step(acc: Column, _: Column) -> Column:
        met = F.array_contains(present, edge(F.get(face, acc["s"]), F.get(face, acc["e"])))
        ds, de = (-1, 1) if high else (1, -1)
        return F.struct(F.when(met, acc["s"] + ds).otherwise(acc["s"]).cast("int").alias("s"), F.when(met, acc["e"]).otherwise(acc["e"] + de).cast("int").alias("e"))

    return F.aggregate(steps, start, step)["s"]


def no_self_loop(chords: Column) -> Column:
    return F.forall(chords, lambda c: c["a"] != c["b"])


def avoids(chords: Column, present: Column) -> Column:
    """No chord is a present edge."""
    return ~F.exists(chords, lambda c: F.array_contains(present, c))


def all_distinct(chords: Column) -> Column:
    return F.size(F.array_distinct(chords)) == F.size(chords)


def valid(chords: Column, present: Column) -> Column:
    """The validity filter of a whole row: no self loop, no present edge, no chord twice."""
    return no_self_loop(chords) & avoids(chords, present) & all_distinct(chords)


def chord_text(chords: Column) -> Column:
    """``(a, b) , `` for each chord."""
    return F.array_join(F.transform(chords, lambda c: F.format_string("(%d, %d) , ", c["a"], c["b"])), "")


def apexes(chords: Column, n: Column) -> Column:
    """For each chord (i, j) of a triangulation by positions: the third corners k_in (between) and k_out of its two triangles."""
    last = n - 1

    def joined(x: Column, y: Column) -> Column:
        lo, hi = F.least(x, y), F.greatest(x, y)
        return (hi - lo == 1) | ((lo == 0) & (hi == last)) | F.exists(chords, lambda d: (d["i"] == lo) & (d["j"] == hi))

    def both(c: Column) -> Column:
        corner = lambda k: joined(c["i"], k) & joined(c["j"], k)
        inside = F.filter(F.sequence(c["i"] + 1, c["j"] - 1), corner)
        outside = F.filter(F.sequence(F.lit(0), last), lambda k: ((k < c["i"]) | (k > c["j"])) & corner(k))
        return F.struct(c["i"].alias("i"), c["j"].alias("j"), F.get(inside, F.lit(0)).alias("k_in"), F.get(outside, F.lit(0)).alias("k_out"))

    return F.transform(chords, both)
