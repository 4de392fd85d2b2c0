"""Triangulations of whole graphs: one per face, joined under the condition that no chord is used twice.

Faces of at most three vertices have one empty triangulation and are left out of the joins. The others are numbered by size
within their graph and joined in that order, many graphs at once, on graph_id with the disjointness of chord masks as the join's
residual condition. A mask numbers only chords that two faces of a graph could both use, 63 to a word; a graph without shared chords
joins on graph_id alone. All that is said of a graph is computed within its row, so only the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import edges as E

from .enumerate import bounds, explode_faces, repeats, triangulate_faces

WORD = 63


def candidate_chords(face: Column) -> Column:
    """The distinct labels of a face's diagonals."""
    n = F.size(face)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.transform(F.filter(F.sequence(i + 2, n - 1), lambda j: (i > 0) | (j < n - 1)), lambda j: E.edge(F.get(face, i), F.get(face, j)))))
    return F.when(n >= 4, F.array_distinct(pairs)).otherwise(E.no_edges())


def shared_chords(faces: Column, present: Column) -> Column:
    """Chords, in order, that two faces may both use and that are no edge of the graph."""
    every = F.array_sort(F.flatten(F.transform(faces, candidate_chords)))
    twice = F.get(F.transform(F.array(every), lambda x: F.filter(x, lambda c, i: c == F.get(x, i + 1))), F.lit(0))
    return F.filter(F.array_except(F.array_distinct(twice), present), lambda c: c["a"] != c["b"])


def _prepared(graphs: DataFrame) -> tuple[DataFrame, int, int, int, bool]:
    """Graphs with present, shared and ranked faces; the most ranked faces, mask words, largest face, and whether walks occur."""
    out = graphs.where(F.size("faces") > 0).select("graph_id", "faces", E.boundary(F.col("faces")).alias("present"))
    ranked = F.array_sort(F.filter(F.transform("faces", lambda f, i: F.struct(F.size(f).alias("n"), i.cast("int").alias("face_id"), f.alias("face"))), lambda x: x["n"] >= 4))
    out = out.select("graph_id", "present", shared_chords(F.col("faces"), F.col("present")).alias("shared"), ranked.alias("ranked"))
    steps, chords, size, walks = out.agg(F.max(F.size("ranked")), F.max(F.size("shared")), F.max(F.array_max(F.transform("ranked", lambda x: x["n"]))), F.max(F.exists("ranked", lambda x: repeats(x["face"])))).first()
    return out, steps or 0, -(-(chords or 0) // WORD), size or 0, bool(walks)


def _mask(word: int) -> Column:
    own = F.slice("shared", word * WORD + 1, WORD)
    bit = lambda c, i: F.when(F.array_contains("chords", c), F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(own, bit), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))


def _face_rows(prepared: DataFrame, words: int, size: int, walks: bool) -> DataFrame:
    """Triangulations of the ranked faces with their masks m0.. ."""
    faces = prepared.select("graph_id", "present", "shared", F.posexplode("ranked").alias("rank", "x")).select("graph_id", "present", "shared", "rank", "x.n", "x.face_id", "x.face")
    tri = triangulate_faces(faces, size, walks=walks)
    return tri.select("graph_id", "rank", "face_id", "chords", *[_mask(w).alias(f"m{w}") for w in range(words)])


def _joined(state: DataFrame, face: DataFrame, k: int, masks: list[str]) -> DataFrame:
    """The state with each triangulation of its face number k that its masks leave free; graphs with fewer faces pass."""
    free = F.lit(True)
    for m in masks:
        free = free & (F.col(m).bitwiseAND(F.col(f"_{m}")) == 0)
    return state.join(face, (F.col("graph_id") == F.col("_g")) & free, "left").where((F.col("n_ranked") <= k) | F.col("_g").isNotNull())


def triangulate(graphs: DataFrame) -> DataFrame:
    """graph_id and chords (faces in input order, sorted within a face): a bag, one row per valid triangulation.

    A graph without a face has no row; one whose faces are all small has the empty row. graph_id is unique.
    """
    prepared, steps, words, size, walks = _prepared(graphs)
    tri, masks = _face_rows(prepared, words, size, walks), [f"m{w}" for w in range(words)]
    parts = F.array().cast("array<struct<face_id:int,chords:array<struct<a:int,b:int>>>>")
    state = prepared.select("graph_id", F.size("ranked").alias("n_ranked"), *[F.lit(0).cast("long").alias(m) for m in masks], parts.alias("parts"))
    for k in range(steps):
        face = tri.where(F.col("rank") == k).select(F.col("graph_id").alias("_g"), F.struct("face_id", "chords").alias("_part"), *[F.col(m).alias(f"_{m}") for m in masks])
        grown = F.when(F.col("_g").isNotNull(), F.concat("parts", F.array("_part"))).otherwise(F.col("parts"))
        state = _joined(state, face, k, masks).select("graph_id", "n_ranked", *[F.coalesce(F.col(m).bitwiseOR(F.col(f"_{m}")), F.col(m)).alias(m) for m in masks], grown.alias("parts"))
    return state.select("graph_id", F.flatten(F.transform(F.array_sort("parts"), lambda p: p["chords"])).alias("chords"))


def count_triangulations(graphs: DataFrame) -> DataFrame:
    """graph_id and triangulations, without making the rows: faces are grouped by mask before each join, and multiplicities multiply."""
    prepared, steps, words, size, walks = _prepared(graphs)
    masks, kind = [f"m{w}" for w in range(words)], "decimal(38,0)"
    face = _face_rows(prepared, words, size, walks).groupBy("graph_id", "rank", *masks).agg(F.count(F.lit(1)).cast(kind).alias("c"))
    state = prepared.select("graph_id", F.size("ranked").alias("n_ranked"), *[F.lit(0).cast("long").alias(m) for m in masks], F.lit(1).cast(kind).alias("t"))
    for k in range(steps):
        own = face.where(F.col("rank") == k).select(F.col("graph_id").alias("_g"), F.col("c").alias("_c"), *[F.col(m).alias(f"_{m}") for m in masks])
        product = (F.col("t") * F.coalesce("_c", F.lit(1).cast(kind))).cast(kind)
        state = _joined(state, own, k, masks).select("graph_id", "n_ranked", *[F.coalesce(F.col(m).bitwiseOR(F.col(f"_{m}")), F.col(m)).alias(m) for m in masks], product.alias("t"))
        state = state.groupBy("graph_id", "n_ranked", *(masks if k + 1 < steps else [])).agg(F.sum("t").cast(kind).alias("t"))
    found = state.groupBy("graph_id").agg(F.sum("t").cast(kind).alias("t"))
    return graphs.select("graph_id").join(found, "graph_id", "left").select("graph_id", F.coalesce("t", F.lit(0)).cast(kind).alias("triangulations"))


def brute_force(graphs: DataFrame) -> DataFrame:
    """The full product of unconstrained face triangulations, filtered at the end: the oracle of ``triangulate``."""
    faces = explode_faces(graphs)
    tri = triangulate_faces(faces, bounds(faces)[0], constrained=False)
    steps = graphs.agg(F.max(F.size("faces"))).first()[0] or 0
    state = graphs.where(F.size("faces") > 0).select("graph_id", F.size("faces").alias("n_ranked"), E.boundary(F.col("faces")).alias("present"), E.no_edges().alias("chords"))
    for k in range(steps):
        own = tri.where(F.col("face_id") == k).select(F.col("graph_id").alias("_g"), F.col("chords").alias("_chords"))
        state = _joined(state, own, k, []).select("graph_id", "n_ranked", "present", F.concat("chords", F.coalesce("_chords", E.no_edges())).alias("chords"))
    return state.where(E.valid(F.col("chords"), F.col("present"))).select("graph_id", "chords")
