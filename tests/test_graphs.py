"""Enumeration, counting and the flip tree against golden values and each other."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.model import GRAPHS
from tessella.operators import combine, compare, counting, fliptree
from tessella.operators.enumerate import explode_faces, triangulate_faces
from tessella.plans import generators as G

#: Graphs and their numbers of triangulations.
GOLDEN = {
    "square": ([[1, 2, 3, 4]] * 2, 2),
    "pentagon": ([[1, 2, 3, 4, 5]] * 2, 10),
    "hexagon_reversed": ([[1, 2, 3, 4, 5, 6], [6, 5, 4, 3, 2, 1]], 68),
    "simple3": ([[1, 2, 3, 4], [1, 2, 3, 5], [1, 5, 3, 4]], 4),
    "K2_3": ([[1, 3, 2, 4], [1, 4, 2, 5], [1, 5, 2, 3]], 4),
    "W5": ([[1, 2, 5], [1, 5, 4], [1, 4, 3], [1, 3, 6], [1, 6, 2], [2, 5, 4, 3, 6]], 5),
    "theta113": ([[1, 3, 2, 4], [1, 4, 2, 7, 6, 5], [1, 5, 6, 7, 2, 3]], 150),
    "path3": ([[1, 2, 3, 2]], 1),
    "path5": ([[1, 2, 3, 4, 5, 4, 3, 2]], 12),
    "star": ([[1, 2, 1, 3, 1, 4, 1, 5, 1, 6]], 5),
    "K3": ([[1, 2, 3], [1, 3, 2]], 1),
    "no_faces": ([], 0),
}
#: Rows of the two-pentagon graph.
PENTAGON_ROWS = """(2, 5) , (3, 5) , (1, 4) , (2, 4) ,|(2, 5) , (3, 5) , (1, 3) , (1, 4) ,|(1, 3) , (3, 5) , (1, 4) , (2, 4) ,|(1, 3) , (3, 5) , (2, 4) , (2, 5) ,|(1, 3) , (1, 4) , (2, 5) , (3, 5) ,
(1, 3) , (1, 4) , (2, 4) , (2, 5) ,|(2, 4) , (2, 5) , (1, 3) , (3, 5) ,|(2, 4) , (2, 5) , (1, 3) , (1, 4) ,|(1, 4) , (2, 4) , (2, 5) , (3, 5) ,|(1, 4) , (2, 4) , (1, 3) , (3, 5) ,""".replace("\n", "|").split("|")


@pytest.fixture(scope="module")
def graphs(spark):
    return spark.createDataFrame([(k, v) for k, (v, _) in GOLDEN.items()], GRAPHS).cache()


def test_golden_rows_of_two_pentagons(graphs):
    from tessella.functions.edges import chord_text

    rows = combine.triangulate(graphs.where("graph_id = 'pentagon'")).select(chord_text(F.col("chords")).alias("t")).collect()
    assert Counter(r["t"].strip() for r in rows) == Counter(PENTAGON_ROWS)


def test_engine_equals_brute_force_and_golden_counts(graphs):
    engine, oracle = combine.triangulate(graphs), combine.brute_force(graphs)
    rows = {r["graph_id"]: r for r in compare.summary(engine, oracle, "graph_id", ["chords"]).collect()}
    for name, (_, n) in GOLDEN.items():
        if n:
            assert (rows[name]["engine_total"], rows[name]["oracle_total"], rows[name]["equal"]) == (n, n, "MATCHED"), name
    counts = {r["graph_id"]: int(r["triangulations"]) for r in counting.count_graphs(graphs).collect()}
    assert counts == {k: n for k, (_, n) in GOLDEN.items()}


def test_bag_semantics_of_a_closed_walk(graphs):
    rows = combine.triangulate(graphs.where("graph_id = 'path5'")).groupBy("chords").count().collect()
    assert len(rows) == 6 and sum(r["count"] for r in rows) == 12


def test_cycle_counts():
    assert [counting.cycle_pairs(n) for n in range(4, 16)] == [2, 10, 68, 546, 4872, 46782, 474180, 5010456, 54721224, 613912182, 7042779996, 82329308040]


def test_count_does_not_depend_on_labels_order_or_orientation(spark):
    faces = G.theta(1, 2, 2)
    variants = [faces, faces[::-1], [f[::-1] for f in faces], [f[1:] + f[:1] for f in faces], [[31 - v for v in f] for f in faces]]
    rows = counting.count_graphs(spark.createDataFrame([(str(i), v) for i, v in enumerate(variants)], GRAPHS)).collect()
    assert {int(r["triangulations"]) for r in rows} == {142}


def test_generated_families(spark):
    named = {"wheel5": (G.wheel(5), 5), "theta114": (G.theta(1, 1, 4), 1190), "path6": (G.path_walk(6), 100), "star5": (G.star_walk(5), 5), "cycle9": (G.cycle_pair(9), 46782)}
    rows = counting.count_graphs(spark.createDataFrame([(k, v) for k, (v, _) in named.items()], GRAPHS)).collect()
    assert {r["graph_id"]: int(r["triangulations"]) for r in rows} == {k: n for k, (_, n) in named.items()}


@pytest.mark.parametrize("n, catalan", [(5, 5), (7, 42), (8, 132)])
def test_flip_tree(spark, n, catalan):
    tri = triangulate_faces(explode_faces(spark.createDataFrame([("g", [list(range(n))])], GRAPHS)), n, constrained=False).cache()
    assert tri.count() == catalan
    tree = {tuple(map(tuple, r["index_chords"])): r for r in fliptree.tree(tri).collect()}
    assert sum(r["parent"] is None for r in tree.values()) == 1
    down = Counter((tuple(map(tuple, r["child"])), tuple(map(tuple, r["index_chords"]))) for r in fliptree.children(tri).collect())
    up = Counter((k, tuple(map(tuple, r["parent"]))) for k, r in tree.items() if r["parent"])
    assert down == up
    assert all(tree[k]["depth"] == tree[p]["depth"] + 1 for k, p in up)
    flips = fliptree.flip_neighbors(tri)
    assert flips.count() == catalan * (n - 3) and flips.select("index_chords", "neighbor").distinct().count() == flips.count()
    assert fliptree.unlabelled(tri).count() == {5: 1, 7: 4, 8: 12}[n]


def test_bag_diff_labels(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "t string")
    b = spark.createDataFrame([("x",), ("z",)], "t string")
    assert {(r["t"], r["label"], r["n"]) for r in compare.bag_diff(a, b, ["t"]).collect()} == {("x", "MATCH", 1), ("x", "EXTRA", 1), ("y", "EXTRA", 1), ("z", "MISSING", 1)}


def test_large_faces_are_rows_where_few_triangulations_are_valid(spark):
    from tessella.functions import edges as E

    n = 20
    taken = [[i, j, 2] for i in range(3, n) for j in range(i + 2, n + 1)]  # all chords but those of vertex 1
    graphs = spark.createDataFrame([("fan", [list(range(1, n + 1)), *taken]), ("square", [[1, 2, 3, 4]])], "graph_id string, faces array<array<int>>")
    faces = graphs.withColumn("present", E.boundary(F.col("faces"))).select("graph_id", "present", F.posexplode("faces").alias("face_id", "face")).where("face_id = 0").withColumn("n", F.size("face"))
    got = {}
    for r in triangulate_faces(faces).collect():
        got.setdefault(r["graph_id"], []).append(sorted((c["a"], c["b"]) for c in r["chords"]))
    assert got["fan"] == [[(1, k) for k in range(3, n)]] and sorted(got["square"]) == [[(1, 3)], [(2, 4)]]


def test_counts_of_large_cycles_are_whole_or_refused(spark):
    graphs = lambda n: spark.createDataFrame([("g", G.cycle_pair(n)), ("h", G.cycle_pair(5))], "graph_id string, faces array<array<int>>")
    largest = max(n for n in range(20, 60) if counting.cycle_pairs(n) < 10**38)
    assert {r["graph_id"]: int(r["triangulations"]) for r in counting.count_graphs(graphs(largest)).collect()} == {"g": counting.cycle_pairs(largest), "h": counting.cycle_pairs(5)}
    with pytest.raises(ValueError):
        counting.count_graphs(graphs(largest + 1))
