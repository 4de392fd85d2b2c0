"""Registered queries of the graph engine: each runs an operator over whole driver tables or over inline graphs."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import edges as E
from tessella.functions import fmt
from tessella.model import GRAPHS
from tessella.operators import benchstats, combine, compare, counting, fliptree, series, trace_mode
from tessella.operators.enumerate import explode_faces, triangulate_faces
from tessella.session import share_package, shared_folder
from tessella.sources import graphs as source
from tessella.sources import results, sinks
from tessella.streaming import traces

#: Inline graphs: biconnected ones, and closed walks that repeat vertices.
FIXTURES = {
    "square": [[1, 2, 3, 4], [1, 2, 3, 4]],
    "pentagon": [[1, 2, 3, 4, 5], [1, 2, 3, 4, 5]],
    "simple3": [[1, 2, 3, 4], [1, 2, 3, 5], [1, 5, 3, 4]],
    "k23": [[1, 3, 2, 4], [1, 4, 2, 5], [1, 5, 2, 3]],
    "theta113": [[1, 3, 2, 4], [1, 4, 2, 7, 6, 5], [1, 5, 6, 7, 2, 3]],
    "triangle": [[1, 2, 3], [1, 3, 2]],
}
WALKS = {
    "path3": [[1, 2, 3, 2]],
    "path4": [[1, 2, 3, 4, 3, 2]],
    "path5": [[1, 2, 3, 4, 5, 4, 3, 2]],
    "path6": [[1, 2, 3, 4, 5, 6, 5, 4, 3, 2]],
    "star": [[1, 2, 1, 3, 1, 4, 1, 5, 1, 6]],
}
POLYGONS = range(3, 11)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def inline(spark: SparkSession, graphs: dict) -> DataFrame:
    share_package(spark)
    return spark.createDataFrame(list(graphs.items()), GRAPHS)


def polygons(spark: SparkSession, sizes=POLYGONS) -> DataFrame:
    """Triangulations, by positions, of one polygon of each size."""
    faces = explode_faces(inline(spark, {str(n): [list(range(n))] for n in sizes}))
    return triangulate_faces(faces, max(sizes), constrained=False)


def region_cycles(spark: SparkSession, sf_dir: str, copies: int = 2) -> DataFrame:
    """One graph a region: its nations in order of their key as a cycle, with so many faces."""
    nation = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    both = nation.withColumn("face", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return source.nest(both, "n_regionkey", "face", "n_nationkey", "n_nationkey")


def supplier_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graph a nation: all its suppliers as a cycle with two faces."""
    supplier = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").cast("int").alias("s_suppkey"))
    both = supplier.withColumn("face", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return source.nest(both, "s_nationkey", "face", "s_suppkey", "s_suppkey")


def positions_text(chords: Column) -> Column:
    return F.array_join(F.transform(chords, lambda c: F.format_string("%d-%d", c["i"], c["j"])), " ")


# Faces and edges


def face_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = explode_faces(region_cycles(spark, sf_dir, 1))
    return faces.select("graph_id", F.posexplode(E.face_edges(F.col("face"))).alias("pos", "e")).select("graph_id", "pos", "e.a", "e.b")


def boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_cycles(spark, sf_dir).select("graph_id", F.explode(E.boundary(F.col("faces"))).alias("e")).select("graph_id", "e.a", "e.b")


def boundary_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explode_faces(supplier_cycles(spark, sf_dir)).select("graph_id", F.explode(E.face_edges(F.col("face"))).alias("e"))
    return rows.groupBy("graph_id", F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.count(F.lit(1)).alias("mult"))


def face_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.profile(supplier_cycles(spark, sf_dir))


def rotated_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = explode_faces(region_cycles(spark, sf_dir, 1)).withColumn("root", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return faces.select("graph_id", "root", F.array_join(E.rotated(F.col("face"), F.col("root")), " ").alias("face"))


def _safe_roots(spark: SparkSession, sf_dir: str, high: bool) -> DataFrame:
    faces = explode_faces(region_cycles(spark, sf_dir, 1)).withColumn("step", F.explode(F.array(F.lit(2), F.lit(3))))
    at = F.sequence(F.lit(0), F.col("n") - F.col("step") - 1)
    present = F.transform(at, lambda i: E.edge(F.get("face", i), F.get("face", i + F.col("step"))))
    return faces.withColumn("present", present).select("graph_id", "step", E.safe_root(F.col("face"), F.col("present"), high).alias("root"))


def safe_root_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _safe_roots(spark, sf_dir, True)


def safe_root_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _safe_roots(spark, sf_dir, False)


def root_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(3, 11).select(F.col("id").cast("int").alias("n")).select("n", positions_text(E.root_fan(F.col("n"))).alias("fan"))


def parse_graph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [("two", "2\n4 1 2 3 4\n 4 1 2 3 4\n"), ("extra", "1 3 7 8 9 55"), ("none", "0"), ("blank", " \n")]
    rows = spark.createDataFrame(texts, "graph_id string, value string").select("graph_id", source.parse_faces(F.col("value")).alias("faces"))
    return rows.select("graph_id", F.posexplode("faces").alias("face_id", "face")).select("graph_id", "face_id", F.array_join("face", " ").alias("face"))


# Enumeration


def face_triangulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = explode_faces(region_cycles(spark, sf_dir, 1))
    return triangulate_faces(faces, constrained=False).select("graph_id", E.chord_text(F.col("chords")).alias("row"))


def face_triangulation_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons(spark).groupBy("n").agg(F.count(F.lit(1)).alias("triangulations"))


def _rows(found: DataFrame) -> DataFrame:
    return found.select("graph_id", E.chord_text(F.col("chords")).alias("row"))


def triangulate_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(combine.triangulate(region_cycles(spark, sf_dir)))


def triangulate_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(combine.triangulate(inline(spark, FIXTURES)))


def triangulate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.count_triangulations(inline(spark, FIXTURES)).select("graph_id", F.col("triangulations").cast("long").alias("triangulations"))


def triangulate_closed_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(combine.triangulate(inline(spark, WALKS)))


def bruteforce_triangulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(combine.brute_force(region_cycles(spark, sf_dir)))


def count_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_graphs(region_cycles(spark, sf_dir)).select("graph_id", F.col("triangulations").cast("long").alias("triangulations"))


def cycle_pair_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = inline(spark, {str(n): [list(range(1, n + 1))] * 2 for n in range(4, 16)})
    return counting.count_graphs(cycles).select(F.col("graph_id").cast("int").alias("n"), F.col("triangulations").cast("long").alias("triangulations"))


def search_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_mode.trace(inline(spark, WALKS))


# Comparison


def _bags(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Closed-walk results without the least row of path5, and without that of star."""
    full = _rows(combine.triangulate(inline(spark, WALKS)))
    without = lambda g: full.exceptAll(full.where(F.col("graph_id") == g).groupBy("graph_id").agg(F.min("row").alias("row")))
    return without("path5"), without("star")


def bag_compare_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, oracle = _bags(spark)
    return compare.bag_diff(engine, oracle, ["graph_id", "row"]).select("graph_id", "row", "label", F.col("n").cast("long").alias("n"))


def match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, oracle = _bags(spark)
    return compare.summary(engine, oracle, "graph_id", ["row"]).select("graph_id", "engine_total", "oracle_total", "matches", "extra", "missing", "ratio", "contained", "equal")


def positional_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, oracle = _bags(spark)
    return compare.positional(engine, oracle, "graph_id", "row")


# Flip tree


def flip_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fliptree.flip_neighbors(polygons(spark, [6]))
    return found.select(positions_text(F.col("index_chords")).alias("tri"), positions_text(F.col("neighbor")).alias("neighbor"))


def flip_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fliptree.tree(polygons(spark, [6]))
    return found.select(positions_text(F.col("index_chords")).alias("tri"), positions_text(F.col("parent")).alias("parent"), "depth", "n_children")


def flip_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fliptree.children(polygons(spark, [6]))
    return found.select(positions_text(F.col("index_chords")).alias("tri"), positions_text(F.col("child")).alias("child"))


def flip_depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fliptree.tree(polygons(spark)).groupBy("n", "depth").agg(F.count(F.lit(1)).alias("triangulations"))


def valid_generating_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generating sets of a hexagon where position 1 and 3 are joined in the graph."""
    tri = fliptree.with_apexes(polygons(spark, [6])).withColumn("present", F.concat(E.face_edges(F.col("face")), F.array(E.edge(F.lit(1), F.lit(3)))))
    valid = fliptree.valid_generating_set(F.col("apexes"), F.col("face"), F.col("present"))
    return tri.select(positions_text(F.col("index_chords")).alias("tri"), positions_text(fliptree.generating_set(F.col("apexes"))).alias("gs"), positions_text(valid).alias("vgs"))


def degree_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of triangulations under rotation and reflection."""
    found = fliptree.unlabelled(polygons(spark, range(4, 9)))
    return found.select("n", F.array_join("degrees", " ").alias("degrees"), "members")


# Statistics


def _described(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    return benchstats.describe(df, keys, x).select(*keys, "runs", *[F.round(c, 6).alias(c) for c in ("mean", "median", "min", "max", "stddev")])


def bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(table(spark, sf_dir, "events"), ["event_type"], F.col("value"))


def bench_stats_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_extendedprice"))


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files, their lines as timed runs."""
    line = table(spark, sf_dir, "lineitem")
    runs = line.select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("filename"), F.col("l_linenumber").alias("run"), (F.floor(F.col("l_extendedprice") * 1000).cast("long") * 840).alias("dur_ns"),
        (F.col("l_quantity") * 100).cast("long").alias("mem_before"), (F.col("l_discount") * 100000).cast("long").alias("mem_after"), F.pmod("l_orderkey", F.lit(7)).cast("int").alias("vertices"), F.pmod("l_orderkey", F.lit(11)).alias("triangulations"),
    )
    out = benchstats.results(runs)
    return out.select("filename", "vertices", F.col("triangulations").cast("long").alias("triangulations"), "meanTime", "medianTime", "minTime", "maxTime", "stddevTime", "perTriangNs", "peakMemory", F.round("memoryPerVertex", 4).alias("memoryPerVertex"))


def results_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results written as one CSV file and read again."""
    path = f"{shared_folder(spark)}/results-{uuid4().hex}"
    sinks.rewrite_csv(run_results(spark, sf_dir), path)
    return results.read_results(spark, path).withColumn("triangulations", F.col("triangulations").cast("long"))


def diff_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, oracle = _bags(spark)
    return sinks.diff_lines(compare.bag_diff(engine, oracle, ["graph_id", "row"]), "MISMATCHED")


def stream_running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files of a stream, taken up by the stateful running cost and read back."""
    share_package(spark)
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    _user_trace(spark, sf_dir).select(F.col("user_id").cast("string").alias("graph_id"), "elapsed").write.parquet(f"{folder}/in")
    traces.run_available(traces.running_costs(traces.read_events(spark, f"{folder}/in")), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


def per_item_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select("o_orderkey", F.round(fmt.ratio(F.col("o_totalprice"), F.coalesce("items", F.lit(0))), 6).alias("cost"))


def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("checks"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("successful"))
    return orders.select("o_orderpriority", "checks", "successful", F.round(benchstats.success_rates(orders, "successful", "checks"), 2).alias("rate"))


def loglog_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = benchstats.power_law(_order_totals(spark, sf_dir), F.col("x"), F.col("y"))
    return law.select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


def _order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("x"), F.sum("l_extendedprice").alias("y"))


def regression_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchstats.envelope(_order_totals(spark, sf_dir), F.col("x"), F.col("y"))
    return found.select(*[F.round(c, 4).alias(c) for c in ("slope", "intercept", "upper", "lower")])


def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return benchstats.resume(table(spark, sf_dir, "customer"), done, "c_custkey").select("c_custkey", "c_name")


def first_record_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return benchstats.first_by(line, ["l_partkey"], ["l_orderkey", "l_linenumber"])


# Series


def _user_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user with the microseconds since the first one."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    start = F.min("ts").over(Window.partitionBy("user_id"))
    return events.withColumn("start", start).withColumn("elapsed", F.expr("timestampdiff(MICROSECOND, start, ts)")).drop("start")


def incremental_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.incremental(_user_trace(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    return out.select("user_id", "event_id", F.col("n").cast("long").alias("n"), "elapsed", "incremental", "running", F.col("cumulative_avg").cast("long").alias("cumulative_avg"))


def first_n_with_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.first_n(series.incremental(_user_trace(spark, sf_dir), ["user_id"], ["ts", "event_id"]), ["user_id"], 5)
    return out.select("user_id", F.col("n").cast("long").alias("n"), F.col("cumulative_avg").cast("long").alias("cumulative_avg"), F.col("final").cast("long").alias("final"), F.col("total").cast("long").alias("total"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").cast("string").alias("day")).agg(F.avg("o_totalprice").alias("mean"), F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0)).alias("dev"))


def smoothed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.smoothed(_days(spark, sf_dir), ["day"], ["mean"]).select("day", F.round("mean", 6).alias("mean"), F.round("mean_smooth", 6).alias("mean_smooth"))


def smoothed_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.smoothed_envelope(_days(spark, sf_dir), ["day"], "mean", "dev")
    return out.select("day", *[F.round(f"{c}_smooth", 6).alias(c) for c in ("mean", "upper", "lower")])


# Formats


def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars") * F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 1000).otherwise(1_000_000)
    return table(spark, sf_dir, "documents").select("doc_id", fmt.format_bytes(n).alias("size"), fmt.memory_band(n).alias("band"))


def strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    coloured = F.concat(F.lit("\x1b[1;31m"), F.col("url"), F.lit("\x1b[0m ok"))
    return table(spark, sf_dir, "pages").select("page_id", fmt.strip_ansi(coloured).alias("plain"), fmt.short(F.col("url")).alias("short"))


def stem_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fmt.file_name(F.col("url")).alias("name"), fmt.stem(F.col("url")).alias("stem"))


def wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", fmt.wall_clock(F.lit(3_600_000_000), F.col("event_id") * 1_234_567).alias("wall_clock"))


def parse_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat(F.lit("n="), F.regexp_replace((F.col("o_orderkey") * 7919).cast("string"), "(\\d)(?=(\\d{3})+$)", "$1,"))
    return table(spark, sf_dir, "orders").select("o_orderkey", fmt.parse_count(named).cast("long").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        face_edges, boundary_edges, boundary_multiplicity, face_profile, rotated_faces, safe_root_high, safe_root_low, root_fan, parse_graph_text,
        face_triangulations, face_triangulation_count, triangulate_graph, triangulate_fixtures, triangulate_count, triangulate_closed_walk, bruteforce_triangulations, count_graphs, cycle_pair_count, search_counters,
        bag_compare_report, match_status, positional_equal, flip_neighbors, flip_parent, flip_children, flip_depth_histogram, valid_generating_sets, degree_sequences,
        bench_stats, bench_stats_by_order, run_results, per_item_cost, success_rates, loglog_regression, regression_envelope, resume_skip, first_record_wins, results_csv_round_trip, diff_report_lines, stream_running_cost,
        incremental_cost, first_n_with_final, smoothed_mean, smoothed_envelope, format_bytes, strip_ansi, stem_name, wall_clock, parse_count,
    )
}
