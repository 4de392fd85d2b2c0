"""Sources, sinks, formats, series, statistics, plans and streams."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import fmt
from tessella.model import GRAPHS, RUNS
from tessella.operators import benchstats, series, trace_mode
from tessella.operators.combine import triangulate
from tessella.plans import generators as G
from tessella.plans import validate
from tessella.sources import graphs as source
from tessella.sources import results, sinks
from tessella.streaming import traces


def graph_file(faces):
    return f"{len(faces)}\n" + "\n".join(" ".join(map(str, [len(f), *f])) for f in faces) + "\n"


def test_reading_graph_files(spark, tmp_path):
    (tmp_path / "small" / "deep").mkdir(parents=True)
    (tmp_path / "small" / "a.txt").write_text(graph_file(G.cycle_pair(4)) + " 77")
    (tmp_path / "small" / "deep" / "b.txt").write_text(graph_file(G.path_walk(4)))
    (tmp_path / "small" / "deep" / "note.md").write_text("no graph")
    flat = source.read_graphs(spark, f"{tmp_path}/small").collect()
    assert [(r["graph_id"], r["faces"]) for r in flat] == [("a.txt", [[1, 2, 3, 4]] * 2)]
    deep = source.read_graphs(spark, f"{tmp_path}/small", recursive=True, glob="*.txt")
    assert {r["graph_id"] for r in deep.collect()} == {"a.txt", "b.txt"}
    groups = source.read_groups(spark, {"small": 10, "medium": 3}, str(tmp_path)).collect()
    assert [(r["grp"], r["runs"], r["graph_id"]) for r in groups] == [("small", 10, "a.txt")]
    assert source.nest(source.faces_long(deep)).where("graph_id = 'b.txt'").first()["faces"] == G.path_walk(4)
    assert [r["label"] for r in source.labels(deep).orderBy("label").collect()] == ["a", "b"]


@pytest.mark.parametrize("text, faces", [("2 3 1 2 3 0", [[1, 2, 3], []]), ("", []), ("x", []), ("3 2 5 6 4 1", [[5, 6]])])
def test_parsing_odd_graph_texts(spark, text, faces):
    assert spark.createDataFrame([(text,)], "t string").select(source.parse_faces(F.col("t")).alias("f")).first()["f"] == faces


def test_profile_reports_planarity_and_usability(spark):
    rows = {r["graph_id"]: r for r in source.profile(spark.createDataFrame([("g", G.grid(3, 3)), ("w", G.wheel(5)), ("e", []), ("h", [[]])], GRAPHS)).collect()}
    assert rows["g"]["euler"] == rows["w"]["euler"] == 2 and rows["g"]["usable"] and not rows["e"]["usable"] and not rows["h"]["usable"]


def test_result_files(spark, tmp_path):
    rows = triangulate(spark.createDataFrame([("g", G.cycle_pair(5))], GRAPHS))
    sinks.write_results(rows, f"{tmp_path}/out")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert "Total triangulations in biconnected component: 10" in lines and len(lines) == 11
    runs = spark.createDataFrame([("a", 1, 2_000_000_000, 0, 4096, 4, 2), ("a", 2, 1_000_000_000, 10, 0, 4, 2), ("a", 3, 6_000_000_000, 0, 0, 4, 2), ("b", 1, 5, 0, 0, 0, 0)], RUNS)
    got = benchstats.results(runs)
    a, b = got.orderBy("filename").collect()
    assert (a["meanTime"], a["medianTime"], a["minTime"], a["maxTime"], a["perTriangNs"], a["peakMemory"], a["memoryPerVertex"]) == (3.0, 2.0, 1.0, 6.0, 1.5e9, 4096, 1024.0)
    assert (b["stddevTime"], b["perTriangNs"], b["memoryPerVertex"]) == (0.0, 0.0, 0.0)
    sinks.append_csv(got.where("filename = 'a'"), f"{tmp_path}/csv")
    previous = results.read_previous(spark, f"{tmp_path}/csv")
    assert [r["filename"] for r in validate.benchmark(runs, previous).orderBy("filename").collect()] == ["a", "b"]
    sinks.rewrite_csv(got, f"{tmp_path}/all")
    assert [r["filename"] for r in results.read_results(spark, f"{tmp_path}/all").collect()] == ["a", "b"]
    table = sinks.console_table(got).orderBy("name").first()
    assert (table["memory"], table["time_band"], table["memory_band"]) == ("4.00 KB", "slow", "medium")
    assert sinks.chart_series(got).first()["label"] == ["a", "b"]


def test_previous_results_skip_malformed_and_keep_the_first(spark, tmp_path):
    head = "filename,vertices,triangulations,meanTime,medianTime,minTime,maxTime,stddevTime,perTriangNs,peakMemory,memoryPerVertex\n"
    (tmp_path / "r.csv").write_text(head + "x,3,1,1,1,1,1,0,1,4096,1\nbroken,zz\nx,3,9,1,1,1,1,0,1,4096,1\n")
    assert [(r["filename"], int(r["triangulations"])) for r in results.read_previous(spark, f"{tmp_path}/r.csv").collect()] == [("x", 1)]
    (tmp_path / "old.csv").write_text("filename,vertices,triangulations,avgTime\ny,3,4,0.5\n")
    row = results.read_results(spark, f"{tmp_path}/old.csv").first()
    assert (row["meanTime"], row["medianTime"], row["stddevTime"]) == (0.5, 0.5, 0.0)


def test_trace_columns_round_trip(spark, tmp_path):
    events = spark.createDataFrame([("g", i, e) for i, e in enumerate((900, 1500, 1900, 2600))], "graph_id string, i int, elapsed long")
    out = series.incremental(events, ["graph_id"], ["i"])
    assert [(r["incremental"], r["cumulative_avg"]) for r in out.orderBy("n").collect()] == [(900, 900), (600, 750), (400, 633), (700, 650)]
    assert {(r["n"], r["final"]) for r in series.first_n(out, ["graph_id"], 2).collect()} == {(1, 650), (2, 650)}
    with pytest.raises(ValueError):
        series.first_n(out, ["graph_id"], 0)
    sinks.write_traces(out, f"{tmp_path}/t", 0)
    again = spark.read.option("recursiveFileLookup", True).csv(f"{tmp_path}/t", header=True)
    assert sorted(int(r["cumulative_avg_ns"]) for r in again.collect()) == [633, 650, 750, 900]
    (tmp_path / "one.csv").write_text("triangulation_n,wall_clock,elapsed_since_start_ns,incremental_ns,cumulative_avg_ns\n1,00:00:00.000001,900,900,\n2,00:00:00.000002,1500,600,750\n")
    assert [r["avg_ms"] for r in results.read_traces(spark, f"{tmp_path}/one.csv").orderBy("triangulation_n").collect()] == [900 / 1e6, 750 / 1e6]


def test_streaming_trace_resumes(spark, tmp_path):
    src, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    write = lambda rows: spark.createDataFrame(rows, traces.EVENTS).coalesce(1).write.mode("append").parquet(src)
    write([("g", 900), ("g", 1500), ("h", 5)])
    traces.run_available(traces.running_costs(traces.read_events(spark, src)), out, mark)
    write([("g", 1900), ("g", 2600)])
    traces.run_available(traces.running_costs(traces.read_events(spark, src)), out, mark)
    rows = spark.read.parquet(out).where("graph_id = 'g'").orderBy("n").collect()
    assert [(r["incremental"], r["cumulative_avg"]) for r in rows] == [(900, 900), (600, 750), (400, 633), (700, 650)]
    seen = []
    traces.each_batch(traces.first_records(traces.read_events(spark, src)), f"{tmp_path}/mark2", lambda df, _: seen.append(df.count()))
    assert sum(seen) == 2


def test_cross_validation_report(spark):
    graphs = spark.createDataFrame([("path5.txt", G.path_walk(5)), ("c5.txt", G.cycle_pair(5)), ("empty.txt", [])], GRAPHS)
    rows = {r["Filename"]: r for r in validate.cross_validate(graphs, counters=True).collect()}
    assert (rows["path5.txt"]["Algo Total"], rows["path5.txt"]["Total Checks"], rows["path5.txt"]["Check Success Rate (%)"], rows["path5.txt"]["Traversal Success Rate (%)"], rows["path5.txt"]["Status"]) == (12, 35, 45.71, 70.59, "MATCHED")
    assert rows["c5.txt"]["Invalid Traversals"] == 0 and rows["empty.txt"]["Algo Total"] == 0
    assert validate.answered(graphs).count() == 2


@pytest.mark.parametrize("faces", [G.path_walk(6), G.star_walk(5), G.theta(1, 1, 3), G.tree_walk({1: [2, 3, 4]})])
def test_search_visits_one_state_more_than_successful_checks(faces):
    results_, checks, successful, invalid = trace_mode.search_counters(faces)
    assert results_ + invalid == successful + 1 <= checks + 1


def test_formats(spark):
    row = spark.range(1).select(
        fmt.stem(F.lit("/x/a.b.txt")).alias("stem"), fmt.strip_ansi(F.lit("\x1b[31mred\x1b[0m")).alias("plain"), fmt.format_bytes(F.lit(1152)).alias("kb"), fmt.parse_count(F.lit("n=12,345")).alias("n"),
        fmt.wall_clock(F.lit(0), F.lit(1_234_567_890)).alias("clock"), fmt.fixed(F.lit(2.5), 0).alias("f0"), fmt.fixed(F.lit(1.5), 4).alias("f4"), fmt.ratio(F.lit(1), F.lit(0)).alias("zero"), fmt.status(F.lit(False)).alias("status"),
    ).first()
    assert (row["stem"], row["plain"], row["kb"], int(row["n"]), row["clock"], row["f0"], row["f4"], row["zero"], row["status"]) == ("a.b", "red", "1.12 KB", 12345, "00:00:01.234567", "2", "1.5000", 0.0, "MISMATCHED")


def test_harness_rows_feed_the_statistics(spark):
    from tessella.plans import harness

    calls = []
    rows = harness.run_table(spark, {"a": (lambda: calls.append(1) or 7, 4, 3), "b": (lambda: 1, 2, 1)})
    assert len(calls) == 4 and rows.count() == 4
    got = benchstats.results(rows).orderBy("filename").first()
    assert (got["filename"], got["vertices"], int(got["triangulations"])) == ("a", 4, 7) and got["minTime"] <= got["medianTime"] <= got["maxTime"]
