"""Table schemas of the engine.

A graph is an ordered list of faces, a face a cyclic sequence of vertices. Edges and chords are structs (a, b) with a <= b.
"""

from __future__ import annotations

from pyspark.sql import types as T

EDGE = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
FACES = T.ArrayType(T.ArrayType(T.IntegerType()))
GRAPHS = T.StructType([T.StructField("graph_id", T.StringType()), T.StructField("faces", FACES)])

#: Benchmark results, one row per input file; times in seconds.
RESULTS = T.StructType(
    [T.StructField("filename", T.StringType()), T.StructField("vertices", T.IntegerType()), T.StructField("triangulations", T.DecimalType(38, 0))]
    + [T.StructField(c, T.DoubleType()) for c in ("meanTime", "medianTime", "minTime", "maxTime", "stddevTime", "perTriangNs")]
    + [T.StructField("peakMemory", T.LongType()), T.StructField("memoryPerVertex", T.DoubleType())]
)
#: Timed runs, the input of the statistics.
RUNS = T.StructType(
    [T.StructField("filename", T.StringType()), T.StructField("run", T.IntegerType()), T.StructField("dur_ns", T.LongType()), T.StructField("mem_before", T.LongType()), T.StructField("mem_after", T.LongType())]
    + [T.StructField("vertices", T.IntegerType()), T.StructField("triangulations", T.LongType())]
)
#: Timing trace, one row per output.
TRACE = T.StructType(
    [T.StructField("triangulation_n", T.LongType()), T.StructField("wall_clock", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("elapsed_since_start_ns", "incremental_ns", "cumulative_avg_ns")]
)
