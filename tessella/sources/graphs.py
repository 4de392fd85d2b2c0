"""Graph files: whitespace-separated whole numbers, the number of faces and then each face as its size and vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import edges as E
from tessella.functions import fmt


def parse_faces(text: Column) -> Column:
    """The faces of a graph text; tokens after the last face are ignored, a text that ends early keeps its whole faces."""
    tokens = F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), lambda t: t.try_cast("int"))
    kind = "array<array<int>>"
    zero = F.struct(F.lit(-1).alias("left"), F.lit(0).alias("need"), F.array().cast("array<int>").alias("face"), F.array().cast(kind).alias("faces"))

    def step(s: Column, t: Column) -> Column:
        make = lambda left, need, face, faces: F.struct(left.cast("int").alias("left"), need.cast("int").alias("need"), face.alias("face"), faces.alias("faces"))
        empty = F.array().cast("array<int>")
        grown = F.concat(s["face"], F.array(t))
        return (
            F.when(s["left"] < 0, make(F.coalesce(t, F.lit(0)), F.lit(0), empty, s["faces"]))
            .when((s["left"] == 0) & (s["need"] == 0), s)
            .when((s["need"] == 0) & (F.coalesce(t, F.lit(0)) <= 0), make(s["left"] - 1, F.lit(0), empty, F.concat(s["faces"], F.array(empty))))
            .when(s["need"] == 0, make(s["left"] - 1, t, empty, s["faces"]))
            .when(s["need"] == 1, make(s["left"], F.lit(0), empty, F.concat(s["faces"], F.array(grown))))
            .otherwise(make(s["left"], s["need"] - 1, grown, s["faces"]))
        )

    return F.aggregate(tokens, zero, step)["faces"]


def read_graphs(spark: SparkSession, path: str | list[str], recursive: bool = False, glob: str | None = None) -> DataFrame:
    """graph_id (file name), path and faces of every file; recursive reads subfolders, glob filters by name."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("graph_id"), "value")
    return files.select("graph_id", "path", parse_faces(F.col("value")).alias("faces"))


def read_groups(spark: SparkSession, folders: dict[str, int], root: str) -> DataFrame:
    """Graphs of the folders under ``root`` that exist, with their folder as ``grp`` and the folder's number of runs, by file name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = None
    for name, runs in folders.items():
        at = hadoop(f"{root}/{name}")
        if at.getFileSystem(conf).exists(at):
            own = read_graphs(spark, f"{root}/{name}").withColumns({"grp": F.lit(name), "runs": F.lit(runs)})
            out = own if out is None else out.unionByName(own)
    if out is None:
        return spark.createDataFrame([], "graph_id string, path string, faces array<array<int>>, grp string, runs int")
    return out.orderBy("grp", "graph_id")


def faces_long(graphs: DataFrame) -> DataFrame:
    """graph_id, face_id, pos and vertex."""
    faces = graphs.select("graph_id", F.posexplode("faces").alias("face_id", "face"))
    return faces.select("graph_id", "face_id", F.posexplode("face").alias("pos", "vertex"))


def nest(faces: DataFrame, graph: str = "graph_id", face: str = "face_id", pos: str = "pos", vertex: str = "vertex") -> DataFrame:
    """Graphs from the long form."""
    ordered = lambda rows: F.transform(F.array_sort(rows), lambda x: x["x"])
    by_face = faces.groupBy(graph, face).agg(ordered(F.collect_list(F.struct(F.col(pos), F.col(vertex).cast("int").alias("x")))).alias("x"))
    return by_face.groupBy(F.col(graph).cast("string").alias("graph_id")).agg(ordered(F.collect_list(F.struct(F.col(face), "x"))).alias("faces"))


def profile(graphs: DataFrame) -> DataFrame:
    """Per graph: faces, vertices, edges, largest face, the Euler characteristic, and whether it can be enumerated."""
    faces = F.col("faces")
    v, e, f = E.distinct_vertices(faces), F.size(E.boundary(faces)), F.size(faces)
    return graphs.select(
        "graph_id", f.alias("n_faces"), v.alias("n_vertices"), e.alias("n_edges"), F.coalesce(F.array_max(F.transform(faces, F.size)), F.lit(0)).alias("largest_face"),
        (v - e + f).alias("euler"), ((f > 0) & F.forall(faces, lambda x: F.size(x) > 0)).alias("usable"),
    )


def labels(graphs: DataFrame) -> DataFrame:
    """With the file's stem as label."""
    return graphs.withColumn("label", fmt.stem(F.col("graph_id")))
