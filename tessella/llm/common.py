"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.session import share_package

#: Word class of the byte-wise tokenisers: digits, a-z (after lower-casing) and every non-ASCII character.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The separators of the whitespace tokeniser.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate tables over UTF-8: A-Z lower-cased; and the same with every ASCII byte that is no word byte made a space.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD_BYTES = bytes(LOWER_BYTES[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: an expression named inside a lambda is otherwise evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, op, chunk: int = 128) -> Column:
    """For each place of an array that is not empty, ``op`` folded over the values before it. Places are folded in chunks, as appending copies an array."""

    def fold(part: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, begin, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    def of(values: Column) -> Column:
        part = lambda c: F.slice(values, c * chunk + 1, F.lit(chunk))
        totals = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / chunk).cast("int")), lambda c: F.aggregate(part(c), zero, op))
        return let(fold(totals, zero), lambda starts: F.flatten(F.transform(starts, lambda at, c: fold(part(c), at))))

    return let(values, of)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id as text is 2 modulo 4; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a private one only where none is set, as in tests."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            named = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
        found = sc.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder, so later reads and lost executors do not recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hash_sample(rows: DataFrame, group: str, key: str, most: dict | int) -> DataFrame:
    """At most ``most`` rows of each group, those with the least hash of the key. Groups are counted first, and only hashes below
    what their counts ask for, with some to spare, go on to be ranked: a task ranks about ``most`` rows whatever the input."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("c")).collect()
    wanted = {r[group]: most if isinstance(most, int) else most.get(r[group], 0) for r in counts}
    u = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40))
    chosen = [(F.col(group).eqNullSafe(F.lit(r[group]))) & (u < int((1 << 40) * min(1.0, (1.3 * wanted[r[group]] + 100) / r["c"]))) for r in counts]
    some = rows.where(reduce(lambda a, b: a | b, chosen)) if chosen else rows
    order = Window.partitionBy(group).orderBy(u, key)
    ranked = some.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max(wanted.values(), default=0))
    for g, m in wanted.items():
        ranked = ranked.where((F.col("_rank") <= m) | ~F.col(group).eqNullSafe(F.lit(g)))
    return ranked.drop("_rank")


def slices(batches: Iterator[pa.RecordBatch], *texts: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces that hold about ``most`` bytes of the named columns, one row at least, so that memory does not follow the rows of a batch."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(t)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
        part = np.cumsum(size) // most
        at = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield batch.slice(a, b - a)


def bitmap(df: DataFrame, place: str, bits: int) -> np.ndarray:
    """``bits`` bits as int64 words, those set whose number is in the column: aggregated to words first, so its size is fixed."""
    word, bit = (F.col(place) / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(place) % 64).cast("int")).alias("b")
    rows = df.select(word, bit).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out
