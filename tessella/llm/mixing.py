"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are numbered in a hashed order and cut into blocks. Block k of a source with weight w is released at slot
``floor(k / w)`` and due at ``ceil((k + 1) / w)``; in each slot the released block with the earliest deadline runs. Weights are
taken as the exact fractions they are, never rounded. In every prefix of a phase, each source has less than one block more or fewer
than its weight asks for. When a source has no blocks left, its weight is shared by the others in proportion and a new phase
begins, so no row is dropped or repeated.

Every source is scheduled by its own weight, however many there are. One task takes the sources' counts, not their rows, and runs
the schedule block by block; a source not yet served in a phase waits in the order of weights, which no phase changes,
so a new phase costs only what the last one served. The slots leave in pieces of ``PIECE`` blocks, which join their rows.

Numbering is spread: a source is split into hash buckets of about ``BUCKET_ROWS`` rows, rows are numbered within a bucket,
and bucket offsets are added, so a source that holds a third of all rows is many small groups.

Defined cases: a null source is a source of its own; sources without a positive weight, if weights are given, share a hundredth of the
least weight by their row counts; repeated rows get places of their own; null doc_ids are numbered like
others; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 16
BUCKET_ROWS = 2000
#: Default targets follow the row counts to this power.
TEMPERATURE = 0.7
#: Blocks of a source whose slots travel in one row, and blocks in all up to which these rows are broadcast.
PIECE, BROADCAST_BLOCKS = 64, 1_000_000


def rounded(weights: list[float], quantum: int) -> list[int]:
    """Whole numbers of at least 1 that sum to ``quantum``, by largest remainders."""
    total = sum(weights)
    spare = quantum - len(weights)
    exact = [w / total * spare for w in weights]
    out = [1 + int(x) for x in exact]
    order = sorted(range(len(weights)), key=lambda i: (int(exact[i]) - exact[i], i))
    for i in order[: quantum - sum(out)]:
        out[i] += 1
    return out


def serve(blocks: list[int], weights: list[int | float | Fraction]) -> Iterator[int]:
    """The source of each slot: earliest deadline first among the released blocks, until no source has blocks left."""
    exact = [Fraction(w) for w in weights]
    scale = max((w.denominator for w in exact), default=1) if all(w.denominator & (w.denominator - 1) == 0 for w in exact) else math.lcm(*(w.denominator for w in exact))
    a = [int(w * scale) for w in exact]
    left, done = list(blocks), [0] * len(blocks)
    total = sum(w for w, n in zip(a, left, strict=True) if n > 0)
    # Blocks 0 are all released; by falling weight they are in the order of their deadlines in any phase.
    fresh = [(-a[i], i) for i, n in enumerate(left) if n > 0]
    heapq.heapify(fresh)
    ready: list[tuple[int, int]] = []
    waiting: list[tuple[int, int]] = []
    t = 0
    while fresh or ready or waiting:
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[i] + 1) * total // a[i]), i))
        if fresh and (not ready or (-(total // fresh[0][0]), fresh[0][1]) < ready[0]):
            i = heapq.heappop(fresh)[1]
        else:
            i = heapq.heappop(ready)[1]
        yield i
        t += 1
        done[i] += 1
        left[i] -= 1
        if left[i]:
            heapq.heappush(waiting, (done[i] * total // a[i], i))
            continue
        for _, j in (*ready, *waiting):
            done[j] = 0
            heapq.heappush(fresh, (-a[j], j))
        ready, waiting, t = [], [], 0
        total -= a[i]


def period(q: list[int]) -> list[list[int]]:
    """Slots of each source in one period of sum(q) slots, for whole weights q."""
    slots: list[list[int]] = [[] for _ in q]
    for t, i in enumerate(serve(q, q)):
        slots[i].append(t)
    return slots


def pieces(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """From (source, rows, weight or null) of every source: (source, piece, slots of its blocks)."""
    rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("_s", "_n", "_w")), strict=True)]
    rows.sort(key=lambda r: (-r[1], r[0] is not None, r[0] or ""))
    names, sizes = [s for s, _, _ in rows], [n for _, n, _ in rows]
    weights = [Fraction(w) if w and w > 0 else None for _, _, w in rows]
    if None in weights:
        least = min((w for w in weights if w), default=Fraction(1)) / 100
        rest = sum(n for n, w in zip(sizes, weights, strict=True) if not w)
        weights = [w or Fraction(float(least * n / rest)) for n, w in zip(sizes, weights, strict=True)]
    left = [-(-n // block_rows) for n in sizes]
    held: list[list[int]] = [[] for _ in rows]
    number = [0] * len(rows)
    out: tuple[list, list, list] = ([], [], [])

    def batch() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], names=["_ps", "_piece", "_slots"])
        for c in out:
            c.clear()
        return got

    for slot, i in enumerate(serve(left, weights)):
        held[i].append(slot)
        left[i] -= 1
        if len(held[i]) == PIECE or not left[i]:
            for c, x in zip(out, (names[i], number[i], held[i]), strict=True):
                c.append(x)
            held[i] = []
            number[i] += 1
            if len(out[0]) == 1000:
                yield batch()
    yield batch()


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", key: str = "doc_id", block_rows: int = BLOCK_ROWS, max_sources: int | None = None) -> DataFrame:
    """``docs`` with block, slot and place: read in the order of slot, then place, the sources are mixed to the weights.

    ``max_sources`` is accepted for callers of before and limits nothing.
    """
    spark = docs.sparkSession
    named = F.col(source).cast("string")
    counts = docs.groupBy(named.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    if weights:
        given = F.broadcast(spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "_ws string, _w double"))
        counts = counts.join(given, F.col("_s").eqNullSafe(F.col("_ws")), "left").drop("_ws")
    else:
        counts = counts.withColumn("_w", F.col("_n").cast("double") ** TEMPERATURE)
    blocks = counts.agg(F.sum(F.ceil(F.col("_n") / block_rows))).first()[0] or 0
    plan = counts.repartition(1).mapInArrow(lambda batches: pieces(batches, block_rows), "_ps string, _piece bigint, _slots array<bigint>")
    # At most a row in BUCKET_ROWS is one of these.
    large = F.broadcast(counts.where(F.col("_n") > BUCKET_ROWS).select(F.col("_s").alias("_ls"), F.ceil(F.col("_n") / BUCKET_ROWS).alias("_buckets")))
    base = docs.drop(*({"block", "slot", "place"} & set(docs.columns)))

    def dealt(rows: DataFrame) -> DataFrame:
        """With the source's name and a hash bucket of it."""
        held = rows.withColumn("_s", named).join(large, F.col("_s").eqNullSafe(F.col("_ls")), "left").drop("_ls")
        return held.withColumn("_b", F.pmod(F.xxhash64(F.lit("bucket"), F.col(key)), F.coalesce("_buckets", F.lit(1))).cast("int"))

    before = Window.partitionBy("_os").orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    each = dealt(base.select(*dict.fromkeys((source, key)))).where(F.col("_buckets").isNotNull()).groupBy(F.col("_s").alias("_os"), F.col("_b").alias("_ob")).agg(F.count(F.lit(1)).alias("_c"))
    offsets = F.broadcast(each.select("_os", "_ob", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset")))
    order = Window.partitionBy("_s", "_b").orderBy(F.xxhash64(F.col(key)), F.col(key), F.xxhash64(*base.columns))
    ranked = dealt(base).withColumn("_r", F.row_number().over(order) - 1)
    number = F.col("_r") + F.coalesce("_offset", F.lit(0))
    placed = ranked.join(offsets, F.col("_s").eqNullSafe(F.col("_os")) & (F.col("_b") == F.col("_ob")), "left").withColumns({"block": F.floor(number / block_rows).cast("long"), "place": (number % block_rows).cast("long")})
    out = placed.join(F.broadcast(plan) if blocks <= BROADCAST_BLOCKS else plan, F.col("_s").eqNullSafe(F.col("_ps")) & (F.floor(F.col("block") / PIECE).cast("long") == F.col("_piece")))
    slot = F.get(F.col("_slots"), (F.col("block") % PIECE).cast("int"))
    return out.select(*base.columns, "block", slot.cast("long").alias("slot"), "place")
