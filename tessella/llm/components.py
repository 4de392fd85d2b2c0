"""Connected components of a table of links.

Links are first contracted within parts of at most ``PART`` links: union-find in numpy leaves each part a forest of stars. If they fit one
part, that is the answer. Otherwise alternating large-star and small-star steps join the parts' stars; each step
sends rows to smaller neighbours only, and the loop ends with a step that changes nothing. Every step is checkpointed, so lineage stays short and a
lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links of one part: 16 bytes each, and some copies of them.
PART = 1_000_000


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the least of each component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new[new]
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("u", "v"))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(a, b)], names=["u", "v"])


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node are linked to its least neighbour; no adjacency list is gathered, least neighbours are joined back."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"))
    return both.join(least, F.col("u") == F.col("w")).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node are linked to the least of them."""
    lowest = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    rest = edges.join(lowest, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(lowest.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (its component's least node) for every node of ``links`` (columns a, b; checkpointed)."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    parts = max(1, -(-links.count() // PART))
    edges = cut((edges.coalesce(1) if parts == 1 else edges.repartition(parts)).mapInArrow(_contract, "u long, v long"))
    before = state(edges) if parts > 1 else None
    while before and before[0]:
        edges = cut(_small(cut(_large(edges))))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
