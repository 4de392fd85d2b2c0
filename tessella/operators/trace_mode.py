"""Counters of the pruned search through the genealogical trees of a graph's faces: what a depth-first engine would check.

A face's fan at its root vertex is described by the root's neighbours in order. Flipping root chord j gives a chord between the
neighbours before and after j and takes j out of the list, so a search state is that list and the chords made so far, and the
children of a state are the root chords from the last new chord's smaller end on. Conflicts are counted against the
multiset of edges and chords in use. The search is sequential by nature; graphs are spread over the cluster, one call each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def search_counters(faces: list[list[int]]) -> tuple[int, int, int, int]:
    """results, checks, successful checks and invalid traversals."""
    tally = Counter()
    used = Counter()
    for f in faces:
        used.update(_pair(f[i - 1], f[i]) for i in range(len(f)))
    if faces:
        _search_face(faces, 0, used, tally)
    return tally["results"], tally["checks"], tally["successful"], tally["invalid"]


def _pair(x: int, y: int) -> tuple[int, int]:
    return (x, y) if x <= y else (y, x)


def _root(face: list[int], used: Counter) -> int:
    low, high = 0, len(face) - 2
    while low < high - 1:
        if used[_pair(face[low], face[high])]:
            low += 1
        else:
            high -= 1
    return low


def _search_face(faces: list[list[int]], serial: int, used: Counter, tally: Counter) -> None:
    face = faces[serial]
    turn = _root(face, used)
    label = face[turn:] + face[:turn]
    own = Counter()
    clashes = 0

    def conflict(q: tuple[int, int]) -> bool:
        return q[0] == q[1] or own[q] > 0 or used[q] > 0

    def emit() -> None:
        if clashes:
            tally["invalid"] += 1
        elif serial + 1 < len(faces):
            _search_face(faces, serial + 1, used, tally)
        else:
            tally["results"] += 1

    def exchange(old: tuple[int, int], new: tuple[int, int]) -> None:
        nonlocal clashes
        own[old] -= 1
        used[old] -= 1
        clashes += conflict(new) - conflict(old)
        own[new] += 1
        used[new] += 1

    def visit(around: list[int], least: int) -> None:
        emit()
        for j in [x for x in around[1:-1] if x >= least]:
            tally["checks"] += 1
            at = around.index(j)
            before, after = around[at - 1], around[at + 1]
            new = _pair(label[before], label[after])
            if new[0] == new[1] or (used[new] and not (label[0] in new and own[new])):
                continue
            tally["successful"] += 1
            old = _pair(label[0], label[j])
            exchange(old, new)
            visit(around[:at] + around[at + 1 :], before)
            exchange(new, old)

    fan = [_pair(label[0], label[j]) for j in range(2, len(label) - 1)]
    for q in fan:
        clashes += conflict(q)
        own[q] += 1
        used[q] += 1
    visit(list(range(1, len(label))), 0)
    for q in fan:
        used[q] -= 1


def trace(graphs: DataFrame) -> DataFrame:
    """graph_id, results, checks, successful, invalid and traversals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [search_counters(f or []) for f in batch.column("faces").to_pylist()]
            r, c, s, i = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("graph_id"), *(pa.array(x, pa.int64()) for x in (r, c, s, i, [a + b for a, b in zip(r, i, strict=True)]))], names=["graph_id", "results", "checks", "successful", "invalid", "traversals"])

    return graphs.select("graph_id", "faces").mapInArrow(run, "graph_id string, results long, checks long, successful long, invalid long, traversals long")
