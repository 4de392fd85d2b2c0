"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

All reads are right-aligned at their end marks. Round j puts one more symbol of every read in front of its suffix of length
j - 1; where the longer suffix belongs follows from counting symbols in the transform, and the common prefixes of the touched neighbours
follow from a range minimum of the old ones. The transform and the prefixes are two sequences that each round reads from
front to back and writes anew; they can live in files (``folder``) or, for a small collection, in memory.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


class _Sequence:
    """A sequence that is read whole and replaced each round: a file that is rewritten beside and renamed, or an array."""

    def __init__(self, path: str | None, dtype):
        self.path, self.dtype, self.held = path, np.dtype(dtype), None

    def read(self) -> np.ndarray:
        return self.held if self.path is None else np.fromfile(self.path, self.dtype)

    def write(self, values: np.ndarray) -> None:
        if self.path is None:
            self.held = values
        else:
            values.astype(self.dtype, copy=False).tofile(self.path + ".new")
            os.replace(self.path + ".new", self.path)


def build(reads: list[bytes], folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transform (symbols numbered from 1, 0 before a read's start), the common prefix of each row with the one above,
    and ``step``: the row of a suffix's one-longer suffix, by which rows are traced back to reads."""
    m = len(reads)
    lens = np.fromiter(map(len, reads), np.int64, m)
    data = np.frombuffer(b"".join(reads), np.uint8)
    used = np.zeros(256, bool)
    used[data] = True
    number = np.zeros(256, np.uint8)
    if used.all():
        raise ValueError("all 256 byte values are used; one must be free for the end mark")
    number[used] = np.arange(1, int(used.sum()) + 1)
    data = number[data]
    ends = np.cumsum(lens)
    with tempfile.TemporaryDirectory(dir=folder) if folder else _Nothing() as place:
        bwt, lcp = (_Sequence(f"{place}/{x}" if place else None, t) for x, t in (("bwt", np.uint8), ("lcp", np.uint16)))

        def symbol(j: int, who: np.ndarray) -> np.ndarray:
            """The symbol before the suffix of length j."""
            return np.where(lens[who] > j, data[np.maximum(ends[who] - j - 1, 0)] if len(data) else 0, 0).astype(np.uint8)

        active = np.arange(m)
        rows = np.arange(m)
        bwt.write(symbol(0, active))
        lcp.write(np.zeros(m, np.uint16))
        for j in range(1, int(lens.max(initial=0)) + 1):
            b, p = bwt.read(), lcp.read()
            go = lens[active] >= j
            active, rows = active[go], rows[go]
            order = np.argsort(b, kind="stable")
            zeros = len(b) - np.count_nonzero(b)
            owner = np.full(len(b), -1, np.int32)
            owner[rows] = np.arange(len(rows))
            own = owner[order]
            k = np.flatnonzero(own >= 0)  # places among the symbols in order; row of the new suffix: m + k - zeros
            who = own[k]
            new = m + k - zeros
            # Common prefixes change at the new rows and at those that follow them.
            touched = np.unique(np.concatenate([k, k + 1]))
            touched = touched[touched < len(order)]
            a, z = order[touched - 1], order[touched]
            same = (touched > zeros) & (b[a] == b[z])
            value = np.zeros(len(touched), np.uint16)
            a, z = a[same], z[same]
            size = z - a
            if len(size):
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                within = np.arange(int(size.sum())) + np.repeat(a + 1 - first, size)
                value[same] = np.minimum.reduceat(p[within], first) + 1
            grown = np.empty(m + len(order) - zeros, np.uint8)
            prefix = np.empty(len(grown), np.uint16)
            keep = np.ones(len(grown), bool)
            keep[new] = False
            grown[keep], prefix[keep] = b, p
            active = active[who]
            grown[new] = symbol(j, active)
            prefix[m + touched - zeros] = value
            rows = new
            bwt.write(grown)
            lcp.write(prefix)
        b, p = bwt.read(), lcp.read()
    step = np.empty(len(b), np.int64)
    order = np.argsort(b, kind="stable")
    step[order] = m + np.arange(len(b)) - (len(b) - np.count_nonzero(b))
    return b, p, step


class _Nothing:
    def __enter__(self):
        return None

    def __exit__(self, *_):
        return False


def repeated_starts(reads: list[bytes], length: int, folder: str | None = None) -> list[np.ndarray]:
    """For each read, where a string of ``length`` starts that starts anywhere else in the collection too."""
    b, p, step = build(reads, folder)
    hit = p >= length
    hit[:-1] |= hit[1:]
    lens = np.fromiter(map(len, reads), np.int64, len(reads))
    active, rows, found = np.arange(len(reads)), np.arange(len(reads)), []
    for j in range(1, int(lens.max(initial=0)) + 1):
        go = lens[active] >= j
        active, rows = active[go], step[rows[go]]
        if j >= length:
            at = np.flatnonzero(hit[rows])
            found.append((active[at], lens[active[at]] - j))
    who = np.concatenate([w for w, _ in found]) if found else np.zeros(0, np.int64)
    at = np.concatenate([a for _, a in found]) if found else np.zeros(0, np.int64)
    order = np.lexsort((at, who))
    return np.split(at[order], np.searchsorted(who[order], np.arange(1, len(reads))))
