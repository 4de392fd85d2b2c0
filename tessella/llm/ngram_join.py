"""Jaccard self-join of documents on word 5-grams, exact at 0.75, by size-banded tiles and hashed bitmap signatures.

1. ``signatures``: one pass gives each document its set's size, fingerprint, four least hashes and a folded bitmap; equal sets become one class. The same pass names heavy shingles, those that many documents of a batch share.
2. ``_proposed``: a class proposes the leader with whom it shares most least hashes, two at least. Verified
   proposals join the bulk of a group of near copies at a cost of one pair a class.
3. ``runs``: a class is filed under the prefix of its set, which any partner must share. The order behind the prefix puts
   heavy shingles last, so passages that many documents share are looked up only where nothing rarer is left. Entries travel
   packed, with their size to a byte. The classes filed under one shingle and of fitting sizes make a run, and runs with the same least class are put together, so the many
   overlapping runs of a group of near copies count about once. Shingles with very many entries are filed in several parts.
4. ``_tiled``: only runs that hold several components are looked at. A tile has about TILE classes of a run; of a larger run
   every tile holds a part of all classes and a part of those outside its largest component. Classes stand ordered by
   size, so each is compared with its size band alone; two classes are a candidate if their bitmaps' differing bits leave room for the
   overlap that 0.75 needs. Bitmaps folded to a quarter sort out most rows first.
5. Only the classes that are left bring their full sets to their tiles, where candidates are verified by intersecting them. A candidate is
   never a row: a group of many classes that are alike but not linked takes time for its pairs, but a tile returns links alone, and
   no more than join its components.
6. Links give components. No pair, link or component is ever gathered on the driver.

``join`` gives classes and components and needs no pair inside a component; ``links`` gives every linked pair of classes.

Heavy shingles, bitmaps and proposals decide only the cost: every pair at 0.75 shares a prefix shingle under any common order,
and the bitmap bound never rejects such a pair.

Defined cases: null, empty or blank text has an empty set and is linked with nothing; fewer than five words are one shingle;
rows with a null doc_id are linked with nothing and have a null component; rows that repeat a doc_id are nodes of their own, told
apart by their sets; doc_ids of any ordered type do; texts of any length are taken whole, about CHUNK_BYTES at a time; an empty table
gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, bitmap, cut, slices
from .components import components

SHINGLE = 5
PERCENT = 75
LEAST_BITS = 512
TILE = 1024
#: A class of more shingles than this counts as several in a tile, so that a tile's sets stay within some 32 MB.
TILE_SHINGLES = 2048
#: A shingle counts as heavy if pieces of a batch in which LOCAL documents have it sum to HEAVY; the heaviest HEAVY_MOST are kept.
LOCAL, HEAVY, HEAVY_MOST = 4, 48, 1 << 18
#: Prefix entries of one packed part, and of one shingle in it.
PART_ENTRIES, SPLIT = 1_500_000, 20_000
#: Texts are hashed so many bytes at a time, for which numpy needs some 50 times the memory.
CHUNK_BYTES = 512 << 10
#: Up to so many ids select their texts as a broadcast table; beyond, a bitmap of ID_BITS bits does.
BROADCAST_IDS = 500_000
ID_BITS = 1 << 25
#: Sizes of entries are told to a factor; sets within 0.75 are at most so many steps apart.
SIZE_STEP = 1.06
SIZE_GAP = 6
#: Words of bitmaps that one vectorised comparison holds.
PAIR_WORDS = 1 << 19
_LEAST = ("h0", "h1", "h2", "h3")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each whitespace-separated word starts, and its 64-bit hash; long data in pieces that end before a separator."""
    found, at = [], 0
    while at < len(data) or not found:
        space = _SPACES.search(data, at + CHUNK_BYTES)
        end = space.start() if space else len(data)
        starts, h = _piece_hashes(data[at:end])
        found.append((starts + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]


def _piece_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[a], [True]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    lens = np.flatnonzero(~space[:-1] & space[1:]) - starts
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    body = a[~space[1:-1]]
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    place = np.arange(len(body)) - np.repeat(first, lens)
    power = np.cumprod(np.full(int(lens.max()), 0xD6E8FEB86659FD93, np.uint64))
    return starts, mix(np.add.reduceat(_BYTE[body] * power[place], first) ^ (lens.astype(np.uint64) << _U(48)))


def _sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    data = b"\n".join(t or b"" for t in texts).translate(LOWER_BYTES)
    starts, h = _word_hashes(data)
    at = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    word = np.searchsorted(starts, at)
    g = h.copy()
    for j in range(1, size):
        g = g[: max(len(h) - j, 0)] * _U(0x9E3779B97F4A7C15) + h[j:]
    g = mix(g)
    for a, b in zip(word[:-1], word[1:], strict=True):
        if b - a >= size:
            yield np.unique(g[a : b - size + 1])
        elif b > a:
            v = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                v = mix(v * _U(0x9E3779B97F4A7C15) + x)
            yield v
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; works through about CHUNK_BYTES of text at a time."""
    a = total = 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= CHUNK_BYTES or i + 1 == len(texts):
            with np.errstate(over="ignore"):
                yield from _sets(texts[a : i + 1], size)
            a, total = i + 1, 0


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def _fingerprint(s: np.ndarray, salt: int) -> tuple[int, int]:
    from hashlib import blake2b

    d = blake2b(s.tobytes(), digest_size=16, salt=salt.to_bytes(2, "big")).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def bitmap_bits(n: int) -> int:
    """Bits of the bitmap of n shingles: a power of two from 4 n on, so that sets in one another's size band differ by one step at most."""
    return max(LEAST_BITS, 1 << max(4 * n - 1, 1).bit_length())


def _bitmap(s: np.ndarray) -> bytes:
    size = bitmap_bits(len(s))
    bits = np.zeros(size, bool)
    bits[(s & _U(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _least_hashes(s: np.ndarray) -> tuple[int, ...]:
    """Four shingles that similar sets are likely to share: the least and greatest hash, and those of the lower halves."""
    if not len(s):
        return (0, 0, 0, 0)
    low = s << _U(32)
    return tuple(int(x) for x in s[[0, -1, int(low.argmin()), int(low.argmax())]].view(np.int64))


def _folded(bits: bytes) -> bytes:
    """The bitmap at a quarter of its length."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(4, -1)).tobytes()


def signatures(docs: DataFrame, key: str, text: str, salt: int) -> DataFrame:
    """Rows of documents (id, n, k, k2, small, h0 to h3) and, in between, heavy shingles of a batch (token, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            n, k, k2, bits, least, sets = [], [], [], [], [], []
            for s in shingle_sets(batch.column(1).cast(pa.binary()).to_pylist()):
                a, b = _fingerprint(s, salt)
                n.append(len(s))
                k.append(a)
                k2.append(b)
                bits.append(_bitmap(s))
                least.append(_least_hashes(s))
                sets.append(s)
            tokens, found = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = found >= LOCAL
            m, h = len(n), int(often.sum())
            longs = [n, k, k2, *(zip(*least, strict=True) if least else ([],) * 4)]
            numbers = [pa.array([*x, *[None] * h], pa.int64()) for x in longs]
            heavy = [pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(x, pa.int64())]) for x in (tokens[often].view(np.int64), found[often])]
            ids = pa.concat_arrays([batch.column(0), pa.nulls(h, batch.column(0).type)])
            small = pa.array([*map(_folded, bits), *[None] * h], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *numbers, small, *heavy], names=["id", "n", "k", "k2", *_LEAST, "small", "token", "found"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, n long, k long, k2 long, h0 long, h1 long, h2 long, h3 long, small binary, token long, found long")


def _heavy(sig: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most HEAVY_MOST shingles in order, and how many documents were seen to have them."""
    rows = sig.where("token is not null").groupBy("token").agg(F.sum("found").alias("c")).where(F.col("c") >= HEAVY).orderBy(F.desc("c"), "token").limit(HEAVY_MOST).collect()
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r["c"] for r in rows], np.int64)[order]


def _prefix(s: np.ndarray, heavy: np.ndarray, found: np.ndarray) -> np.ndarray:
    p = prefix_size(len(s))
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
        known = heavy[at] == s
        if known.any():
            return s[np.lexsort((s, np.where(known, found[at], 0)))[:p]]
    return s[:p]


def runs(docs: DataFrame, key: str, text: str, heavy: tuple[np.ndarray, np.ndarray], parts: int, salt: int) -> DataFrame:
    """Each run's classes: run, k. A run's name is its least class; a shingle with very many entries is a run of its own."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    split = SPLIT

    def ways(t: np.ndarray) -> np.ndarray:
        """In how many parts each shingle's entries are filed."""
        heavy, found = shared.value
        if not len(heavy):
            return np.ones(len(t), np.uint64)
        at = np.minimum(np.searchsorted(heavy, t), len(heavy) - 1)
        return np.where(heavy[at] == t, found[at] // split + 1, 1).astype(np.uint64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, found = shared.value
        for batch in slices(batches, text):
            tokens, members, sizes, seen = [], [], [], set()
            for s in shingle_sets(batch.column(0).cast(pa.binary()).to_pylist()):
                if len(s) and (k := _fingerprint(s, salt)[0]) not in seen:
                    seen.add(k)
                    p = _prefix(s, heavy, found)
                    tokens.append(p)
                    members.append(np.full(len(p), k, np.int64))
                    sizes.append(np.full(len(p), min(255, int(np.log(len(s)) / np.log(SIZE_STEP))), np.uint8))
            if not tokens:
                continue
            t, m, q = np.concatenate(tokens), np.concatenate(members), np.concatenate(sizes)
            with np.errstate(over="ignore"):
                part = (((t >> _U(24)) + mix(m.view(np.uint64)) % ways(t)) % _U(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, m, q = part[order], m[order], q[order]
            low = np.ascontiguousarray(t[order].view(np.uint8).reshape(-1, 8)[:, :6])
            cut_at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            spans = list(zip(cut_at[:-1], cut_at[1:], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([part[a] for a, _ in spans], pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (low, m, q))], names=["part", "tokens", "members", "sizes"])

    def file(key: tuple, packed: pa.Table) -> pa.Table:
        data = {c: b"".join(packed.column(c).to_pylist()) for c in ("tokens", "members", "sizes")}
        m, q = np.frombuffer(data["members"], np.int64), np.frombuffer(data["sizes"], np.uint8).astype(np.int16)
        t = np.zeros((len(m), 8), np.uint8)
        t[:, :6] = np.frombuffer(data["tokens"], np.uint8).reshape(-1, 6)
        t = t.view(np.uint64).ravel()
        # Shingles filed in several parts, by the six bytes that are left of them.
        heavy, found = shared.value
        many = np.isin(t, heavy[found >= split] & _U((1 << 48) - 1))
        order = np.lexsort((m, q, t))
        t, m, q, many = t[order], m[order], q[order], many[order]
        new = (t[1:] != t[:-1]) | (m[1:] != m[:-1])  # a class comes once from every batch that has it
        keep = np.concatenate([[True], new])
        t, m, q, many = t[keep], m[keep], q[keep], many[keep]
        near = (t[1:] == t[:-1]) & (q[1:] - q[:-1] <= SIZE_GAP)
        keep = many | np.concatenate([[False], near]) | np.concatenate([near, [False]])
        t, m, many = t[keep], m[keep], many[keep]
        order = np.lexsort((m, t))
        t, m, many = t[order], m[order], many[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        name = np.repeat(np.where(many[first], mix(t[first]).view(np.int64), m[first]), np.diff(np.append(first, len(t))))
        order = np.lexsort((m, name))
        name, m = name[order], m[order]
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (m[1:] != m[:-1])]) if len(m) else np.zeros(0, bool)
        return pa.table({"run": pa.array(name[new], pa.int64()), "k": pa.array(m[new], pa.int64())})

    packed = docs.where(F.col(key).isNotNull()).select(F.col(text)).mapInArrow(pack, "part int, tokens binary, members binary, sizes binary")
    return packed.groupBy("part").applyInArrow(file, "run long, k long").distinct()


class _Maps:
    """Bitmaps of many classes, as grids of equal length; longer ones can be folded to half."""

    def __init__(self, held: list[bytes]):
        self.maps = [np.frombuffer(x, np.uint64) for x in held]
        self.words = np.fromiter(map(len, self.maps), np.int64, len(held))
        self.grids: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _grid(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """All bitmaps of ``words`` words and those of twice as many folded to it, and where in the grid each class is."""
        if words not in self.grids:
            own, twice = np.flatnonzero(self.words == words), np.flatnonzero(self.words == 2 * words)
            at = np.zeros(len(self.maps), np.int64)
            at[own], at[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            rows = [self.maps[i] for i in own] + [self.maps[i][:words] | self.maps[i][words:] for i in twice]
            self.grids[words] = (np.stack(rows), at)
        return self.grids[words]

    def likeness(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The greatest similarity that sizes n <= m and bitmaps of classes i and j leave possible; 0 if it is below PERCENT."""
        out = np.zeros(len(i))
        ok = np.flatnonzero(PERCENT * m <= 100 * n)
        for words in np.unique(self.words[i[ok]]):
            grid, at = self._grid(int(words))
            of = ok[self.words[i[ok]] == words]
            step = max(1, PAIR_WORDS // int(words))
            for a in range(0, len(of), step):
                p = of[a : a + step]
                own, other = grid[at[i[p]]], grid[at[j[p]]]
                differ = own ^ other
                lost = np.bitwise_count(differ & own).sum(1, dtype=np.int64)
                more = np.bitwise_count(differ & other).sum(1, dtype=np.int64)
                most = np.minimum(n[p] - lost, m[p] - more)
                out[p] = np.where((100 + PERCENT) * most >= PERCENT * (n[p] + m[p]), most / (n[p] + m[p] - most), 0.0)
        return out


#: A linked pair of classes. In mode "near" a run and a class of it that has a candidate.
_PAIR = "a long, b long"


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(low) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([pa.array(low[new], pa.int64()), pa.array(high[new], pa.int64())], names=["a", "b"])


class _Sets:
    """The sets of many classes, their shingles numbered, for the exact intersections of one with others."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.fromiter(map(len, sets), np.int64, len(sets))
        tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.own = np.split(at.astype(np.int32), np.cumsum(self.n)[:-1])
        self.mark = np.zeros(len(tokens), bool)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others whose similarity to i reaches PERCENT."""
        self.mark[self.own[i]] = True
        out = []
        for part in np.split(others, np.flatnonzero(np.diff(np.cumsum(self.n[others]) // (8 * PAIR_WORDS))) + 1):
            n = self.n[part]
            common = np.add.reduceat(self.mark[np.concatenate([self.own[j] for j in part])], np.cumsum(n) - n, dtype=np.int64)
            out.append(part[(100 + PERCENT) * common >= PERCENT * (self.n[i] + n)])
        self.mark[self.own[i]] = False
        return np.concatenate(out)


def _proposed(reps: DataFrame) -> DataFrame:
    """For each class the leader with whom it shares most of the least hashes, two at least: pairs (a, b)."""
    keys = reps.select("k", "n", F.posexplode(F.array(*_LEAST)).alias("j", "h"))
    leaders = keys.groupBy("j", "h").agg(F.min_by(F.struct("k", "n"), F.xxhash64("k")).alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").select("j", "h", "lead")
    fits = (F.col("k") != F.col("lead.k")) & (F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * PERCENT)
    shared = keys.join(leaders, ["j", "h"]).where(fits).groupBy("k", F.col("lead.k").alias("other")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    best = shared.groupBy("k").agg(F.max_by("other", F.struct("c", "other")).alias("other"))
    return best.select(F.least("k", "other").alias("a"), F.greatest("k", "other").alias("b")).distinct()


def _tile_pairs(mode: str):
    """Links of whole tiles (tile, run, role, k, n, label, held), which stand one after another, ordered by size."""

    def pairs(tile, run, role, k, n, label, held) -> pa.RecordBatch:
        sets = None if mode == "near" else [np.frombuffer(x, np.uint64) for x in held]
        maps = _Maps(held if sets is None else [_bitmap(x) for x in sets])
        exact = sets and _Sets(sets)
        # Rows of one tile within the size band of each row, behind it.
        at = np.cumsum(np.concatenate([[0], tile[1:] != tile[:-1]]))
        step = int(n.max()) * 2 + 1
        end = np.searchsorted(at * step + n, at * step + np.minimum(n * 100 // PERCENT, step - 1), "right")
        count = np.maximum(end - np.arange(len(k)) - 1, 0)
        group = np.unique(label, return_inverse=True)[1]
        found: list[tuple] = [(np.zeros(0, np.int64),) * 2]
        before = np.concatenate([[0], np.cumsum(count)])
        a = 0
        while a < len(k):
            b = max(a + 1, int(np.searchsorted(before, before[a] + PAIR_WORDS // 2, "right")) - 1)
            i = np.repeat(np.arange(a, b), count[a:b])
            j = np.arange(len(i)) - np.repeat(before[a:b] - before[a], count[a:b]) + i + 1
            ok = (group[i] != group[j]) & (((role[i] & 1) & (role[j] >> 1)) | ((role[i] >> 1) & (role[j] & 1)) == 1)
            i, j = i[ok], j[ok]
            hit = maps.likeness(i, j, n[i], n[j]) > 0
            i, j = i[hit], j[hit]
            if mode == "near":
                found.append((i, j))
            else:
                ones, first = np.unique(i, return_index=True)
                for one, others in zip(ones, np.split(j, first[1:]), strict=True) if len(ones) else ():
                    if mode == "forest":  # what is joined meanwhile needs no further link
                        others = others[group[others] != group[one]]
                    if len(others) and len(others := exact.linked(one, others)):
                        if mode == "forest":
                            joined, least = np.unique(group[others], return_index=True)
                            others = others[least]
                            group[np.isin(group, joined)] = group[one]
                        found.append((np.full(len(others), one), others))
            a = b
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        if mode == "near":
            at_rows = np.unique(np.concatenate([i, j]))
            return pa.RecordBatch.from_arrays([pa.array(run[at_rows], pa.int64()), pa.array(k[at_rows], pa.int64())], names=["a", "b"])
        return _pair_batch(k[i], k[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        rows = size = 0

        def ready(table: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = [table.column(x).to_numpy() for x in ("tile", "run", "role", "k", "n", "label")]
            starts = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))
            piece = np.cumsum(columns[4])[starts] // (TILE * TILE_SHINGLES)
            cuts = [0, *starts[1:][piece[1:] != piece[:-1]].tolist(), table.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield pairs(*(x[a:b] for x in columns), table.column("held").slice(a, b - a).to_pylist())

        for batch in batches:
            rest.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= 4 * TILE or size >= 8 * TILE * TILE_SHINGLES:
                table = pa.Table.from_batches(rest)
                tile = table.column("tile").to_numpy()
                last = int(np.flatnonzero(tile != tile[-1])[-1]) + 1 if tile[0] != tile[-1] else 0
                if last:
                    yield from ready(table.slice(0, last))
                rest = table.slice(last).to_batches()
                rows, size = len(tile) - last, sum(x.nbytes for x in rest)
        if rows:
            yield from ready(pa.Table.from_batches(rest))

    return run


def _tiled(members: DataFrame, labels: DataFrame | None, tile: DataFrame, mode: str) -> DataFrame:
    """Links (a, b) between components, from runs that hold several: all ("every") or those that join them ("forest"), both from
    ``tile`` (k, n, held) with full sets. Or, from bitmaps, the rows of runs that have any candidate ("near")."""
    own = members.withColumn("label", F.col("k")) if labels is None else members.join(labels, F.col("k") == F.col("node"), "left").withColumn("label", F.coalesce("label", "k")).drop("node")
    if mode == "near":
        own = own.withColumn("w", F.lit(1))
    else:
        own = own.join(tile.select("k", F.ceil(F.col("n") / TILE_SHINGLES).alias("w")), "k")
    held = own.groupBy("run", "label").agg(F.sum("w").alias("c"))
    held = held.groupBy("run").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("most")).where(F.col("most.c") < F.col("all"))
    mixed = own.join(held.select("run", "all", F.col("most.label").alias("main"), (F.col("all") - F.col("most.c")).alias("few")), "run")
    parts = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    place = lambda c: F.pmod(F.xxhash64("k"), parts(c)).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    small = mixed.where(F.col("all") <= TILE).select("run", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(3).alias("role"), "k", "label")
    large = mixed.where(F.col("all") > TILE)
    of_all = large.select("run", place("all").alias("i"), upto("few").alias("j"), F.lit(1).alias("role"), "k", "label")
    of_few = large.where(F.col("label") != F.col("main")).select("run", upto("all").alias("i"), place("few").alias("j"), F.lit(2).alias("role"), "k", "label")
    rows = small.unionByName(of_all).unionByName(of_few).join(tile, "k").select(F.xxhash64("run", "i", "j").alias("tile"), "run", "role", "k", "n", "label", "held")
    return rows.repartition("tile").sortWithinPartitions("tile", "n", "k").mapInArrow(_tile_pairs(mode), _PAIR).distinct()


def _texts_of(docs: DataFrame, key: str, text: str, wanted: DataFrame, most: int) -> DataFrame:
    """Rows (id, t) of the ids wanted, of which there are ``most`` at most; beyond BROADCAST_IDS some others come along."""
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    if most <= BROADCAST_IDS:
        return texts.join(F.broadcast(wanted), "id", "left_semi")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(place("id").alias("p")), "p", ID_BITS))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            yield batch.filter(pa.array((shared.value[at // 64] >> (at % 64)) & 1 == 1)).drop_columns(["p"])

    return texts.select("id", "t", place("id").alias("p")).mapInArrow(chosen, f"id {kind}, t string")


def _sets_of(docs: DataFrame, key: str, text: str, classes: DataFrame, reps: DataFrame, salt: int) -> DataFrame:
    """The full sets of the classes (column k), one row each: k, n, held (sorted hashes of eight bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", most=2 << 20):
            sets = list(shingle_sets(batch.column(1).cast(pa.binary()).to_pylist()))
            k = pa.array([_fingerprint(s, salt)[0] for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([k, pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["k", "n", "held"])

    wanted = cut(reps.join(classes.select("k").distinct(), "k", "left_semi").select("k", "id"))
    texts = _texts_of(docs, key, text, wanted.select("id").distinct(), wanted.count())
    # A repeated doc_id brings its other texts too, and a text may come twice.
    return cut(texts.mapInArrow(run, "k long, n long, held binary").join(wanted.select("k"), "k", "left_semi").dropDuplicates(["k"]))


def _verified(docs: DataFrame, key: str, text: str, pairs: DataFrame, reps: DataFrame, salt: int) -> DataFrame:
    """The pairs (a, b) whose sets reach PERCENT, by exact intersection of the sorted sets of both texts.

    Texts travel, not sets, as they pack better; and only those concerned.
    """
    named = pairs.join(reps.select(F.col("k").alias("a"), F.col("id").alias("ia")), "a").join(reps.select(F.col("k").alias("b"), F.col("id").alias("ib")), "b")
    named = cut(named.select("a", "b", "ia", "ib"))
    wanted = named.select(F.explode(F.array("ia", "ib")).alias("id")).distinct()
    texts = _texts_of(docs, key, text, wanted, named.count() * 2)

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ta", "tb"):
            ok = []
            a, b = (batch.column(x).to_pylist() for x in ("a", "b"))
            sets = [shingle_sets(batch.column(x).cast(pa.binary()).to_pylist()) for x in ("ta", "tb")]
            for x, y, u, v in zip(a, b, *sets, strict=True):
                common = len(np.intersect1d(u, v, assume_unique=True))
                # A doc_id that repeats with another text brings that text too; it is not this pair's.
                ok.append((100 + PERCENT) * common >= PERCENT * (len(u) + len(v)) and _fingerprint(u, salt)[0] == x and _fingerprint(v, salt)[0] == y)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = named.join(texts.select(F.col("id").alias("ib"), F.col("t").alias("tb")), "ib")
    both = left.join(texts.select(F.col("id").alias("ia"), F.col("t").alias("ta")), "ia")
    return both.select("a", "b", "ta", "tb").mapInArrow(intersect, "a long, b long").distinct()


def _prepared(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, int, np.ndarray]:
    """Signatures of all documents, one row a class, the salt that keeps fingerprints apart, and heavy shingles."""
    for salt in range(8):
        sig = cut(signatures(docs, key, text, salt))
        of_docs = sig.where("k is not null")
        nodes = of_docs.where("id is not null and n > 0")
        first = [F.first(c).alias(c) for c in ("n", "small", *_LEAST)]
        reps = cut(nodes.groupBy("k").agg(F.min("id").alias("id"), *first, (F.min("k2") != F.max("k2")).alias("clash")))
        if not reps.where("clash").limit(1).count():
            break
    return of_docs, reps.drop("clash"), salt, _heavy(sig)


def _members(docs: DataFrame, key: str, text: str, reps: DataFrame, heavy, salt: int) -> DataFrame:
    entries = reps.agg(F.sum(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)).first()[0] or 0
    return cut(runs(docs, key, text, heavy, max(16, -(-int(entries) // PART_ENTRIES)), salt))


def _near(members: DataFrame, labels: DataFrame | None, reps: DataFrame) -> DataFrame:
    """The rows of runs (run, k) that have a candidate outside their component by the folded bitmaps."""
    near = _tiled(members, labels, reps.select("k", "n", F.col("small").alias("held")), "near")
    return near.select(F.col("a").alias("run"), F.col("b").alias("k"))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole join: linked pairs (a, b) of different classes, and the class_id of every document (doc_id, n_shingles, class_id)."""
    of_docs, reps, salt, heavy = _prepared(docs, key, text)
    near = cut(_near(_members(docs, key, text, reps, heavy, salt), None, reps))
    return _tiled(near, None, _sets_of(docs, key, text, near, reps, salt), "every"), of_docs.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("k").alias("class_id"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (fingerprint of its set) and component_id."""
    of_docs, reps, salt, heavy = _prepared(docs, key, text)
    members = _members(docs, key, text, reps, heavy, salt)
    found = cut(_verified(docs, key, text, cut(_proposed(reps)), reps, salt))
    labels = components(found)
    near = cut(_near(members, labels, reps))
    if near.limit(1).count():
        found = found.unionByName(cut(_tiled(near, labels, _sets_of(docs, key, text, near, reps, salt), "forest")))
        labels = components(found)

    placed = labels.join(reps.select(F.col("k").alias("node"), "id"), "node")
    least = placed.groupBy("label").agg(F.min("id").alias("component"))
    by_class = placed.join(least, "label").select(F.col("node").alias("k"), "component")
    owned = reps.select("k", "id").join(by_class, "k", "left").select("k", F.coalesce("component", "id").alias("component"))
    joined = of_docs.select("id", "n", "k").join(owned, "k", "left")
    component = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.col("component"))
    return joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("k").alias("class_id"), component.alias("component_id"))


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller doc_id, and one row of each repeated doc_id.

    Rows with a null doc_id and with empty sets stay.
    """
    found = cut(join(docs, key, text).where("n_shingles > 0").select(F.col(key).alias("_id"), "component_id").where("_id is not null"))
    several = found.groupBy("_id").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("component_id") < F.col("_id")).alias("later"))
    marked = cut(several.where("later or c > 1").select("_id", "later"))
    if marked.count() <= BROADCAST_IDS:
        marked = F.broadcast(marked)
    kept = docs.join(marked.where("later").select("_id"), docs[key] == F.col("_id"), "left_anti")
    if not marked.where("not later").limit(1).count():
        return kept
    repeated = marked.where("not later").select("_id")
    once = kept.join(repeated, kept[key] == F.col("_id"), "left_semi").dropDuplicates([key])
    return kept.join(repeated, kept[key] == F.col("_id"), "left_anti").unionByName(once)
