"""Removal of every byte that a string of ``LENGTH`` bytes covers which also starts anywhere else in the corpus.

The decision is made on the Burrows-Wheeler transform and common prefixes of a collection of reads, built column by column
(``bcr``). Such a construction takes one round per symbol of the longest read and rewrites everything in each round, so whole
documents cannot be its reads. Three exact steps make short reads of them:

* Every window of LENGTH bytes names one anchor, the least hash among its ``GRAM``-byte strings (the first, if tied). Equal windows
  name equal anchors, so only windows whose anchor occurs twice can repeat. The windows of one anchor, one after another, make a
  stretch; equal stretches of an anchor are settled at once: all their windows repeat.
* The stretches of an anchor that has different ones are cut into groups of ``FINE`` windows, at fixed places from the anchor. All
  windows of a group hold its core, the ``LENGTH - FINE + 1`` bytes common to them, so only groups with equal cores can share
  a window. Equal groups are settled.
* For different groups of one core, the core becomes one symbol, written in bytes that no UTF-8 text has. What is left are reads
  of some tens of symbols, whose transform and common prefixes tell which windows repeat.

A core with more than ``HOT`` different groups (a passage that very many documents share, with other text around it) is taken apart into
single windows, which only equality decides, and equal entries of one batch are merged before they travel; so no group that
one task gathers grows with the corpus. Entries travel packed. Texts from which something is removed are chosen by a bitmap of
content hashes, so texts without repeats are not shuffled. Documents are told apart by their content; equal texts share one result.

Passages of ``PASSAGE`` bytes that repeat, but not for LENGTH bytes, are found by the same construction first; they are counted and
stay. Only texts that hold such a passage can hold a repeated string of LENGTH bytes, so only those are looked at again.

Defined cases: null text is empty; texts shorter than LENGTH keep all bytes; matches never cross documents; repeated
rows and null ids are judged by their texts like others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .bcr import repeated_starts
from .common import bitmap, cut, slices
from .ngram_join import mix

LENGTH, PASSAGE = 400, 256
#: Anchors have this share of a window's bytes.
GRAM_SHARE = 0.5
FINE = 32
HOT = 20_000
#: Reads of one construction.
READS = 30_000
PART_ENTRIES = 250_000
PIECE = 1 << 20
BITS = 1 << 25

_U = np.uint64
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
#: An entry: key, hash of all its bytes, the content's hash (96 bits), first window, number of windows, and 2 if it stands for more.
ENTRY = np.dtype([("k", "<u8"), ("r", "<u8"), ("c1", "<i8"), ("c2", "<i4"), ("at", "<i4"), ("n", "<u2"), ("m", "u1")])


def group_dtype(fine: int) -> np.dtype:
    """An entry with the bytes before and after its core, and how many of them are before it."""
    return np.dtype([*ENTRY.descr, ("before", "u1"), ("flanks", "u1", (2 * fine - 2,))])


def content_hash(text: bytes) -> tuple[int, int]:
    d = blake2b(text, digest_size=12).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _is_set(bits: np.ndarray, number: int) -> bool:
    p = number % BITS
    return bool(bits[p // 64] >> (p % 64) & 1)


def _hash64(data: bytes) -> int:
    return xxh3_64_intdigest(data)


_POWER = 0xD6E8FEB86659FD93
#: Bits of a value in which the place of a least hash is kept.
_PLACE = 22


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and those of its inverse."""
    out = []
    for x in (_POWER, pow(_POWER, -1, 1 << 64)):
        steps = np.full(n + 1, x, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def _gram_hashes(a: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all strings of ``gram`` bytes, as differences of a running sum."""
    up, down = _powers(1 << max(len(a), PIECE).bit_length())
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    return mix((total[gram:] - total[: len(total) - gram]) * down[: len(total) - gram])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the least of the next ``width`` values is, the first if tied; values count without their last _PLACE bits."""
    n = len(v) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = _U((1 << _PLACE) - 1)
    w = np.full(-(-len(v) // width) * width, _U(0xFFFFFFFFFFFFFFFF))
    w[: len(v)] = (v & ~low) | np.arange(len(v), dtype=np.uint64)
    blocks = w.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def anchors(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: its number and, for each run of windows with one anchor, first window, last window, anchor's place and hash.

    Works through about PIECE bytes at a time; longer texts are taken in pieces that overlap by a window less one byte.
    """
    pieces = [(i, a) for i, t in enumerate(texts) if len(t) >= length for a in range(0, len(t) - length + 1, PIECE)]
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for j, (i, a) in enumerate(pieces):
        group.append((i, a, texts[i][a : a + PIECE + length - 1]))
        size += len(group[-1][2])
        if size >= PIECE or j + 1 == len(pieces):
            data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
            with np.errstate(over="ignore"):
                h = _gram_hashes(data, gram)
            least = _least(h, length - gram + 1)
            start = 0
            for doc, base, piece in group:
                own = least[start : start + len(piece) - length + 1]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                last = np.append(first[1:], len(own)) - 1
                place = own[first]
                yield doc, first + base, last + base, place - start + base, h[place]
                start += len(piece)
            group, size = [], 0


def _stretches(texts: list[bytes], length: int, gram: int) -> np.ndarray:
    """Level 1: one entry per stretch, keyed by its anchor."""
    out = []
    contents = [content_hash(t) for t in texts]
    for doc, first, last, _, k in anchors(texts, length, gram):
        t, (c1, c2) = texts[doc], contents[doc]
        e = np.empty(len(k), ENTRY)
        e["k"], e["at"], e["n"], e["c1"], e["c2"], e["m"] = k, first, last - first + 1, c1, c2, 1
        e["r"] = [_hash64(t[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        out.append(e)
    return np.concatenate(out) if out else np.empty(0, ENTRY)


def _groups(texts: list[bytes], length: int, gram: int, fine: int, wanted: np.ndarray, crowded: np.ndarray | None) -> np.ndarray:
    """Level 2: one entry per group of ``fine`` windows of the wanted anchors, keyed by its core. With ``crowded`` level 3: one
    entry per window of the crowded cores."""
    kind = ENTRY if crowded is not None else group_dtype(fine)
    rows: list[tuple] = []
    contents = [content_hash(t) for t in texts]
    pad = bytes(2 * fine - 2)
    for doc, first, last, place, k in anchors(texts, length, gram):
        low = (k & _U(BITS - 1)).astype(np.int64)
        for i in np.flatnonzero((wanted[low // 64] >> (low % 64)) & 1):
            t, (c1, c2) = texts[doc], contents[doc]
            p, a, z, salt = int(place[i]), int(first[i]), int(last[i]), b"%d " % int(k[i])
            for g in range((p - z) // fine, (p - a) // fine + 1):
                core = p - fine * g
                end = core + length - fine + 1
                lo, hi = max(a, core - fine + 1), min(z, core)
                key = _hash64(salt + b"%d " % g + t[core:end])
                if crowded is None:
                    around = t[lo:core] + t[end : hi + length]
                    rows.append((key, _hash64(around + b"%d" % (core - lo)), c1, c2, lo, hi - lo + 1, 1, core - lo, np.frombuffer(around + pad[len(around) :], np.uint8)))
                elif crowded[key % BITS // 64] >> (key % 64) & 1:
                    for w in range(lo, hi + 1):
                        own = _hash64(b"%d " % key + t[w : w + length])
                        rows.append((own, own, c1, c2, w, 1, 1))
    return np.array(rows, kind) if rows else np.empty(0, kind)


def _runs(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted entries: which read each is, each read's first entry, how many it stands for, and each read's key number."""
    new_k = np.concatenate([[True], e["k"][1:] != e["k"][:-1]]) if len(e) else np.zeros(0, bool)
    new_r = new_k | (np.concatenate([[True], e["r"][1:] != e["r"][:-1]]) if len(e) else new_k)
    read, first = np.cumsum(new_r) - 1, np.flatnonzero(new_r)
    return read, first, np.bincount(read, e["m"], minlength=len(first)), (np.cumsum(new_k) - 1)[first]


#: Windows at..at+n-1 of a content.
RUN = np.dtype([("c1", "<i8"), ("c2", "<i4"), ("at", "<i4"), ("n", "<u2")])


def _as_runs(e: np.ndarray) -> np.ndarray:
    out = np.empty(len(e), RUN)
    for f in RUN.names:
        out[f] = e[f]
    return out


def _packed(docs: DataFrame, text: str, parts: int, make, among=None) -> DataFrame:
    """Entries of all texts, or of those whose content's bit is set in ``among``, in rows (part, entries). Equal ones of a batch are settled here: one of them goes on and stands
    for two, and the windows of all go to parts of their own, which are numbered from ``parts`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            e = make([t for t in batch.column(0).cast(pa.binary()).to_pylist() if t and (among is None or _is_set(among.value, content_hash(t)[0]))])
            e = e[np.lexsort((e["r"], e["k"]))]
            read, first, count, _ = _runs(e)
            again = _as_runs(e[count[read] > 1])
            e = e[first]
            e["m"] = np.minimum(count, 2)
            rows = []
            for part, x in ((((e["k"] >> _U(48)) % _U(parts)).astype(np.int32), e), ((again["c1"] % parts).astype(np.int32) + parts, again)):
                order = np.argsort(part, kind="stable")
                x, part = x[order], part[order]
                at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(x) else np.zeros(1, np.int64)
                rows += [(int(part[i]), x[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "entries"])

    return docs.select(F.col(text)).mapInArrow(run, "part int, entries binary")


#: kind 0: windows at..at+n-1 of a content repeat; 1: an open key, to be looked at more finely.
_FILED = "kind int, k long, c1 long, c2 int, at long, n long"


def _filed(packed: DataFrame, parts: int, kind: np.dtype, decide) -> DataFrame:
    """Settle equal entries of every part; ``decide(entries, read, first, count, key)`` says what of the rest repeats and what is open."""

    def file(key: tuple, table: pa.Table) -> pa.Table:
        data = b"".join(table.column("entries").to_pylist())
        if key[0].as_py() >= parts:
            sure, open_ = np.frombuffer(data, RUN), np.zeros(0, np.uint64)
        else:
            e = np.frombuffer(data, kind)
            e = e[np.lexsort((e["r"], e["k"]))]
            runs = _runs(e)
            more, open_ = decide(e, *runs)
            sure = np.concatenate([_as_runs(e[runs[2][runs[0]] > 1]), more])
        a, c = len(sure), len(open_)
        zero = np.zeros(c, np.int64)
        cols = {"kind": np.repeat([0, 1], [a, c]).astype(np.int32), "k": np.concatenate([np.zeros(a, np.int64), open_.view(np.int64)])}
        cols |= {f: np.concatenate([sure[f], zero]).astype(np.int32 if f == "c2" else np.int64) for f in RUN.names}
        return pa.table({f: pa.array(x) for f, x in cols.items()})

    return packed.groupBy("part").applyInArrow(file, _FILED)


def _open_anchors(e, read, first, count, key):
    """Anchors with different stretches."""
    many = np.bincount(key, minlength=int(key.max(initial=-1)) + 1)[key] > 1
    return np.empty(0, RUN), np.unique(e["k"][first[many]])


def _none_open(e, read, first, count, key):
    return np.empty(0, RUN), np.zeros(0, np.uint64)


def _code(i: int) -> bytes:
    """A number below 8**5 in five bytes that no UTF-8 text has."""
    return bytes(0xF8 | (i >> s & 7) for s in (12, 9, 6, 3, 0))


def _construction(fine: int, hot: int):
    """Windows that repeat between different groups of one core, by the transform; cores with more than ``hot`` groups stay open."""

    def decide(e, read, first, count, key):
        size = np.bincount(key, minlength=int(key.max(initial=-1)) + 1)
        many, crowd = (size[key] > 1) & (size[key] <= hot), size[key] > hot
        pick = first[many]
        out, cuts, at = [], [0], 0
        numbers = key[many]
        for i in range(1, len(pick) + 1):  # whole cores to a construction, up to READS reads and 8**5 cores
            if i == len(pick) or (numbers[i] != numbers[i - 1] and i - at >= READS):
                cuts.append(i)
                at = i
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = e[pick[a:b]]
            number = np.unique(numbers[a:b], return_inverse=True)[1]
            reads = []
            for x, n in zip(own, number, strict=True):
                flanks, before = x["flanks"].tobytes(), int(x["before"])
                reads.append(flanks[:before] + _code(int(n)) + flanks[before : int(x["n"]) - 1 + fine - 1])
            for x, starts, c in zip(own, repeated_starts(reads, fine - 1 + 5), count[many][a:b], strict=True):
                if c == 1 and len(starts):
                    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
                    got = np.empty(len(new), RUN)
                    got["c1"], got["c2"], got["at"], got["n"] = x["c1"], x["c2"], x["at"] + starts[new], np.diff(np.append(new, len(starts)))
                    out.append(got)
        return np.concatenate(out) if out else np.empty(0, RUN), np.unique(e["k"][first[crowd]])

    return decide


def repeated_windows(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int | None = None, hot: int = HOT, fine: int = FINE, among=None) -> DataFrame:
    """Windows of ``length`` bytes that start more than once: runs (c1, c2, at, n) by content."""
    spark = docs.sparkSession
    gram = gram or max(1, int(length * GRAM_SHARE))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # One anchor in about (length - gram + 1) / 2 bytes.
    parts = max(16, -(-int(total) * 2 // ((length - gram + 1) * PART_ENTRIES)))
    place = lambda df: bitmap(df.where("kind = 1").select(F.pmod("k", F.lit(BITS)).alias("p")).distinct(), "p", BITS)
    every = level = cut(_filed(_packed(docs, text, parts, lambda t: _stretches(t, length, gram), among), parts, ENTRY, _open_anchors))
    if level.where("kind = 1").limit(1).count():
        wanted = spark.sparkContext.broadcast(place(level))
        level = cut(_filed(_packed(docs, text, parts, lambda t: _groups(t, length, gram, fine, wanted.value, None), among), parts, group_dtype(fine), _construction(fine, hot)))
        every = every.unionByName(level)
        if level.where("kind = 1").limit(1).count():
            crowded = spark.sparkContext.broadcast(place(level))
            every = every.unionByName(cut(_filed(_packed(docs, text, parts, lambda t: _groups(t, length, gram, fine, wanted.value, crowded.value), among), parts, ENTRY, _none_open)))
    return every.where("kind = 0").select("c1", "c2", "at", "n")


def _spans(runs: list[dict] | None, length: int) -> list[list[int]]:
    """The bytes that windows cover, as disjoint spans that do not touch."""
    spans: list[list[int]] = []
    for a, n in sorted((r["at"], r["n"]) for r in runs or ()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], a + n - 1 + length)
        else:
            spans.append([a, a + n - 1 + length])
    return spans


def _kept(text: bytes, spans: list[list[int]]) -> str:
    """Hash of the bytes outside the spans."""
    rest, at = sha256(), 0
    for a, b in spans:
        rest.update(memoryview(text)[at:a])
        at = b
    rest.update(memoryview(text)[at:])
    return rest.hexdigest()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, passage: int = PASSAGE, **settings) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans and kept_sha256; and n_repeated, the bytes that strings of ``passage`` bytes
    cover which start anywhere else too, removed or not."""
    spark = docs.sparkSession
    short = cut(repeated_windows(docs, text, passage, **settings).distinct())
    place = lambda df: spark.sparkContext.broadcast(bitmap(df.select("c1").distinct().select(F.pmod("c1", F.lit(BITS)).alias("p")), "p", BITS))
    with_short = place(short)
    long = cut(repeated_windows(docs, text, length, among=with_short, **settings).distinct()) if length > passage else short
    with_long = place(long)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1, c2, n, sha, kept = [], [], [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                t = t or b""
                a, b = content_hash(t)
                passed = _is_set(with_long.value, a)
                c1.append(a)
                c2.append(b)
                n.append(len(t))
                kept.append(t if passed else None)
                sha.append(None if passed else sha256(t).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c1, pa.int64()), pa.array(c2, pa.int32()), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], names=[key, "c1", "c2", "n_bytes", "t", "sha"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text).mapInArrow(opened, f"`{key}` {kind}, c1 long, c2 int, n_bytes long, t binary, sha string")
    windows = long.withColumn("whole", F.lit(True)).unionByName(short.withColumn("whole", F.lit(False)))
    runs = windows.groupBy("c1", "c2").agg(*(F.collect_list(F.when(F.col("whole") == w, F.struct("at", "n"))).alias(c) for w, c in ((True, "runs"), (False, "passages"))))
    met = rows.join(runs, ["c1", "c2"], "left").select(key, "n_bytes", "t", "sha", "runs", "passages")

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept, repeated = [], [], [], []
            for t, s, r, q in zip(*(batch.column(c).to_pylist() for c in ("t", "sha", "runs", "passages")), strict=True):
                own = _spans(r, length)
                removed.append(sum(b - a for a, b in own))
                spans.append(len(own))
                kept.append(s if s is not None else _kept(t, own))
                repeated.append(sum(b - a for a, b in _spans(q, passage)))
            numbers = [pa.array(x, pa.int64()) for x in (removed, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, pa.array(kept, pa.string()), pa.array(repeated, pa.int64())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"])

    return met.mapInArrow(closed, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long")
