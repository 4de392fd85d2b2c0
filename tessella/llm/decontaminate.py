"""Benchmark decontamination by training suffix arrays.

Documents are the training side. Each task gathers whole documents into shards of about ``SHARD_WORDS`` words and builds a
word-level suffix array for a shard: words are numbered by the benchmark's vocabulary (0 for any other word and between
documents), and only suffixes that start with enough benchmark words to hold a window are sorted. Every test suffix is then
binary-searched in every shard; its interval gives the locations, and neighbouring locations on one diagonal join to the
longest verbatim matches. No document is shuffled, and a shard needs memory for its own words only.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text (their number follows its measured size); each block is
broadcast and applied in turn by a chained step of the same stage.

Defined cases: null or empty text has no words and is clean; null item text gives no window; an item of fewer than ten
words is one window; items with equal ids count once, a null item_id is named by the empty string; repeated documents are judged
one by one; further columns of ``docs`` are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 8 << 20

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(MATCH)),
]
_ARROW_MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])


class Windows:
    """The windows of one benchmark block, packed so that a window is a short row of uint64 numbers in lexicographic order."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        rows: dict[tuple, list[tuple[int, int]]] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in (text or "").encode().translate(WORD_BYTES).split()]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1) if ids else ():
                rows.setdefault(tuple(ids[at : at + size]), []).append((number[name], at))
        self.bits = max(1, len(self.vocab).bit_length())
        self.per = min(window, 64 // self.bits)
        keys = list(rows)
        self.size = np.array([len(k) for k in keys], np.int64)
        self.least = int(self.size.min()) if keys else 0
        self.owners = [rows[k] for k in keys]
        full = np.zeros((len(keys), window), np.int64)
        top = np.full((len(keys), window), (1 << self.bits) - 1, np.int64)
        for i, k in enumerate(keys):
            full[i, : len(k)] = k
            top[i, : len(k)] = k
        self.low, self.high = self.pack(full), self.pack(top)

    def pack(self, ids: np.ndarray) -> list[np.ndarray]:
        """Columns of uint64, the first words in the highest bits."""
        out = []
        for a in range(0, self.window, self.per):
            col = np.zeros(len(ids), np.uint64)
            for j in range(a, a + self.per):
                col <<= np.uint64(self.bits)
                if j < self.window:
                    col |= ids[:, j].astype(np.uint64)
            out.append(col)
        return out


def _suffix_array(ids: np.ndarray, w: Windows) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of the suffixes that can hold a window, sorted by their first words, and their packed keys."""
    n = len(ids)
    breaks = np.flatnonzero(ids == 0)
    nxt = breaks[np.searchsorted(breaks, np.arange(n))] if n else breaks
    run = nxt - np.arange(n)
    at = np.flatnonzero(run >= w.least)
    padded = np.concatenate([ids, np.zeros(w.window, ids.dtype)])
    grid = np.empty((len(at), w.window), np.int64)
    for j in range(w.window):
        grid[:, j] = np.where(j < run[at], padded[at + j], 0)
    cols = w.pack(grid)
    order = np.lexsort(cols[::-1])
    return at[order], [c[order] for c in cols]


def _bound(cols: list[np.ndarray], keys: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of all keys at once: how many rows are smaller (or not greater)."""
    lo = np.zeros(len(keys[0]), np.int64)
    hi = np.full(len(keys[0]), len(cols[0]), np.int64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = np.minimum((lo + hi) >> 1, max(len(cols[0]) - 1, 0))
        less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for c, k in zip(cols, keys, strict=True):
            v = c[mid]
            less |= equal & (v < k)
            equal &= v == k
        go = open_ & (less | equal if right else less)
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)


def match_shard(texts: list[bytes | None], w: Windows) -> list[tuple[int, list[int], list[str], list[dict]]]:
    """Per document of one shard: words, hit spans (flat, disjoint, in order), items and longest matches."""
    get = w.vocab.get
    parts, starts, at = [], [], 0
    for t in texts:
        words = t.translate(WORD_BYTES).split() if t else ()
        starts.append(at)
        parts.append(np.fromiter((get(x, 0) for x in words), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
        at += len(words) + 1
    starts_ = np.array([*starts, at], np.int64)
    counts = np.diff(starts_) - 1
    out = [(int(c), [], [], []) for c in counts]
    if not len(w.size) or not at:
        return out
    sa, cols = _suffix_array(np.concatenate(parts), w)
    if not len(sa):
        return out
    lo, hi = _bound(cols, w.low, False), _bound(cols, w.high, True)
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return out
    n = (hi - lo)[hit]
    which = np.repeat(hit, n)
    pos = sa[np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    covered = np.zeros(at + 1, np.int32)
    np.add.at(covered, pos, 1)
    np.add.at(covered, pos + w.size[which], -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(covered) > 0).astype(np.int8), [0]])))
    for s, e in edges.reshape(-1, 2):
        d = int(np.searchsorted(starts_, s, side="right")) - 1
        out[d][1].extend((int(s - starts_[d]), int(e - starts_[d])))
    owners = [w.owners[i] for i in which]
    k = np.fromiter(map(len, owners), np.int64, len(owners))
    item, off = np.array([x for own in owners for x in own], np.int64).reshape(-1, 2).T
    pos, size = np.repeat(pos, k), np.repeat(w.size[which], k)
    order = np.lexsort((pos, pos - off, item))
    item, off, pos, size = item[order], off[order], pos[order], size[order]
    new = np.ones(len(pos), bool)
    new[1:] = (item[1:] != item[:-1]) | (pos[1:] - off[1:] != pos[:-1] - off[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(pos))) + size[first] - 1
    docs = np.searchsorted(starts_, pos[first], side="right") - 1
    for f, ln, d in zip(first, length, docs, strict=True):
        out[d][3].append({"item_id": w.names[item[f]], "item_word": int(off[f]), "doc_word": int(pos[f] - starts_[d]), "n_words": int(ln)})
    for row in out:
        row[2].extend(sorted({m["item_id"] for m in row[3]}))
    return out


def _merged(a: list[int], b: list[int]) -> list[int]:
    """The union of two flat lists of disjoint spans."""
    out: list[int] = []
    for s, e in sorted(zip([*a[::2], *b[::2]], [*a[1::2], *b[1::2]], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _shards(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about SHARD_WORDS words (six bytes each)."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= 6 * SHARD_WORDS:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _step(shared, text: str, first: bool, clean_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = shared.value
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            found: list = []
            for a, b in _shards(texts):
                found += match_shard(texts[a:b], w)
            n, spans, items, matches = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
            keep = batch
            if not first:
                old_s, old_i, old_m = (batch.column(x).to_pylist() for x in ("hit_spans", "items", "matches"))
                spans = [_merged(x, y) for x, y in zip(old_s, spans, strict=True)]
                items = [sorted({*x, *y}) for x, y in zip(old_i, items, strict=True)]
                matches = [x + y for x, y in zip(old_m, matches, strict=True)]
                keep = batch.drop_columns(["n_words", "hit_spans", "items", "matches"])
            if clean_only:
                yield keep.filter(pa.array([not x for x in spans], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays(
                    [*keep.columns, pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(matches, pa.list_(_ARROW_MATCH))],
                    names=[*keep.schema.names, "n_words", "hit_spans", "items", "matches"],
                )

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        yield [(r["i"], r["t"]) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).collect()]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, clean_only: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans, items and matches; or, clean_only, the rows of ``docs`` without a hit."""
    clash = {"n_words", "hit_spans", "items", "matches"} & set(docs.columns) if not clean_only else set()
    carried = docs.drop(*clash)
    out, blocks = carried, list(_blocks(benchmark, item_id, item_text, block_bytes))
    for k, items in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(Windows(items, window))
        schema = carried.schema if clean_only else T.StructType([*carried.schema.fields, *FIELDS])
        out = out.mapInArrow(_step(shared, text, k == 0 or clean_only, clean_only), schema)
    return out
