"""Language identification by cross-parsing entropy.

For every labelled language a suffix automaton of sample text is built, over the letters of that sample. A document is parsed against each of them into the
longest phrases that occur in the sample, and the language that needs the fewest phrases wins; counts are normalised
by the sample's size (a phrase costs log2 of it) and the document's symbols. Texts are parsed whole. Many blocks of ``BLOCK`` symbols advance
by one symbol together in numpy: each starts at the root first, and then anew from the state in which the block before it really ends, until
no end changes, so phrases run over the borders of blocks.

The sample is bounded: at most ``ROWS`` labelled rows per language, chosen by a hash of doc_id, and ``SYMBOLS`` symbols of them.
What is broadcast is that sample; each Python worker builds the automata once. An automaton is a dense table of up to ``CELLS``
transitions; over larger alphabets its transitions are kept sorted and searched.

Defined cases: null text or text without a letter is ``und`` with score 0, as is everything if nothing is labelled; ties go to
the language that sorts first; rows with null lang are predicted but not learned from; repeated rows are judged one by one; an empty table gives an
empty result; texts of any length are parsed whole; columns named lang_pred or score are replaced, others carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.window import Window

from .common import hash_sample

ROWS = 48
SYMBOLS = 32_768
BLOCK = 256
LANES = 8192
#: Cells of a dense transition table, four bytes each.
CELLS = 4 << 20

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: is it a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, and each one's text; every run of other than letters is one space (32)."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), np.fromiter(map(len, low), np.int64, len(low)))
    letter = _letters()[points]
    before = np.zeros(len(points), bool)
    if len(points):
        before[1:] = letter[:-1] & (owner[1:] == owner[:-1])
    keep = letter | before
    return np.where(letter, points, 32)[keep], owner[keep]


class Automaton:
    """The suffix automaton of symbols 1 to k - 2; state 1 is the root, 0 is none; symbol 0 stays put (padding), symbol k - 1 is unknown."""

    def __init__(self, symbols: list[int], k: int, cells: int = CELLS):
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.k, states = k, len(nxt) + 1
        edges = np.array([((s + 1) * k + c, to + 1) for s, own in enumerate(nxt) for c, to in own.items()], np.int64).reshape(-1, 2)
        edges = edges[np.argsort(edges[:, 0])]
        self.at, self.to, self.table = edges[:, 0], edges[:, 1].astype(np.int32), None
        if states * k <= cells:
            self.table = np.zeros(states * k, np.int32)
            self.table[self.at] = self.to
            self.table.reshape(-1, k)[:, 0] = np.arange(states)
        self.root = np.ones(k, np.int32)
        first = np.flatnonzero(self.at // k == 1)
        self.root[self.at[first] % k] = self.to[first]

    def next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table.take(state * np.int32(self.k) + symbol)
        if not len(self.at):
            return np.where(symbol == 0, state, 0)
        key = state.astype(np.int64) * self.k + symbol
        place = np.minimum(np.searchsorted(self.at, key), len(self.at) - 1)
        return np.where(symbol == 0, state, np.where(self.at[place] == key, self.to[place], 0))

    def parse(self, blocks: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each block (blocks is [symbol, block]) entered in the given states, and the states at its end."""
        count = np.zeros(len(state), np.int64)
        for row in blocks:
            nxt = self.next(state, row)
            fail = nxt == 0
            count += fail
            state = np.where(fail, self.root.take(row), nxt)
        return count, state

    def phrases(self, blocks: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases that end in each block, where a block that ``follows`` goes on in the state of the one before it."""
        entry = np.ones(blocks.shape[1], np.int32)
        count, end = self.parse(blocks, entry)
        while True:
            true = np.where(follows, np.concatenate([[1], end[:-1]]), 1).astype(np.int32)
            again = np.flatnonzero(true != entry)
            if not len(again):
                return count
            entry = true
            count[again], end[again] = self.parse(blocks[:, again], entry[again])


class Model:
    """Automata of all languages, each over its own letters: 0 padding, 1 space, then letters, last any other letter."""

    def __init__(self, sample: dict[str, str]):
        self.langs = sorted(sample)
        points = {lang: _code_points([sample[lang]])[0][:SYMBOLS] for lang in self.langs}
        self.letters = np.unique(np.concatenate([np.array([32], np.uint32), *points.values()]))
        self.code, self.automata, self.cost = [], [], []
        for lang in self.langs:
            own = np.unique(np.concatenate([np.array([32], np.uint32), points[lang]]))
            code = np.full(len(self.letters) + 1, len(own) + 1, np.int32)  # the last is any letter of no sample
            code[np.searchsorted(self.letters, own)] = np.arange(len(own)) + 1
            self.code.append(code)
            self.automata.append(Automaton((np.searchsorted(own, points[lang]) + 1).tolist(), len(own) + 2))
            self.cost.append(np.log2(len(points[lang]) + 2))
        self.number = np.full(0x110000, len(self.letters), np.int32)
        self.number[self.letters] = np.arange(len(self.letters))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        points, owner = _code_points(texts)
        n = len(texts)
        lens = np.bincount(owner, minlength=n)
        if not self.langs or not len(points):
            return ["und"] * n, [0.0] * n
        first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        place = np.arange(len(points)) - first[owner]
        per_doc = -(-lens // BLOCK)
        first_block = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
        block = first_block[owner] + place // BLOCK
        total = int(per_doc.sum())
        block_owner = np.repeat(np.arange(n), per_doc)
        follows = np.concatenate([[False], block_owner[1:] == block_owner[:-1]])
        number = self.number[points]
        cost = np.empty((len(self.langs), n))
        for i, (code, automaton) in enumerate(zip(self.code, self.automata, strict=True)):
            grid = np.zeros((BLOCK, total), np.int32)
            grid[place % BLOCK, block] = code[number]
            cost[i] = np.bincount(block_owner, automaton.phrases(grid, follows), minlength=n) + 1.0
        cost = cost * np.array(self.cost)[:, None] / np.maximum(lens, 1)
        best = np.argmin(cost, axis=0)
        lowest = cost[best, np.arange(n)]
        second = np.partition(cost, 1, axis=0)[1] if len(self.langs) > 1 else np.full(n, np.inf)
        score = np.where(np.isinf(second), 1.0, 1.0 - lowest / np.maximum(second, 1e-12))
        return [self.langs[b] if m else "und" for b, m in zip(best, lens, strict=True)], [float(s) if m else 0.0 for s, m in zip(np.round(score, 6), lens, strict=True)]


_MODELS: dict[str, Model] = {}


def model_of(sample: dict[str, str]) -> Model:
    """Built once per worker process for a sample."""
    digest = hashlib.sha256(repr(sorted(sample.items())).encode()).hexdigest()
    if digest not in _MODELS:
        _MODELS.clear()
        _MODELS[digest] = Model(sample)
    return _MODELS[digest]


def sample(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", rows: int = ROWS) -> dict[str, str]:
    """Joined text of at most ``rows`` rows per language; the window's limit runs before the shuffle, so few rows move."""
    usable = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.col(key).alias("k"), F.col(text).alias("t"))
    # Rows without a letter teach nothing; where they are many, the sample is smaller.
    chosen = hash_sample(usable, "l", "k", 2 * rows).where(F.col("t").rlike(r"\p{L}"))
    chosen = chosen.select("l", F.substring("t", 1, SYMBOLS).alias("t"), F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k"), "k", "t")).alias("r")).where(F.col("r") <= rows)
    out: dict[str, list[str]] = {}
    for row in chosen.orderBy("l", "r").toLocalIterator():
        got = out.setdefault(row["l"], [])
        if sum(map(len, got)) < SYMBOLS:
            got.append(row["t"])
    return {k: "\n".join(v)[: 2 * SYMBOLS] for k, v in out.items()}


def identify(docs: DataFrame, found: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` without its text, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            texts = batch.column(text).to_pylist()
            a = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= BLOCK * LANES or i + 1 == len(texts):
                    lang, score = model.predict(texts[a : i + 1])
                    langs += lang
                    scores += score
                    a, size = i + 1, 0
            keep = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep.schema.names, "lang_pred", "score"])

    kept = docs.drop("lang_pred", "score")
    return kept.mapInArrow(run, T.StructType([f for f in kept.schema.fields if f.name != text] + FIELDS))
