"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence's score is the logistic function of a bias and the weights of its distinct words (a word's own and those of its beginnings), less what the bias
alone gives; a document's score is the noisy-or of its sentences and of one leak a document, ``1 - (1 - leak) * prod(1 - p)``, so a text
without told words scores the leak however long it is. Weights are learned from document labels alone by gradient steps on the noisy-or likelihood, and
afterwards the sentence scores tell where the offending sentences are.

The fit is bounded: at most ``FIT_POSITIVE`` and ``FIT_NEGATIVE`` labelled rows, chosen by a hash of doc_id whatever their
length and weighted back to the shares of the labels; its terms follow those rows. Scoring is one pass of Arrow batches with the weights broadcast.

Defined cases: null or empty text has no sentence and scores 0; a document labelled more than once is toxic if any label
says so, and null labels are ignored; without labels of both kinds every score is 0; repeated rows are scored one by one; words of any
length count, and in scripts without spaces a run of letters is one word; columns named score or offending are replaced, others carried along.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, hash_sample, slices

FIT_POSITIVE, FIT_NEGATIVE = 800, 2000
#: A word is a term if the log-likelihood ratio of its counts in toxic and other rows is at least this.
LEAST_EVIDENCE = 18.0
LEAST_DOCS = 3
STEPS, RATE, RIDGE = 300, 0.15, 2e-4
THRESHOLD = 0.3
START_BIAS, START_LEAK = -7.0, -4.0
KNOWN = 400_000

#: Sentences end at these bytes.
_ENDS = b".!?\n"
_SENTENCE_BYTES = bytes(10 if b in _ENDS else WORD_BYTES[b] for b in range(256))

OFFENDING = T.ArrayType(T.StructType([T.StructField("sentence", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW_OFFENDING = pa.list_(pa.struct([("sentence", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(min(x, 40.0), -40.0)))


def sentences(text: bytes) -> list[bytes]:
    """Lower-cased sentences that hold a word, separators as spaces."""
    return [s for s in text.translate(_SENTENCE_BYTES).split(b"\n") if s and not s.isspace()]


def terms_of(word: bytes) -> tuple[bytes, ...]:
    """A word's terms: itself and its beginnings of 3 to 8 letters, marked by a star, which catch what is inflected."""
    letters = word.decode("utf-8", "replace")
    return (word, *(letters[:n].encode() + b"*" for n in range(3, min(8, len(letters)) + 1)))


class Model:
    """Bias, weights by term and leak (as log-odds); ``weight`` keeps the sums of words it has met, up to ``KNOWN`` of them."""

    def __init__(self, bias: float = -40.0, weights: dict[bytes, float] | None = None, leak: float = -40.0):
        self.bias, self.weights, self.leak = bias, weights or {}, leak
        self.base, self.none = _sigmoid(bias), math.log1p(-_sigmoid(leak))
        self.known: dict[bytes, float] = {}

    def weight(self, word: bytes) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            get = self.weights.get
            got = sum(get(t, 0.0) for t in terms_of(word))
            if len(word) <= 100:
                self.known[word] = got
        return got

    def score(self, text: bytes | None) -> tuple[float, list[dict]]:
        """The document's score, and the sentences that alone reach THRESHOLD with their byte spans."""
        if not text:
            return 0.0, []
        found = text.translate(_SENTENCE_BYTES)
        weight = self.weight
        told = {w: x for w in set(found.split()) if (x := weight(w))}
        if not told:
            return (0.0 if not found or found.isspace() else round(-math.expm1(self.none), 6)), []
        total, at, k, offending = self.none, 0, 0, []
        for s in found.split(b"\n"):
            if s and not s.isspace():
                p = max(0.0, (_sigmoid(self.bias + sum(told[w] for w in told.keys() & s.split())) - self.base) / (1 - self.base))
                total += math.log1p(-min(p, 1 - 1e-12))
                if p >= THRESHOLD:
                    offending.append({"sentence": k, "start": at, "end": at + len(s), "score": round(p, 6)})
                k += 1
            at += len(s) + 1
        return round(-math.expm1(total), 6), offending


def _evidence(a: float, n1: float, b: float, n0: float) -> float:
    """Log-likelihood ratio of a word found in a of n1 toxic and b of n0 other rows."""
    total = 0.0
    for x, n in ((a, n1), (b, n0)):
        for k, share in ((x, (a + b) / (n1 + n0)), (n - x, 1 - (a + b) / (n1 + n0))):
            if k > 0:
                total += 2 * k * math.log(k / (n * share))
    return total


def fit(rows: Iterator[tuple[bytes, int]], steps: int = STEPS, toxic_share: float | None = None) -> Model:
    """Learn from (text, label), weighted to ``toxic_share`` if given. Words must be in LEAST_DOCS toxic rows and clearly commoner in them; Adam on the noisy-or likelihood."""
    held = list(rows)
    y = np.array([label for _, label in held], float)
    if not len(y) or y.min() == y.max():
        return Model()
    n1, n0 = y.sum(), (1 - y).sum()
    share = n1 / len(y) if toxic_share is None else toxic_share
    row = np.where(y == 1, share / n1, (1 - share) / n0)

    def terms_in(words) -> Iterator[bytes]:
        return (t for w in set(words) for t in terms_of(w))

    # Only terms of LEAST_DOCS toxic rows are counted in the others, so what is held follows the toxic rows alone.
    toxic: Counter = Counter()
    for text, label in held:
        if label:
            toxic.update(set(terms_in(text.translate(WORD_BYTES).split())))
    toxic = Counter({t: c for t, c in toxic.items() if c >= LEAST_DOCS})
    other: Counter = Counter()
    for text, label in held:
        if not label:
            other.update({t for t in terms_in(text.translate(WORD_BYTES).split()) if t in toxic})
    strength = {t: _evidence(c, n1, other[t], n0) for t, c in toxic.items() if c * n0 > 2 * other[t] * n1}
    terms = sorted((t for t, g in strength.items() if g >= LEAST_EVIDENCE), key=lambda t: (-strength[t], t))
    number = {t: i for i, t in enumerate(terms)}
    # Sentences without a term are alike: a bag has its count of them, and the others are instances of their own.
    owner, cols, inst = [], [], []
    for d, (text, _) in enumerate(held):
        for s in sentences(text):
            ids = {number[t] for t in terms_in(s.split()) if t in number}
            if ids:
                inst += [len(owner)] * len(ids)
                cols += sorted(ids)
                owner.append(d)
    held.clear()
    owner_, cols_, inst_ = np.array(owner, np.int64), np.array(cols, np.int64), np.array(inst, np.int64)
    w, b, leak = np.zeros(len(terms)), START_BIAS, START_LEAK
    m, v = np.zeros(len(terms) + 2), np.zeros(len(terms) + 2)
    for t in range(1, steps + 1):
        told = np.bincount(inst_, w[cols_], minlength=len(owner_)) if len(owner_) else np.zeros(0)
        p, p0, pl = 1 / (1 + np.exp(-b - told)), 1 / (1 + math.exp(-b)), 1 / (1 + math.exp(-leak))
        # An instance whose words weigh nothing or less is left at 0, but its words still learn.
        clear = np.minimum(np.log1p(-np.minimum(p, 1 - 1e-9)) - math.log1p(-p0), 0.0)
        none = math.log1p(-pl) + np.bincount(owner_, clear, minlength=len(y))
        bag_p = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
        # d loss / d z of an instance is p * (1 - y / P)
        pull = row * (1 - y / bag_p)
        slope = p * pull[owner_]
        over = np.where(told > 0, (p - p0) * pull[owner_], 0.0)
        g = np.concatenate([np.bincount(cols_, slope[inst_], minlength=len(terms)), [over.sum(), pl * pull.sum()]])
        g[:-2] += RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b, leak = w - step[:-2], b - step[-2], leak - step[-1]
    return Model(float(b), {x: float(round(a, 5)) for x, a in zip(terms, w, strict=True) if abs(a) > 1e-3}, float(leak))


def labelled(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """One row (_k, y) for each labelled document."""
    return labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(F.col(label)).cast("int").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """At most FIT_POSITIVE + FIT_NEGATIVE rows (text, y); their ids are chosen in ``labels`` and fit a broadcast by that bound."""
    one = labelled(labels, key, label)
    ids = hash_sample(one.where("y in (0, 1)"), "y", "_k", {1: FIT_POSITIVE, 0: FIT_NEGATIVE}).select("_k", "y")
    usable = docs.select(F.col(key).alias("_d"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return usable.join(F.broadcast(ids), F.col("_d") == F.col("_k")).select("_d", "t", "y")


def learn(docs: DataFrame, labels: DataFrame, **names) -> Model:
    """Fit in one task, on the bounded sample and the counted share of toxic labels; the driver gets the weights alone."""
    counted = labelled(labels, **{k: v for k, v in names.items() if k in ("key", "label")}).where("y in (0, 1)").agg(F.avg("y")).first()[0]
    share = counted if counted and counted < 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, y) for batch in batches for t, y in zip(batch.column("t").cast(pa.binary()).to_pylist(), batch.column("y").to_pylist(), strict=True)]
        model = fit(iter(rows), toxic_share=share)
        yield pa.RecordBatch.from_arrays([pa.array([None, b"", *model.weights], pa.binary()), pa.array([model.bias, model.leak, *model.weights.values()], pa.float64())], names=["term", "weight"])

    one = sample(docs, labels, **names).repartition(1).sortWithinPartitions("_d", "t").select("t", "y")
    found = one.mapInArrow(run, "term binary, weight double").collect()
    bias = [r["weight"] for r in found if r["term"] is None]
    weights = {bytes(r["term"]): r["weight"] for r in found if r["term"] is not None}
    return Model(bias[0], leak=weights.pop(b""), weights=weights) if bias else Model()


def score(docs: DataFrame, model: Model, text: str = "text", keep_below: float | None = None) -> DataFrame:
    """``docs`` without its text, with score and offending; or, with keep_below, the rows of ``docs`` that score less."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in slices(batches, text):
            found = [m.score(t) for t in batch.column(text).cast(pa.binary()).to_pylist()]
            if keep_below is not None:
                yield batch.filter(pa.array([s < keep_below for s, _ in found], pa.bool_()))
                continue
            keep = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array([s for s, _ in found], pa.float64()), pa.array([o for _, o in found], _ARROW_OFFENDING)], names=[*keep.schema.names, "score", "offending"])

    if keep_below is not None:
        return docs.mapInArrow(run, docs.schema)
    kept = docs.drop("score", "offending")
    return kept.mapInArrow(run, T.StructType([f for f in kept.schema.fields if f.name != text] + [T.StructField("score", T.DoubleType()), T.StructField("offending", OFFENDING)]))
