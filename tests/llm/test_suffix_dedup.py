"""The removal against a brute-force count of all windows, and the construction against sorted suffixes."""

import hashlib
import random
from collections import Counter

import pytest

from tessella.llm import bcr, suffix_dedup

SCHEMA = "doc_id long, text string, n_spans string"


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(25))
    texts = [None, "", "x", "a" * 300, "ab" * 200, "ab" * 150 + "c"]
    for _ in range(60):
        t = " ".join(word() for _ in range(r.randint(0, 60)))
        if r.random() < 0.5:
            at = r.randint(0, len(t))
            t = t[:at] + passage[r.randint(0, 20) :] + t[at:]
        texts.append(t)
        if r.random() < 0.3:
            texts.append(t if r.random() < 0.5 else t[5:] + "q")
    return texts


@pytest.mark.parametrize("hot", [1, 6, 1000])
def test_matches_brute_force_at_every_level(spark, hot):
    texts = corpus(hot)
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, SCHEMA), length=40, passage=28, gram=16, hot=hot, fine=4).collect()
    encoded = [(t or "").encode() for t in texts]
    want = Counter((rows[i][0], *x, y[1]) for i, (x, y) in enumerate(zip(brute(encoded, 40), brute(encoded, 28))))
    assert Counter(tuple(r) for r in got) == want
    assert sum(r["n_removed"] for r in got) > 0


def test_long_texts_are_cut_in_pieces_that_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    texts = [t or "" for t in corpus(9)]
    filed = suffix_dedup._stretches([t.encode() for t in texts], 40, 16)
    assert filed["n"].sum() == sum(max(0, len(t.encode()) - 39) for t in texts)


def test_empty_table_and_repeated_rows(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = suffix_dedup.dedup(spark.createDataFrame([(1, "z" * 10 + str(list(range(200))), "")] * 2, SCHEMA)).collect()
    assert [(r["n_removed"], r["n_spans"]) for r in rows] == [(rows[0]["n_bytes"], 1)] * 2


@pytest.mark.parametrize("folder", [None, "files"])
def test_transform_and_prefixes(folder, tmp_path):
    r = random.Random(3)
    for _ in range(20):
        reads = [bytes(r.choice(b"abc") for _ in range(r.randint(0, 20))) for _ in range(r.randint(1, 8))]
        b, p, _ = bcr.build(reads, str(tmp_path) if folder else None)
        suffixes = sorted(([*(x for x in t[i:]), -1 if False else -len(reads) + k], t[i - 1] if i else None) for k, t in enumerate(reads) for i in range(len(t) + 1))
        symbols = sorted({x for t in reads for x in t})
        assert [None if x == 0 else symbols[x - 1] for x in b] == [c for _, c in suffixes]
        for above, below, n in zip(suffixes, suffixes[1:], p[1:]):
            common = 0
            while above[0][common] == below[0][common]:
                common += 1
            assert n == common
