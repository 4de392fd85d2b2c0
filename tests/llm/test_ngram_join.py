"""Components against all pairs of a small corpus with copies, near copies, shared passages and odd rows."""

import random
import re
from itertools import combinations

import pytest

from tessella.llm import components, ngram_join

SCHEMA = "doc_id long, text string, k string, component_id string"


def shingles(t):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    out = []
    for i, (d, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), None if d is None else min(own) if sets[i] else d))
    return out


def corpus(seed, n=90):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + str(r.randint(0, 400))
    line = [word() for _ in range(14)]
    texts = [None, "", "  \n", "One two", "one TWO", "one two three four five", "É é", "é é"]
    chain = [word() for _ in range(60)]
    for _ in range(12):  # near copies that drift, so that the ends are not alike
        chain[r.randrange(60)] = word()
        texts.append(" ".join(chain))
    for _ in range(n):
        t = [word() for _ in range(r.randint(0, 80))]
        if r.random() < 0.5:
            t[3:3] = line
        texts.append(" ".join(t))
        if r.random() < 0.4:
            for _ in range(r.randint(0, 4) if t else 0):
                t[r.randrange(len(t))] = word()
            texts.append(" ".join(t))
        if r.random() < 0.2:
            texts.append(" ".join(t).upper())
    ids = r.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    rows[20] = (None, rows[21][1])
    return rows


@pytest.mark.parametrize("settings", [{}, {"TILE": 6, "HEAVY": 3, "LOCAL": 2, "SPLIT": 4, "BROADCAST_IDS": 0, "PART": 5, "PART_ENTRIES": 300, "CHUNK_BYTES": 64}])
def test_components_match_all_pairs(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(components if name == "PART" else ngram_join, name, value)
    rows = corpus(len(settings))
    frame = spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA)
    got = ngram_join.join(frame).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_alike_but_unlinked_classes_make_no_row_a_pair(spark, monkeypatch):
    """Pairs just below 0.75 pass the bitmap bound: they may be compared, but what is made may not follow their number."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(1204)]
    rows = []
    for i in range(70):
        words = list(base)
        for at in r.sample(range(10, 1190, 6), 20):
            words[at] = f"y{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[i][1] + " one more") for i in range(3)]
    made, tiled, verified = [], ngram_join._tiled, ngram_join._verified

    def counted(f, at):
        def run(*args):
            out = components.cut(f(*args))
            made.append(out.count() if at is None else args[at].count())
            return out

        return run

    monkeypatch.setattr(ngram_join, "_verified", counted(verified, 3))
    monkeypatch.setattr(ngram_join, "_tiled", counted(tiled, None))
    got = ngram_join.join(spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    want = sorted(brute(rows))
    assert sorted(map(tuple, got)) == want
    assert 20 < len({c for _, _, c in want}) < 70
    assert made and max(made) <= 6 * len(rows)


def test_links_are_all_pairs_of_different_sets(spark):
    rows = corpus(3, 40)
    frame = spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA)
    pairs, classes = ngram_join.links(frame)
    of = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    sets = {of[d]: shingles(t) for d, t in rows if d is not None}
    want = {tuple(sorted((a, b))) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) and want


def test_ids_of_other_types_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [("b", long), ("a", long + " more"), ("x1", "one two three"), ("x0", "one  TWO three"), (None, long)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {("b", 59_996, "a"), ("a", 59_997, "a"), ("x1", 1, "x0"), ("x0", 1, "x0"), (None, 59_996, None)}


def test_components_of_chains_and_stars(spark, monkeypatch):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(3, 3), (50, 40), (40, 45)]
    r.shuffle(pairs)
    for part in (1_000_000, 7):
        monkeypatch.setattr(components, "PART", part)
        got = {x["node"]: x["label"] for x in components.components(components.cut(spark.createDataFrame(pairs, "a long, b long"))).collect()}
        assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)} | {40: 40, 45: 40, 50: 40}


def test_distinct_documents_keeps_one_of_each(spark):
    rows = [(5, "a b c d e f g", "x", "y"), (3, "A b c d e f g", "x", "y"), (9, "other words than those here", "x", None), (9, "other words than those here", "x", None), (1, "", "", ""), (None, None, "", "")]
    got = ngram_join.distinct_documents(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "k", "component_id"]
    assert sorted(r["doc_id"] or -1 for r in got.collect()) == [-1, 1, 3, 9]


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], SCHEMA)).count() == 0
