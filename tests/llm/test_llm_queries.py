"""The registered queries themselves, over whole tables: against DuckDB twins, or redone in plain Python where SQL cannot."""

import math
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest
import xxhash

from tessella.llm import license_scan, mixing, pii, queries, url_filter
from tessella.llm.common import LOWER, UPPER

SF = "/root/testdata/sf0.001"
LOW = str.maketrans(UPPER, LOWER)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_twin(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    twin = duck.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(twin.columns)
    at = [twin.columns.index(c) for c in columns]
    assert sorted(([r[c] for c in columns] for r in df.collect()), key=repr) == sorted(([r[i] for i in at] for r in twin.fetchall()), key=repr)


def test_url_scores_redone(spark, duck):
    def bucket(part, gram):
        h = xxhash.xxh64_intdigest(gram.encode(), xxhash.xxh64_intdigest(part.encode(), 42))
        return (h - (1 << 64) if h >> 63 else h) % url_filter.BUCKETS + 1

    def features(host, path):
        if not host and not path:
            return set()
        digits = str.maketrans("123456789", "000000000")
        return {bucket(p, t[i : i + n]) for p, x in (("h", host), ("p", path)) for t in [f"^{x.translate(digits)}$"] for n in url_filter.GRAMS for i in range(len(t) - n + 1)}

    weights = url_filter.fit(url_filter.labelled_urls(spark))
    urls = dict(duck.sql("SELECT page_id, url FROM pages").fetchall())
    for r in queries.op1_url_filter(spark, SF).collect():
        rest = urls[r["page_id"]].split("://", 1)
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest[1], re.S).groups() if len(rest) > 1 else ("", "")
        host = host.translate(LOW)
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        f = features(host, path)
        score = 1 / (1 + math.exp(-weights[0] - sum(weights[b] for b in f) / math.sqrt(max(len(f), 1))))
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and abs(r["score"] - score) < 2e-6
        assert r["verdict"] == (verdict or ("block" if r["score"] >= url_filter.BLOCK_AT else "allow"))


def test_license_rows_redone(spark, duck):
    rules = license_scan.rule_table()
    got = {r["doc_id"]: r for r in queries.op6_license_scan(spark, SF).collect()}
    for doc_id, text in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        norm = f" {' '.join(words)} " if words else " "
        found = sorted((m.start(), -m.end(), r["priority"], r["id"], r["label"], r["conf"], r["base"]) for r in rules for m in re.finditer(r["pattern"], norm))
        kept = [d for i, d in enumerate(found) if all(-e[1] < -d[1] for e in found[:i])]
        base = [d for d in found if d[6]]
        own = sorted({d[4] for d in base})
        r = got[doc_id]
        place = lambda d: norm[: d[0]].count(" ") - 1
        assert (r["n_words"], r["n_base"], r["base_labels"], r["labels"], r["score"]) == (len(words), len(base), ",".join(own), ",".join(sorted({*own, *(d[4] for d in kept)})), max((d[5] for d in kept), default=0.0)), doc_id
        assert (r["first_word"], r["last_word"]) == ((place(base[0]), place(base[-1])) if base else (None, None))


def test_pseudonyms_can_be_undone(spark, duck):
    back = pii.Pseudonyms(undo=True)
    texts, changed = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall()), 0
    for r in queries.op8_pii(spark, SF).collect():
        new, old = r["text"], texts[r["doc_id"]]
        assert len(new) == len(old)
        changed += new != old
        assert back.replace(new)[0] == old
    assert changed > 5


def test_mixing_follows_its_targets(spark, duck):
    sources = dict(duck.sql("SELECT doc_id, source FROM documents").fetchall())
    rows = sorted(queries.op10_mixing(spark, SF).collect(), key=lambda r: (r["slot"], r["place"]))
    assert sorted(r["doc_id"] for r in rows) == sorted(sources) and all(r["source"] == sources[r["doc_id"]] for r in rows)
    size = defaultdict(int)
    for s in sources.values():
        size[s] += 1
    order = [s for s in dict.fromkeys((r["slot"], r["source"]) for r in rows)]
    assert [s for s, _ in order] == list(range(len(order)))
    weights = {s: Fraction(float(n) ** mixing.TEMPERATURE) for s, n in size.items()}
    left, done, total = {s: -(-n // mixing.BLOCK_ROWS) for s, n in size.items()}, defaultdict(int), sum(weights.values())
    t = 0
    for _, s in order:
        t, done[s], left[s] = t + 1, done[s] + 1, left[s] - 1
        assert all(abs(done[x] - t * weights[x] / total) < 1 for x in weights if left[x] or x == s)
        if not left[s]:  # a new phase among the sources that are left
            del weights[s]
            t, done, total = 0, defaultdict(int), sum(weights.values())
