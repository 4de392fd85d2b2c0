"""URL filter, license scan and quality rules against plain Python, with odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import license_scan, quality_rules, url_filter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, source string, text string, score double, kept string"


@pytest.fixture(scope="module")
def weights(spark):
    return url_filter.fit(url_filter.labelled_urls(spark))


def test_url_parts_and_rules(spark, weights):
    urls = {
        "http://A.Net/x": ("a.net", "/x", "net/", "block"),
        "http://net": ("net", "", None, None),
        "HTTP://WWW.Example.NET/en/1?q#f": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "x://notexample.com/de/": ("notexample.com", "/de/", None, None),
        "x://m.example.com/de/9": ("m.example.com", "/de/9", "example.com/de/", "block"),
        "https://a.org/fr/?x": ("a.org", "/fr/", "org/fr/", "allow"),
        "https://a.org?x=/fr/": ("a.org", "", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        "a://b/://c": ("b", "/://c", None, None),
        "http://\u00c9x.org/fr/\n2": ("\u00c9x.org", "/fr/\n2", "org/fr/", "allow"),
        None: ("", "", None, None),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, None])], "page_id long, url string, host string")
    rows = url_filter.judge(pages, weights).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path, rule, verdict = urls[r["url"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or (verdict is None and r["verdict"] in ("allow", "block"))
    assert url_filter.judge(pages.limit(0), weights).count() == 0


def test_url_model_tells_the_labelled_apart_and_generalises(spark, weights):
    rows = url_filter.judge(url_filter.labelled_urls(spark), weights, rules=()).collect()
    assert sum((r["verdict"] == "block") == (r["label"] == 1) for r in rows) > 0.95 * len(rows) and not any(r["verdict"] == "block" for r in rows if r["label"] == 0)
    fresh = spark.createDataFrame([("https://www.cheap-pills.example.org/en/9981", "block"), ("http://shop.spam-farm.example.com/x", "block"), ("https://blog.garden-notes.example.org/en/77", "allow")], "url string, want string")
    assert all(r["verdict"] == r["want"] for r in url_filter.judge(fresh, weights, rules=()).collect())
    assert url_filter.fit(url_filter.labelled_urls(spark).limit(0)) == [0.0] * (url_filter.BUCKETS + 1)


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_license_base_places(spark):
    r = random.Random(5)
    pieces = ["GNU General Public License", "gnu general public", "license", "Apache-License!", "apache licenses", "CC BY", "cc\nby-nc 4.0", "MIT License", "mit der", "licence", "ÉT", "x1", "{}|", "Apache License, Version 2.0", "gnu-general/public_license,"]
    texts = [None, "", " \n", "MIT", "MIT License MIT License Apache License", "\u0130cc by \u212a"] + [" ".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(150)]
    docs = spark.createDataFrame([(i, "s", t, 0.0, "k") for i, t in enumerate(texts)], DOCS)
    rows = license_scan.scan(docs).orderBy("doc_id").collect()
    for t, row in zip(texts, rows, strict=True):
        s = row["scan"]
        got = (row["n_words"], s["n_base"] if s else 0, s["first_word"] if s else None, s["last_word"] if s else None, s["base_labels"] if s else [])
        assert got == base_places(t), t
    assert license_scan.scan(docs.limit(0)).count() == 0


def shortest(pattern):
    """A text that the rule's pattern matches: optional parts left out, the first of alternatives taken."""
    text = pattern.replace("(?<= )", "").replace("(?= )", "").replace("[cs]", "s").replace("[sz]", "s")
    text = re.sub(r"\(\?:\[\^ \]\+ \)\{1,\d+\}", "x ", text)
    while "(?:" in text:
        text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\??)", lambda m: "" if m[2] else m[1], text)
    return re.sub(r".\?", "", text)


def test_every_license_rule_fires_on_a_text_that_holds_nothing_else(spark):
    rules = license_scan.rule_table()
    texts = [shortest(r["pattern"]) for r in rules]
    assert all(re.search(r["pattern"], f" {t} ") for r, t in zip(rules, texts, strict=True))
    more = ["Released under\nMIT.", "distributed under the ISC", "available under the Boost Software 1.0", "Released into the PUBLIC-domain!", "in the public\ndomain"]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts + more)), "doc_id long, text string")).orderBy("doc_id").collect()
    missed = [t for t, r in zip(texts + more, rows, strict=True) if r["scan"] is None or not r["scan"]["labels"] or not r["scan"]["score"] > 0]
    assert missed == []


def test_license_tags_bodies_long_texts_and_clashing_columns(spark):
    texts = ["// SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-2.0-or-later", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and", "MIT License " * 20_000, "GNU, nothing more"]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, n_words string, scan string")
    rows = license_scan.scan(docs).orderBy("doc_id").collect()
    assert [r["scan"]["labels"] if r["scan"] else [] for r in rows] == [["mit"], ["gpl-2-or-later"], ["mit"], ["mit"], []]
    assert (rows[3]["n_words"], rows[3]["scan"]["n_base"], rows[3]["scan"]["last_word"], len(rows[3]["scan"]["detections"])) == (40_000, 20_000, 39_998, 20_000)


def test_license_suppression(spark):
    texts = ["This is released under the Apache License, Version 2.0 and nothing else", "Licensed under CC BY-NC 4.0.", "the GNU General Public License, version 3 or later", "plain words"]
    rows = license_scan.scan(spark.createDataFrame([(i, "s", t, 0.0, "k") for i, t in enumerate(texts)], DOCS)).orderBy("doc_id").collect()
    labels = [[d["label"] for d in r["scan"]["detections"]] if r["scan"] else [] for r in rows]
    assert labels[0] == ["apache-2.0"] and rows[0]["scan"]["labels"] == ["apache", "apache-2.0"]
    assert "cc-by-nc-4.0" in labels[1] and "cc-by" not in labels[1] and "cc-by" in rows[1]["scan"]["labels"]
    assert labels[2] == ["gpl-3-or-later"] and labels[3] == []
    for r in rows[:3]:
        spans = [(d["start"], d["end"]) for d in r["scan"]["detections"]]
        assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] for a in spans for b in spans)
    assert len(license_scan.rule_table()) >= 200


def rule_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {g for g in grams if grams.count(g) > 1}
    covered = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts_and_hosts(spark):
    r = random.Random(2)
    texts = [None, "", "\n\n", "\u00a0", "a b c a b c", "x " * 60, "a\x0bb\x1fc", "|<>\n|<>\n |<>", "\u00e9\U0001f600 " * 3]
    texts += [" ".join(r.choice("abcdefg") + r.choice(["", "#", "\n"]) for _ in range(r.randint(0, 120))) for _ in range(80)]
    rows = [(i, [None, "", "bad", "good"][i % 4], t, 0.0, "k") for i, t in enumerate(texts)] + [(1, "good", " ".join(map(str, range(90))), 0.0, "k")] * 3
    got = quality_rules.judge(spark.createDataFrame(rows, DOCS)).select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate").collect()
    assert len(got) == len(rows)
    want = sorted((d, s or "", *rule_counts(t)) for d, s, t, *_ in rows)
    assert sorted((x["doc_id"], x["source"] or "", *x[2:8]) for x in got) == want
    assert all(not x["kept"] for x in got if x["base_failed"]) and all(0 <= x["host_rate"] <= 1 for x in got)
    assert quality_rules.judge(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(1, "s", "w " * 60_000, 5, 6, 7.0, "h")], "doc_id long, source string, text string, n_words int, _s int, host_rate double, _host string")
    assert quality_rules.judge(odd).select("n_words", "n_repeat_words", "kept").first() == (60_000, 60_000, False)


def test_quality_host_verdict_rejects_only_bad_hosts(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "bad", good if i % 20 == 0 else "x " * 80, 0.0, "k") for i in range(200)] + [(i, f"s{i % 5}", good, 0.0, "k") for i in range(200)] + [(999, "tiny", "x", 0.0, "k")]
    out = quality_rules.judge(spark.createDataFrame(rows, DOCS)).groupBy("source").agg(F.sum(F.col("kept").cast("int")).alias("n")).collect()
    assert {r["source"]: r["n"] for r in out} == {"bad": 0, "tiny": 0} | {f"s{i}": 40 for i in range(5)}
