"""License scan by ordered signature rules, in DataFrame functions only.

A document that holds no rule's keyword, word by word, is settled by one pass of substring tests. The others are normalised to words
with single spaces; of the rule table only rules whose keyword occurs are run, every match of a rule becomes a detection
(start, end, priority, label), and a detection that lies within another one is suppressed: the detections are sorted by start,
then longest, then priority, and swept once. Everything happens inside the row, so a document of any length stays one row
and nothing is shuffled.

Base phrases are rules too. They are counted at every place and their labels stay even where a longer detection covers them.

Defined cases: null text is empty: no words, no places, null first and last word, empty labels, score 0. Repeated rows
are scanned one by one; an empty table gives an empty result; columns named n_words or scan are replaced, others carried along; the work
on a text grows with its length and its matches alone.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, running

#: Fixed values of the base: phrase and label.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_LICENSE = "licen[cs]ed?"
#: Identifiers after a machine-readable tag, in normalised words.
_SPDX = (
    ("mit", r"mit"), ("apache-2.0", r"apache 2 0"), ("bsd-2-clause", r"bsd 2 clause"), ("bsd-3-clause", r"bsd 3 clause"), ("isc", r"isc"), ("mpl-2.0", r"mpl 2 0"), ("gpl-2", r"gpl 2 0(?: only)?"),
    ("gpl-2-or-later", r"gpl 2 0 or later"), ("gpl-3", r"gpl 3 0(?: only)?"), ("gpl-3-or-later", r"gpl 3 0 or later"), ("lgpl-2.1", r"lgpl 2 1(?: only| or later)?"), ("lgpl-3", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-3", r"agpl 3 0(?: only| or later)?"), ("epl-2.0", r"epl 2 0"), ("cc0", r"cc0 1 0"), ("unlicense", r"unlicense"), ("zlib", r"zlib"), ("bsl-1.0", r"bsl 1 0"),
)
#: What to call a body, a word that it cannot do without, and a sentence of it in normalised words.
_BODIES = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("zlib", "warranty", r"provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("cc0", "waived", r"to the extent possible under law (?:[^ ]+ ){1,8}waived all copyright"),
    ("proprietary", "reserved", r"all rights reserved (?:no part|unauthori[sz]ed)"),
)
#: Families: label, keyword, name in words, versions ("" for none).
FAMILIES = (
    ("gpl", "gnu", "gnu general public", ("1", "2", "3")),
    ("gpl", "gpl", "gnu gpl", ("1", "2", "3")),
    ("lgpl", "gnu", "gnu lesser general public", ("2", "2.1", "3")),
    ("lgpl", "gnu", "gnu library general public", ("2", "2.1")),
    ("lgpl", "lgpl", "gnu lgpl", ("2", "2.1", "3")),
    ("agpl", "gnu", "gnu affero general public", ("1", "3")),
    ("gfdl", "gnu", "gnu free documentation", ("1.1", "1.2", "1.3")),
    ("apache", "apache", "apache", ("1.0", "1.1", "2.0")),
    ("apache", "apache", "apache software", ("1.0", "1.1", "2.0")),
    ("mit", "mit", "mit", ("",)),
    ("mit", "expat", "expat", ("",)),
    ("bsd", "bsd", "bsd", ("",)),
    ("bsd-2-clause", "bsd", "bsd 2 clause", ("",)),
    ("bsd-2-clause", "bsd", "2 clause bsd", ("",)),
    ("bsd-3-clause", "bsd", "bsd 3 clause", ("",)),
    ("bsd-3-clause", "bsd", "3 clause bsd", ("",)),
    ("bsd-4-clause", "bsd", "bsd 4 clause", ("",)),
    ("isc", "isc", "isc", ("",)),
    ("mpl", "mozilla", "mozilla public", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", "eclipse public", ("1.0", "2.0")),
    ("eupl", "european", "european union public", ("1.0", "1.1", "1.2")),
    ("cddl", "common", "common development and distribution", ("1.0", "1.1")),
    ("cpl", "common", "common public", ("1.0",)),
    ("artistic", "artistic", "artistic", ("1.0", "2.0")),
    ("bsl", "boost", "boost software", ("1.0",)),
    ("zlib", "zlib", "zlib", ("",)),
    ("ofl", "sil", "sil open font", ("1.0", "1.1")),
    ("psf", "python", "python software foundation", ("2",)),
    ("php", "php", "php", ("3.0", "3.01")),
    ("ms-pl", "microsoft", "microsoft public", ("",)),
    ("ms-rl", "microsoft", "microsoft reciprocal", ("",)),
    ("postgresql", "postgresql", "postgresql", ("",)),
    ("osl", "open", "open software", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic", "academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("odbl", "open", "open database", ("1.0",)),
    ("ncsa", "ncsa", "university of illinois ncsa open source", ("",)),
)
_CC_PARTS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|atives|s)"}
_CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def rule_table() -> list[dict]:
    """The ordered rules; lower priority wins between equal intervals. Words of a pattern are parted by single spaces."""
    rules: list[dict] = []

    def add(label: str, keyword: str, pattern: str, priority: int, conf: float, base: bool = False) -> None:
        rules.append({"id": len(rules), "priority": priority, "label": label, "keyword": keyword, "pattern": f"(?<= ){pattern}(?= )", "conf": conf, "base": base})

    def words(version: str) -> str:
        return version.replace(".", " ")

    for phrase, label in BASE_PHRASES:
        add(label, phrase.split()[0], phrase, 5, 0.9, True)
    for label, keyword, name, versions in FAMILIES:
        for v in versions:
            said = rf"(?: version| v|,)? v?{words(v)}(?: 0)?" if v else ""
            full = f"{label}-{v}" if v else label
            add(full, keyword, rf"(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?{name}(?: {_LICENSE})?{said}", 1, 1.0)
            add(full, keyword, rf"(?:the )?{name} {_LICENSE}{said}", 2, 0.9)
            if v:
                add(f"{full}-or-later", keyword, rf"(?:the )?{name} {_LICENSE}{said} or (?:any )?later(?: version)?", 1, 1.0)
        if versions != ("",):
            add(label, keyword, rf"(?:licensed|released|distributed|published|available) under (?:the )?{name} {_LICENSE}", 3, 0.9)
            add(label, keyword, rf"{name} {_LICENSE}", 4, 0.8)
    for kind in _CC_KINDS:
        short, long = kind.replace("-", " "), " ".join(_CC_PARTS[p] for p in kind.split("-"))
        for v in _CC_VERSIONS:
            add(f"cc-{kind}-{v}", "cc", rf"cc {short} {words(v)}", 1, 1.0)
            add(f"cc-{kind}-{v}", "creative", rf"creative commons {long}(?: international| unported| generic)? {words(v)}", 1, 1.0)
            add(f"cc-{kind}-{v}", "creative", rf"creative commons {long} {words(v)} (?:international|unported|generic)(?: public)? {_LICENSE}", 1, 1.0)
        add(f"cc-{kind}", "cc", rf"cc {short}", 3, 0.8)
        add(f"cc-{kind}", "creative", rf"creative commons {long}(?: {_LICENSE})?", 3, 0.9)
    add("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)? (?:public domain|licen[cs]e)", 1, 1.0)
    add("public-domain", "public domain", r"(?:dedicated to|released (?:in)?to|in) the public domain", 3, 0.8)
    add("proprietary", "license", r"(?:subject to|under) (?:a )?(?:proprietary|commercial) license", 3, 0.6)
    # Hand-written signatures: tags and sentences of license bodies.
    for label, tag in _SPDX:
        add(label, "spdx", rf"spdx license identifier {tag}", 0, 1.0)
    for label, keyword, sentence in _BODIES:
        add(label, keyword, sentence, 1, 0.95)
    add("unknown", "licensed", r"licensed under(?: the)?", 9, 0.3)
    return rules


_RULE_SCHEMA = "array<struct<id:int,priority:int,label:string,keyword:string,pattern:string,conf:double,base:boolean>>"


def _spans(norm: Column, pattern: Column) -> Column:
    """Start and end (from 0) of every match: matches are marked with two control characters, which no normalised text holds."""
    marked = F.split(F.regexp_replace(norm, pattern, F.lit("\x01$0\x02")), "\x01")

    def spans(parts: Column) -> Column:
        starts = running(F.transform(parts, lambda p, i: F.length(p) - (i > 0).cast("int")), F.lit(0), lambda a, n: a + n)
        every = lambda at: F.transform(parts, lambda p, i: F.struct(F.get(at, i).alias("s"), (F.get(at, i) + F.instr(p, "\x02") - 1).alias("e")))
        return let(starts, lambda at: F.slice(every(at), F.lit(2), F.size(parts)))

    return let(marked, spans)


def _detections(norm: Column, rules: Column) -> Column:
    """Sorted by start, longest first, then priority and rule."""
    hits = F.transform(
        F.filter(rules, lambda r: F.contains(norm, r["keyword"])),
        lambda r: F.transform(_spans(norm, r["pattern"]), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("me"), r["priority"].alias("p"), r["id"].alias("id"), r["label"].alias("label"), r["conf"].alias("conf"), r["base"].alias("base"))),
    )
    return F.array_sort(F.flatten(hits))


def _kept(detections: Column) -> Column:
    """Those that lie within no other: swept in order, one is covered if one before it ends no earlier."""
    before = running(F.transform(detections, lambda d: -d["me"]), F.lit(-1), lambda a, e: F.greatest(a, e))
    kept = let(before, lambda ends: F.filter(detections, lambda d, i: F.get(ends, i) < -d["me"]))
    return F.when(F.size(detections) > 0, kept).otherwise(detections)


def scan(docs: DataFrame, text: str = "text", rules: list[dict] | None = None) -> DataFrame:
    """``docs`` with n_words and ``scan``: detections kept (label, start, end, conf) and the base places."""
    t = F.coalesce(F.col(text), F.lit(""))
    rules = rule_table() if rules is None else rules

    def gate(lowered):
        """A keyword's words lie whole between separators, so they are looked for one by one before any normalising."""
        found = F.lit(False)
        for keyword in sorted({r["keyword"] for r in rules}):
            found = found | reduce(and_, (F.contains(lowered, F.lit(w)) for w in keyword.split()), F.lit(True))
        return found

    table = F.from_json(F.lit(json.dumps(rules)), _RULE_SCHEMA)
    norm = F.concat(F.lit(" "), F.regexp_replace(ascii_lower(t), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))
    norm = F.regexp_replace(norm, "^ +| +$", " ")

    def word_at(norm, place):
        before = F.substring(norm, F.lit(1), place)
        return (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1).cast("long")

    def result(norm):
        def of(found):
            base, kept = F.filter(found, lambda d: d["base"]), _kept(found)

            def fold(base, kept):
                labels = F.transform(base, lambda d: d["label"])
                return F.struct(
                    F.size(base).cast("long").alias("n_base"),
                    F.when(F.size(base) > 0, word_at(norm, F.get(base, F.lit(0))["s"])).alias("first_word"),
                    F.when(F.size(base) > 0, word_at(norm, F.get(base, F.size(base) - 1)["s"])).alias("last_word"),
                    F.array_sort(F.array_distinct(labels)).alias("base_labels"),
                    F.array_sort(F.array_distinct(F.concat(labels, F.transform(kept, lambda d: d["label"])))).alias("labels"),
                    F.coalesce(F.array_max(F.transform(kept, lambda d: d["conf"])), F.lit(0.0)).alias("score"),
                    F.transform(kept, lambda d: F.struct(d["label"].alias("label"), d["s"].alias("start"), (-d["me"]).alias("end"), d["conf"].alias("conf"))).alias("detections"),
                )

            return let(base, lambda b: let(kept, lambda k: fold(b, k)))

        return let(_detections(norm, table), of)

    return docs.select(
        *[c for c in docs.columns if c not in (text, "n_words", "scan")],
        F.regexp_count(t, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"),
        F.when(let(ascii_lower(t), gate), let(norm, result)).alias("scan"),
    )
