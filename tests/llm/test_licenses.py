from __future__ import annotations

import re

from provenir.llm.license_rules import BASE, RULES
from provenir.llm.licenses import scan

SCHEMA = "doc_id long, text string, row string, score string, keywords int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    words = words_of(text)
    starts, base = [], set()
    for label, phrase in BASE:
        own = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        starts += here
        base |= {label} if here else set()
    line = " " + " ".join(words) + " "
    found = []
    for r in RULES:
        if r.keyword in words:
            found += [(m.start(), m.end(), r.priority, r.label) for m in re.finditer(f" (?:{r.pattern})(?= )", line)]
    # Dropped if another covers it with a higher priority, or with the same one and more words.
    kept = [
        x for x in found
        if not any(
            y[0] <= x[0] and y[1] >= x[1] and (y[2] > x[2] or y[2] == x[2] and y[:2] != x[:2])
            or y[:3] == x[:3] and y[3] < x[3]
            for y in found
        )
    ]
    best = max((x[2] for x in kept), default=0)
    labels = base | {x[3] for x in kept}
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best / 5,
    )


TEXTS = [
    None, "", " ...", "mit und mit der MIT-Licence", "Under the MIT license, under   the mit LICENSE under the mit licensee",
    "Apache License, Version 2.0 and apache license version 22", "cc by-nc cc by-nc-sa 4.0 CC/BY/NC \U0001f600 cc by nc",
    "GNU Lesser General Public License v2.1. GNU General Public License, version 3; SPDX-License-Identifier: GPL-3.0-or-later",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International. All rights reserved.",
    "Kit license under the Kmit license éunder the mit license", "BSD 3-Clause License; 2-clause BSD; the new BSD license",
    "This is free and unencumbered software released into the public domain. " * 40,
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software",
]


def test_scan_is_that_of_plain_regexes(spark, table, prose, rows):
    texts = TEXTS + [r.pattern.replace(r"(?:", "").replace(")?", "") for r in RULES] + [
        prose(i, 40) + " Released under the MIT License. " + prose(i + 1, 20) + " licensed under CC BY-NC 4.0" for i in range(4)
    ]
    docs = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    got = scan(table([(*d, "x", "y", 1) for d in docs], SCHEMA))
    assert got.columns[:3] == ["doc_id", "text", "row"] and got.columns[3] == "keywords"
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert rows(got, *columns) == sorted([(d, *brute(t)) for d, t in docs], key=repr)


def test_no_python_in_the_plan(spark, table):
    plan = scan(table([(1, "a", "", "", 0)], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("PythonSQLMetrics", ""))


def test_empty_table_and_rules(spark, table):
    assert scan(table([], SCHEMA)).collect() == []
    assert len(RULES) > 200 and all(r.keyword and re.compile(r.pattern) for r in RULES)
