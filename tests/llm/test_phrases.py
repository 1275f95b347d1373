from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from provenir.llm import phrases

SCHEMA = "lang string, text string, key int, word long, shard string"


def plain(docs, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {q[i : i + k] for q in found for k in range(2, len(q)) for i in range(len(q) - k + 1) if counts[q[i : i + k]] <= found[q]}
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def got(frame, least, top, shards=3):
    out = phrases.collocations(frame, least, top, shards)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert dict(out.dtypes)["rank"] == "bigint" and dict(out.dtypes)["score"] == "bigint"
    return sorted(map(tuple, out.collect()))


@pytest.fixture(scope="module")
def docs(prose):
    rng = random.Random(3)
    words = ["alpha", "béta", "Gamma", "δέλτα", "x" * 40, "中文", "e\tf", "zeta"]
    docs = [(rng.choice(["en", "fr", None, "und"]), prose(i % 31, 120)) for i in range(90)]
    docs += [("en", " ".join(rng.choices(words, k=60)) + rng.choice([".", "\n", "?"]) + "alpha beta gamma delta epsilon zeta eta") for _ in range(40)]
    docs += [("en", None), ("fr", ""), (None, " .\t, \n"), ("de", "la la la la la la la la la " * 40), ("en", "one")] + docs[:3]
    return docs


@pytest.mark.parametrize("least, shards", [(12, 3), (5, 2)])
def test_same_as_plain_counting(spark, table, docs, least, shards):
    frame = table([(*d, 1, 2, "x") for d in docs], SCHEMA).repartition(4)
    assert got(frame, least, 50, shards) == plain(docs, least, 50)


def test_filters_that_let_everything_through_change_nothing(spark, table, docs, monkeypatch):
    monkeypatch.setattr(phrases, "BITS", 1 << 19)
    monkeypatch.setattr(phrases, "COUNTERS", 1 << 16)
    monkeypatch.setattr(phrases, "KEPT", 50)
    monkeypatch.setattr(phrases, "_bit", lambda h: np.zeros(len(h), np.int64))
    frame = table([(*d, 1, 2, "x") for d in docs[:60]], SCHEMA).repartition(3)
    assert got(frame, 8, 2_000) == plain(docs[:60], 8, 2_000)


def test_words_with_one_hash_are_counted_again(spark, table, monkeypatch):
    frame = table([("en", "red blue green. " * 9 + "blue red", 1, 2, "x")], SCHEMA)
    real = phrases._cycles
    calls = []

    def cycles(texts, least, shards, seed):
        calls.append(seed)
        return real(texts, least, shards, seed) if len(calls) > 1 else None

    monkeypatch.setattr(phrases, "_cycles", cycles)
    assert got(frame, 5, 9) == plain([("en", "red blue green. " * 9 + "blue red")], 5, 9)
    assert len(set(calls)) == 2
    monkeypatch.undo()
    monkeypatch.setattr(phrases, "span_hashes", lambda data, starts, stops: (stops - starts).astype(np.uint64))
    texts = frame.selectExpr("lang", "'red fed' as text", "0 as shard")
    assert phrases._cycles(texts, 1, 1, 0) is None


def test_empty_tables(spark, table):
    frame = table([("en", "a b", 1, 2, "x")], SCHEMA)
    assert got(frame.limit(0), 1, 5) == []
    assert got(frame, 2, 5) == []
    assert got(frame, 1, 5) == [("en", 1, "a b", 1, 1, 1, 2, 2000)]


def test_products_beyond_64_bits(spark, table, monkeypatch):
    big = 9 * 10**15
    rows = [("en", b"a" * 8, "x", big), ("en", b"b" * 8, "y", big), ("en", b"a" * 8 + b"b" * 8, "x y", big - 1)]
    phrases_table = table(rows, "lang string, key binary, word string, n long")
    totals = table([("en", 5 * big)], "lang string, n long")
    monkeypatch.setattr(phrases, "count_phrases", lambda *a: (phrases_table, totals))
    assert got(phrases_table, 1, 5) == [("en", 1, "x y", big - 1, big, big, 5 * big, 1000 * (big - 1) * 5 * big // big**2)]
