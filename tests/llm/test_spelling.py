from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from provenir.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, key int"


def plain_vocabulary(docs):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [v for v in words if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return sorted(out, key=repr)


def rows_of(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, frame.collect()), key=repr)


def family(seed, size):
    rng = random.Random(seed)
    words = {}
    for _ in range(size):
        word = "".join(rng.choices("abé", k=rng.randint(7, 12)))
        words[word] = rng.choice([2, 3, 20, 35, 250, 3000])
    return words


@pytest.mark.parametrize("region, block", [(4_096, 2_048), (40, 16), (5, 3)])
def test_variants_equal_plain_comparison(spark, table, monkeypatch, region, block):
    monkeypatch.setattr(spelling, "REGION", region)
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "TOGETHER", max(block // 2, 2))
    words = family(region, 700)
    words |= {"a" * k: 2 * 11 ** (k - 7) for k in range(7, 13)}
    frame = table(list(words.items()), "word string, n long")
    assert rows_of(spelling.variants(frame)) == plain(words)


def test_each_pair_is_found_once(spark, table):
    words = {"aabbccdd": 2, "aabbbccdd": 30, "aabccdd": 400, "aabbccdde": 5, "xaabbccdd": 6, "aabbccdx": 7}
    frame = table(list(words.items()), "word string, n long")
    pairs = [tuple(r) for r in spelling.near_words(frame).select("word", "near").collect()]
    assert sorted(pairs) == sorted({(a, b) for a in words for b in words if one_edit(a, b)})


def test_whole_texts(spark, table, prose):
    rng = random.Random(2)
    docs = [(i, prose(i, 300)) for i in range(60)]
    docs += [(i, " ".join(rng.choices(["thening", "THENing", "thenïng", "thenin", "theningly", "Āthening"], k=90))) for i in range(60, 110)]
    docs += [(None, "thening thening"), (200, None), (201, ""), (202, "1234 -- "), (203, "Abcdefgh" * 3000), (203, "Abcdefgh" * 3000)]
    docs += docs[:5]
    frame = table([(i, t, "clash", 1, 2) for i, t in docs], SCHEMA)
    words = plain_vocabulary(docs)
    assert sorted(map(tuple, spelling.vocabulary(frame).collect())) == sorted(words.items())
    assert rows_of(spelling.group(frame)) == plain(words)
    assert rows_of(spelling.group(frame.limit(0))) == []


def test_long_chains_of_forms(spark, table):
    words = {"w" * 7 + "abcdefgh"[:k]: 10 ** k * 2 for k in range(8)}
    frame = table(list(words.items()), "word string, n long")
    assert rows_of(spelling.variants(frame)) == plain(words)
