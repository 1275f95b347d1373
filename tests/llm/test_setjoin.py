from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from provenir.llm import setjoin
from provenir.llm.common import components

SCHEMA = "doc_id long, text string, node string, n long, grams int"


def shingles(text, words):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(own) < words:
        return {tuple(own)} if own else set()
    return {tuple(own[i : i + words]) for i in range(len(own) - words + 1)}


def brute(docs, words, num, den):
    sets = [shingles(t, words) for _, t in docs]
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [(d, len(sets[i]), best.get(find(i))) for i, (d, _) in enumerate(docs)]


def corpus(prose):
    rng = random.Random(5)
    docs = [(i, prose(i, rng.choice([1, 2, 3, 8, 40, 120]))) for i in range(40)]
    base = prose(99, 60).split(" ")
    for i in range(40, 140):  # one large group of near copies around the threshold
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(50)}"
        docs.append((i, " ".join(own)))
    line = prose(77, 12)
    docs += [(200 + i, line + "\n" + prose(300 + i, 30)) for i in range(30)]  # a line that many share
    docs += [(300, None), (301, ""), (302, " \t\n"), (303, "One  TWO"), (304, "one two"), (305, "two one")]
    docs += [docs[3], docs[60], (None, docs[60][1]), (None, "alone by itself here")]
    return docs


@pytest.mark.parametrize("words,num,den", [(3, 90, 100), (5, 8, 10)])
def test_components_are_those_of_all_pairs(spark, table, prose, rows, words, num, den):
    docs = corpus(prose)
    got = setjoin.join(table([(*d, "x", 7, 1) for d in docs], SCHEMA), words=words, num=num, den=den)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert rows(got, *got.columns) == sorted(brute(docs, words, num, den), key=repr)


def test_voronoi_rounds_give_the_same(spark, table, prose, rows, monkeypatch):
    monkeypatch.setattr(setjoin, "PIVOTS", (1, 2, 4, 64))
    monkeypatch.setattr(setjoin, "WIDE", 2)
    docs = corpus(prose)
    got = setjoin.join(table([(*d, "x", 7, 1) for d in docs], SCHEMA), words=3, num=90, den=100)
    assert rows(got, *got.columns) == sorted(brute(docs, 3, 90, 100), key=repr)


def test_pairs_of_a_large_group_of_near_copies_grow_with_its_size(spark, table, rows, monkeypatch):
    rng = random.Random(8)
    base = [f"word{i}" for i in range(150)]
    docs = [(i, " ".join(base)) for i in (500, 501)]
    for i in range(300):  # two of them link only if they have at most two new words together
        own = list(base)
        for k in rng.sample(range(150), rng.choice([1, 2, 2, 2])):
            own[k] = f"new{i}x{k}"
        docs.append((i, " ".join(own)))
    met, sifted = [], setjoin._sifted
    monkeypatch.setattr(setjoin, "_sifted", lambda pairs, *more: met.append(pairs.count()) or sifted(pairs, *more))
    got = setjoin.join(table([(*d, "x", 7, 1) for d in docs], SCHEMA), words=3, num=90, den=100)
    assert rows(got, *got.columns) == sorted(brute(docs, 3, 90, 100), key=repr)
    assert sum(met) <= 3 * len(docs)


def test_empty_table(spark, table):
    assert setjoin.join(table([], SCHEMA)).collect() == []


def test_a_set_does_not_depend_on_what_stands_around_it(prose):
    texts = [prose(i, 50) for i in range(5)] + ["", "a", "a b"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    together = setjoin.shingle_sets(offsets, np.frombuffer(b"".join(data), np.uint8), 3)
    for d, own in zip(data, together):
        alone = setjoin.shingle_sets(np.array([0, len(d)]), np.frombuffer(d, np.uint8), 3)[0]
        assert (alone == own).all() and len(own) == len(shingles(d.decode(), 3))


def test_components_of_a_chain_and_a_star(spark, table, rows):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7)]
    got = rows(components(table(links, "a long, b long")), "node", "component")
    assert got == sorted([(i, 1) for i in range(1, 41)] + [(100 + i, 100) for i in range(20)], key=repr)


def test_only_documents_of_the_filter_are_read(monkeypatch):
    read = []
    real = setjoin.shingle_sets
    monkeypatch.setattr(setjoin, "shingle_sets", lambda offsets, data, words: read.append(len(offsets) - 1) or real(offsets, data, words))
    ids, texts = pa.array(range(50)), pa.array([f"a b c d {i}" for i in range(50)])
    known = np.zeros(setjoin.BITS, bool)
    known[setjoin._place(np.array([3, 8]))] = True

    class Sent:
        value = known

    batch = pa.RecordBatch.from_arrays([ids, texts, ids], ["id", "text", "name"])
    got = [n for part in setjoin._wanted(5, Sent)(iter([batch])) for n in part.column("node").to_pylist()]
    assert sum(read) == 2 and len(got) == 2


def test_names_of_sets_are_those_of_each_alone():
    sets = [np.arange(n, dtype=np.uint64) for n in (3, 0, 1, 0, 7)] + [np.zeros(0, np.uint64)]
    names = setjoin.nodes_of(sets)
    assert all(names[i] == setjoin.nodes_of([s])[0] for i, s in enumerate(sets)) and len(set(names[[0, 2, 4]].tolist())) == 3
