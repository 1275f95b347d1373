from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from provenir.llm import decontaminate
from provenir.llm.decontaminate import matches, ordered, remove

DOCS, ITEMS = "doc_id long, text string, words string, item int", "item_id long, text string, doc_id int"


def plain_ordered(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("seed", range(20))
def test_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(6) for _ in range(rng.randrange(90))] for _ in range(2))
    assert ordered(np.array(a, np.uint16), np.array(b, np.uint16)) == plain_ordered(a, b)


@pytest.fixture(scope="module")
def corpus(prose):
    rng = random.Random(2)
    items = [(i, prose(5000 + i, rng.randint(14, 60)), 0) for i in range(30)] + [(90, None, 0), (91, " .", 0), (92, prose(6000, 250), 0), (None, prose(6001, 30), 0), (93, "tiny item", 0)]
    docs = [(i, prose(i, rng.randint(1, 400)), "x", 1) for i in range(150)]
    holds = set()

    def plant(doc, item, text):
        at = prose(doc, 150).split(" ")
        cut = rng.randrange(len(at))
        docs.append((doc, " ".join(at[:cut] + [text] + at[cut:]), "x", 1))
        holds.add((doc, item))

    for i in range(30):
        plant(200 + i, i, items[i][1])
        words = items[i][1].split(" ")  # one word in eight replaced, case and marks changed
        for k in range(0, len(words), 8):
            words[k] = f"other{k}"
        plant(300 + i, i, " ".join(words).upper().replace(",", ";"))
    plant(400, 92, items[32][1])
    plant(401, None, items[33][1])
    shuffled = items[3][1].replace("\n", " ").split(" ")
    rng.shuffle(shuffled)
    docs += [(500, " ".join(shuffled), "x", 1), (501, None, "x", 1), (502, "", "x", 1), (None, prose(8000, 30), "x", 1)]
    docs += [docs[150], (None, docs[150][1], "x", 1)]
    holds.add((None, 0))
    return docs, items, holds


def test_planted_and_edited_passages_are_found(spark, table, corpus, rows):
    docs, items, holds = corpus
    got = matches(table(docs, DOCS), table(items, ITEMS))
    assert got.columns == ["doc_id", "item_id", "first_word", "end_word", "cosine", "in_order", "answer"]
    assert rows(got, "doc_id", "item_id") == sorted(holds, key=repr)


def test_clean_documents_stay(spark, table, corpus, rows):
    docs, items, holds = corpus
    kept = remove(table(docs, DOCS), table(items, ITEMS))
    found = {d for d, _ in holds if d is not None}
    want = [(d, t, w, i) for d, t, w, i in docs if d not in found and not (d is None and t == docs[150][1])]
    assert rows(kept, "doc_id", "text", "words", "item") == sorted(want, key=repr)


def test_blocks_of_the_benchmark_give_the_same(spark, table, corpus, rows, monkeypatch):
    docs, items, holds = corpus
    monkeypatch.setattr(decontaminate, "BLOCK_PASSAGES", 14)
    assert rows(matches(table(docs, DOCS), table(items, ITEMS)), "doc_id", "item_id") == sorted(holds, key=repr)


def test_empty_tables(spark, table, corpus):
    docs, items, _ = corpus
    assert matches(table([], DOCS), table(items, ITEMS)).collect() == []
    assert matches(table(docs[:5], DOCS), table([], ITEMS)).collect() == []
    assert remove(table(docs[:5], DOCS), table([], ITEMS)).count() == 5


def test_items_of_frequent_words_and_of_many_copies(spark, table, prose, rows):
    rng = random.Random(5)
    frequent = ["of", "the", "and", "to", "in", "for"]
    item = " ".join(rng.choice(frequent) for _ in range(24))
    copied = prose(7001, 40)
    docs = [(i, f"{prose(i, 60)} {copied} {prose(90 + i, 60)}", "x", 1) for i in range(30)]
    docs += [(100 + i, " ".join(f"{rng.choice(frequent)} {w}" if k % 5 == 0 else w for k, w in enumerate(prose(200 + i, 120).split())), "x", 1) for i in range(60)]
    docs.append((500, f"{prose(300, 70)} {item} {prose(301, 70)}", "x", 1))
    got = matches(table(docs, DOCS), table([(1, copied, 0), (2, item, 0)], ITEMS))
    assert rows(got, "doc_id", "item_id") == sorted([(i, 1) for i in range(30)] + [(500, 2)], key=repr)


def test_a_thousand_items_against_plain_subsequences(spark, table, prose, rows):
    rng = random.Random(6)
    items = [(i, prose(10_000 + i, rng.randint(9, 45)), 0) for i in range(1_100)]
    docs = []
    for i, (_, text, _) in enumerate(items[:150]):
        words = text.split()
        for k in range(len(words)):
            if rng.random() < (i % 6) / 10:  # from verbatim copies to those half replaced
                words[k] = f"other{k}"
        at = prose(i, 90).split()
        docs.append((i, " ".join([*at[: i % 80], *words, *at[i % 80 :]]), "x", 1))
    numbers: dict[bytes, int] = {}
    number = lambda text: np.array([numbers.setdefault(h.tobytes(), len(numbers)) for _, _, hashes, _ in decontaminate.words_of(pa.array([text])) for h in hashes], np.int64)
    texts, known = [number(d[1]) for d in docs], [number(x[1]) for x in items]
    ends = [len(number(decontaminate._answer(x[1]))) for x in items]
    want = []
    for d, text in enumerate(texts):
        for i, item in enumerate(known):
            m = len(item)
            if np.isin(item, text).sum() < 0.6 * m:
                continue
            for start in range(0, len(text), 32):
                here = text[max(0, start - m) : start + 64 + m]
                if ordered(here, item) >= 0.6 * m and ordered(here, item[m - ends[i] :]) >= 0.5 * ends[i]:
                    want.append((d, i))
                    break
    got = matches(table(docs, DOCS), table([(i, t, 0) for i, t, _ in items], ITEMS))
    assert rows(got, "doc_id", "item_id") == sorted(want, key=repr) and len(want) > 100


def test_a_larger_corpus_changes_no_match(spark, table, prose, rows):
    rng = random.Random(7)
    items = [(i, prose(20_000 + i, 16), 0) for i in range(20)]
    docs = []
    for i, text, _ in items:
        words = text.split()
        for k in rng.sample(range(10), 6):  # about 60 %, the answer whole
            words[k] = f"other{k}"
        docs.append((i, " ".join([f"a{k}" for k in range(64)] + words + [f"b{k}" for k in range(64)]), "x", 1))
    more = [(1_000 + i, " ".join(f"z{i}x{k}" for k in range(6_400)), "x", 1) for i in range(200)]
    columns = ("doc_id", "item_id", "cosine", "in_order", "answer")
    few, many = (rows(matches(table(d, DOCS), table(items, ITEMS)), *columns) for d in (docs, docs + more))
    assert few == many and len(few) > 15
