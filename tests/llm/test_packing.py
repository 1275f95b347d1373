from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from provenir.llm import packing
from provenir.llm.packing import CapacityTree, WordIds, best_fit, pack
from provenir.llm.queries import tokenizer_path

ODD = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n\nb", "\ta\t\tb", "x y  z", "it's  we'll 12 3",
    "<|endoftext|> a <|endoftext|>", "一二  q", "naïve \U0001f600\U0001f600 !", "a\x1c\x1d b", "\x85 a\x85\nb\r\nc",
]


def test_ids_are_the_tokenizers(prose):
    from tokenizers import Tokenizer

    plain, words = Tokenizer.from_file(tokenizer_path()), WordIds(tokenizer_path())
    texts = [t or "" for t in ODD] + [prose(i, 300) for i in range(5)]
    for _ in range(2):  # the second time all words are known
        for text, ids in zip(texts, words.ids([t.encode() for t in texts])):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_words_used_often_are_tokenized_once(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    words, asked = WordIds(tokenizer_path()), []
    plain = words._plain
    words._plain = lambda text: asked.append(text) or plain(text)
    for k in range(6):
        text = " ".join(["first", *["often"] * 5, *(f"rare{k}x{i}" for i in range(30))])
        assert words.ids([text.encode()])[0].tolist() == plain(text).tolist()
        assert len(words.spaced) + len(words.bare) <= 50 + 32
    assert sum("often" in text for text in asked) == 1


def test_tightest_open_window():
    rng = random.Random(1)
    tree, open_ = CapacityTree(100), [0] * 101
    for _ in range(500):
        at = rng.randrange(101)
        change = 1 if not open_[at] or rng.random() < 0.6 else -1
        open_[at] += change
        tree.add(at, change)
        size = rng.randrange(101)
        assert tree.tightest(size) == next((c for c in range(size, 101) if open_[c]), None)


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_packing_by_counts_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 32), rng.choice([3, 8, 16])]) for _ in range(400)]
    counts = {s: sizes.count(s) for s in set(sizes)}
    runs, fills = best_fit(counts, 32)
    windows, held = defaultdict(list), defaultdict(int)
    for size, rank, n, first, each, offset in runs:
        for i in range(n):
            windows[first + i // each].append((offset + i % each * size, size))
        held[size] += n
    assert dict(held) == counts
    for pieces in windows.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end <= 32
    used = [n for _, k, n in fills for _ in range(k)]
    assert sorted(32 - u for u in used) == plain_best_fit(sizes, 32)


def test_every_id_is_in_one_piece(spark, table, prose):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(50 + i, prose(i, 10 * i)) for i in range(20)] + [(90, prose(9, 3000))]
    docs += [docs[3], docs[-1], (None, "no id"), (None, None)]
    frame = table([(*d, "x", 1.5) for d in docs], "doc_id long, text string, length string, start double")
    got = pack(frame, tokenizer_path(), capacity=64).collect()
    words = WordIds(tokenizer_path())
    wanted = sorted(((d, *words.ids([(t or "").encode()])[0].tolist(), 0) for d, t in docs), key=repr)
    whole, windows = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        whole[r["doc_id"], r["doc_tokens"]].append((r["start"], tuple(r["ids"])))
        windows[r["sequence_id"]].append((r["offset"], r["length"], r["padded_length"]))
    found = []
    for (doc, _), pieces in whole.items():
        starts = sorted(pieces)
        copies = sum(1 for s, _ in starts if s == 0)
        if copies == 1:
            found.append((doc, *(x for _, p in starts for x in p)))
    assert all(x in wanted for x in found) and sum(r["length"] for r in got) == sum(len(w) - 1 for w in wanted)
    for pieces in windows.values():
        end = 0
        for offset, length, _ in sorted(pieces):
            assert offset == end
            end += length
        assert {p for _, _, p in pieces} == {end if end & (end - 1) == 0 else 64} and end <= 64
    assert len(windows) == max(windows) + 1


def test_empty_table(spark, table):
    assert pack(table([], "doc_id long, text string"), tokenizer_path()).collect() == []
