from __future__ import annotations

import math
import random

import numpy as np
import pytest

from provenir.llm import kd_search
from provenir.llm.kd_search import CLOSED, Tree, product, top_k

SCHEMA = "vec_id long, embedding array<double>, id long, score string"


def brute(rows, asked, k, scale=64):
    scaled = lambda v: tuple(math.floor(scale * x) for x in v)
    rows = {(i, scaled(v)) for i, v in rows}
    out = []
    for q, x in {(i, scaled(v)) for i, v in asked}:
        found = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in rows if i != q and len(v) == len(x))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def got(frame, step, k):
    out = top_k(frame, frame.filter(f"vec_id % {step} = 0"), k)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("shard, block", [(8_192, 65_536), (150, 16), (40, 7)])
def test_same_as_brute_force_whatever_the_shards(spark, table, monkeypatch, shard, block):
    monkeypatch.setattr(kd_search, "SHARD", shard)
    monkeypatch.setattr(kd_search, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 12))[rng.integers(0, 20, 900)] + 0.2 * rng.standard_normal((900, 12))
    rows = list(enumerate(x.tolist()))
    frame = table([(*r, 1, "x") for r in rows], SCHEMA)
    assert got(frame, 20, 20) == brute(rows, rows[::20], 20)


def test_ties_copies_and_vectors_that_take_no_part(spark, table):
    rng = random.Random(5)
    rows = [(i, [rng.randint(-3, 3) / 64 for _ in range(5)]) for i in range(300)]
    rows += [(i, [1.0, 0.5, -2.0, 0.015, 0.016]) for i in range(400, 520)] + rows[:30]
    rows += [(600, rows[0][1]), (600, rows[1][1]), (620, [1.0, 2.0]), (621, [3.0, 4.0]), (640, []), (641, [])]
    bad = [(700, None), (720, [math.nan] * 5), (740, [1.0, None, 1.0, 1.0, 1.0]), (760, [math.inf] * 5), (None, [1.0] * 5)]
    frame = table([(*r, 1, "x") for r in rows + bad], SCHEMA)
    assert got(frame, 20, 20) == brute(rows, [r for r in rows if r[0] % 20 == 0], 20)


def test_few_rows_and_empty_tables(spark, table):
    rows = [(i, [float(i), 1.0]) for i in range(5)]
    frame = table([(*r, 1, "x") for r in rows], SCHEMA)
    assert got(frame, 2, 20) == brute(rows, rows[::2], 20)
    assert got(frame.limit(0), 2, 20) == []
    assert top_k(frame, frame.limit(0)).collect() == []


def test_large_components_stay_exact(spark, table):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1, 1]) * (2.0**22 + rng.randint(0, 9)) for _ in range(6)]) for i in range(80)]
    frame = table([(*r, 1, "x") for r in rows], SCHEMA)
    assert got(frame, 20, 9) == brute(rows, rows[::20], 9)
    huge = [(0, [1e30, 1e30]), (1, [1e30, 1e30]), (2, [-1e30, 0.0]), (3, [1e-30, 0.0])]
    frame = table([(*r, 1, "x") for r in huge], SCHEMA)
    assert got(frame, 20, 9) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 0), (0, 3, 2, CLOSED + 1)]


def test_boxes_are_tight_and_close_what_cannot_reach():
    rng = np.random.default_rng(0)
    rows = np.floor(64 * (rng.standard_normal((12, 3))[rng.integers(0, 12, 4000)] * 5 + rng.standard_normal((4000, 3)) * 0.1))
    tree = Tree(rows, np.arange(4000))
    for node in range(len(tree.begin)):
        part = tree.rows[tree.begin[node] : tree.end[node]]
        assert (part.min(axis=0) == tree.low[node]).all() and (part.max(axis=0) == tree.high[node]).all()
    assert (product(rows[:9], tree.rows).max(axis=1) <= tree.bounds(rows[:9])[:, 0]).all()
    opened = []
    real = Tree._open
    tree._open = lambda node, queries, *rest: (opened.append(len(queries)), real(tree, node, queries, *rest))
    tree.search(rows[:50], np.arange(50), np.full(50, CLOSED), 20)
    assert sum(opened) < 0.2 * 50 * (tree.children[:, 0] < 0).sum()
