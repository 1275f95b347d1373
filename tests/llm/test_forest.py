from __future__ import annotations

import math

import numpy as np
import pytest

from provenir.llm import forest

SCHEMA = "vec_id long, embedding array<float>, tree int, ids string"


def brute(rows, asked, k):
    rows = {(i, tuple(np.float32(v).tolist())) for i, v in rows}
    out = {}
    for q, x in asked:
        x = np.float64(np.float32(x))
        found = []
        for i, v in rows:
            if i != q:
                v = np.array(v)
                found.append((-(x * v).sum() / (math.sqrt((x * x).sum()) * math.sqrt((v * v).sum())), i))
        out[q] = sorted(found)[:k]
    return out


def check(got, want, least):
    hit = total = 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(want)
    for q, rows in by.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, len(want[q]) + 1))
        assert all(a[2] >= b[2] - 1e-12 for a, b in zip(rows, rows[1:]))
        hit += len({i for _, i, _ in rows} & {i for _, i in want[q]})
        total += len(rows)
    assert hit >= least * total


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_against_brute_force(spark, table, clustered, monkeypatch):
    monkeypatch.setattr(forest, "LEAST", 500)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 24))
    if clustered:
        x = rng.standard_normal((30, 24))[rng.integers(0, 30, 3000)] + 0.3 * x
    rows = list(enumerate(x.tolist()))
    frame = table([(*r, 1, "x") for r in rows], SCHEMA)
    got = forest.neighbours(frame, frame.filter("vec_id % 50 = 0"), leaf=64).collect()
    check(got, brute(rows, rows[::50], 5), 0.9)


def test_copies_ties_and_vectors_that_take_no_part(spark, table):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(40)] + [rows[3], (150, (2 * np.float32(rows[7][1])).tolist())]
    bad = [(200, None), (201, [0.0] * 6), (202, [1.0, None] * 3), (203, [math.nan] * 6), (204, [math.inf] + [0.0] * 5), (205, []), (206, [1.0]), (None, rows[1][1])]
    frame = table([(*r, 1, "x") for r in rows + bad], SCHEMA)
    want = brute(rows, rows, 5)
    got = forest.neighbours(frame, frame).collect()
    check(got, want, 1.0)
    near = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 120)
    assert [i for _, i in near if i != 150][:4] == [7, 100, 101, 102]


def test_fewer_candidates_than_asked_and_empty_tables(spark, table):
    frame = table([(1, [1.0, 0.0], 1, ""), (2, [1.0, 1.0], 1, "")], SCHEMA)
    got = forest.neighbours(frame, frame.filter("vec_id = 1")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(1, 1, 2)] and got[0]["score"] == pytest.approx(math.sqrt(0.5))
    assert forest.neighbours(frame.filter("false"), frame).collect() == []
    assert forest.neighbours(frame, frame.filter("false")).collect() == []


def test_search_opens_the_nearest_branches_first():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    trees = [forest.plant(x, 16, s) for s in range(3)]
    for row in x[:20]:
        opened = forest.search(trees, row, 3.0)
        assert len(set(opened)) == len(opened) == sum((t["low"] < 0).sum() for t in trees)
        assert {(t, int(forest.leaves(tree, row[None])[0])) for t, tree in enumerate(trees)} <= set(opened[:9])


def test_cells_return_k_rows_a_query_and_change_nothing(spark, table, monkeypatch):
    monkeypatch.setattr(forest, "LEAST", 200)
    rng = np.random.default_rng(8)
    rows = [(i % 950, x) for i, x in enumerate(rng.standard_normal((1000, 8)).tolist())]
    frame = table([(*r, 1, "x") for r in rows], SCHEMA)
    asked = frame.filter("vec_id % 9 = 0 and vec_id > 60")
    sizes, results = [], []
    for cell, block in ((65_536, 4_096), (90, 20)):
        monkeypatch.setattr(forest, "CELL", cell)
        monkeypatch.setattr(forest, "BLOCK", block)
        got = forest.neighbours(frame, asked, leaf=16)
        plan = got._jdf.queryExecution().toString()
        # Found rows carry a number of their query, not its vector.
        assert "FlatMapCoGroupsInArrow" in plan and "query#" in plan and "binary" not in plan
        results.append(sorted(map(tuple, got.collect())))
        sizes.append(len(results[-1]))
    assert results[0] == results[1] and sizes[0] == 5 * asked.select("vec_id").distinct().count()


def test_an_id_of_many_vectors_does_not_fill_the_places():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 4))
    x = v[0]
    ids = [[7] if i < 100 else [i] for i in range(300)]
    v[:100] = x + 1e-3 * v[:100]
    size = np.linalg.norm(v, axis=1)
    got = forest.nearest(v @ x / size, x, 1, v, ids, 5)
    cosine = v @ x / size / np.linalg.norm(x)
    want = sorted([(-cosine[:100].max(), 7), *((-cosine[i], i) for i in range(100, 300))])[:5]
    assert [a for _, a in got] == [a for _, a in want] and np.allclose([s for s, _ in got], [s for s, _ in want])
