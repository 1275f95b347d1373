from __future__ import annotations

import pytest

from provenir.sources.keyed_store import KeyedStore, corridor_store

SCHEMA = "k string, at long, v string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_only_touched_buckets_are_rewritten(spark, table, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, "k", ["at"], buckets=16)
    assert rows_of(store.read()) == [] and store.manifest() == {}
    first = [(f"k{i}", 1, "a") for i in range(100)]
    assert store.merge(table(first + [(None, 1, "x")], SCHEMA)) == 1
    before = store.manifest()
    assert len(before) == 16 and rows_of(store.read()) == sorted(first)
    assert store.merge(table([("k7", 2, "b"), ("k7", 0, "old"), ("new", 1, "c")], SCHEMA)) == 2
    after = store.manifest()
    changed = {b for b in after if after[b] != before[b]}
    assert 1 <= len(changed) <= 2
    want = sorted([r for r in first if r[0] != "k7"] + [("k7", 2, "b"), ("new", 1, "c")])
    assert rows_of(store.read()) == want
    assert rows_of(store.read(generation=1)) == sorted(first)
    assert store.merge(table([("k7", 1, "late")], SCHEMA)) == 3 and rows_of(store.read()) == want
    assert store.merge(table([], SCHEMA)) == 4 and rows_of(store.read()) == want
    with pytest.raises(ValueError, match="no generation"):
        store.read(generation=9)


def test_lookup_opens_the_asked_buckets(spark, table, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, "k", ["at"], buckets=32)
    store.merge(table([(f"k{i}", i, "a") for i in range(200)], SCHEMA))
    found = store.lookup(table([("k5", 0), ("none", 1), (None, 2)], "k string, ask int"))
    assert sorted(map(str, rows_of(found.select("ask", "k", "at")))) == sorted(map(str, [(0, "k5", 5), (1, "none", None), (2, None, None)]))
    folders = {f.rsplit("/", 2)[-2] for f in found.inputFiles() if "bucket=" in f}
    assert 1 <= len(folders) <= 2


def test_ties_other_versions_and_failed_writes(spark, table, tmp_path):
    root = str(tmp_path / "s")
    store = KeyedStore(spark, root, SCHEMA, "k", ["at"], buckets=4)
    store.merge(table([("k", 1, v) for v in "bdac"], SCHEMA))
    assert rows_of(store.read()) == [("k", 1, "d")]
    store.merge(table([("k", 1, "c")], SCHEMA))
    assert rows_of(store.read()) == [("k", 1, "d")]
    assert rows_of(KeyedStore(spark, root, SCHEMA, "k", ["at"], buckets=4, version=2).read()) == []
    with pytest.raises(ValueError, match="buckets"):
        KeyedStore(spark, root, SCHEMA, "k", ["at"], buckets=8).read()
    # A generation without its mark was never committed.
    (tmp_path / "s/generations/9").mkdir()
    assert store.generations() == [1, 2]


def test_corridors(spark, table, tmp_path):
    from datetime import datetime

    from provenir import schemas

    store = corridor_store(spark, str(tmp_path / "c"))
    rows = [("k", datetime(2026, 8, d), [], [r], ["n"], ["q"], 0, 3) for d, r in ((13, "fees"), (14, "visa_decision"))]
    store.merge(table(rows, schemas.RESOLVED_CORRIDORS))
    assert store.read().first()["unresolved_roles"] == ["visa_decision"]
