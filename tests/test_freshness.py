from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from provenir.operators import freshness as fr
from provenir.operators.large_groups import ranged
from provenir.streaming.cache_stream import OUTPUT, CacheFold, fold_in_order, replay, run_available, unanswered
from provenir.streaming.newest_stream import keep_newest

HOUR = fr.HOUR
SCHEMA = "event_id long, url string, at long, seq long, attempt string, content_hash string"


def timeline(table, events, ttl=24.0, ceiling=168.0):
    rows = [(i, "u", int(h * HOUR), i, attempt, digest) for i, (h, attempt, digest) in enumerate(events)]
    got = fr.fold_cache(table(rows, SCHEMA), ttl, ceiling).orderBy("seq").collect()
    return [(r["result"], r["outcome"], None if r["served_at"] is None else r["served_at"] // HOUR, r["served_hash"]) for r in got]


def test_timeline(table):
    events = [
        (0, "stored", "a"),
        (5, "stored", "b"),
        (25, "not_modified", None),
        (30, "unreachable", None),
        (50, "stored", "c"),
        (80, "unreachable", None),
        (81, "untrusted", None),
    ]
    assert timeline(table, events) == [
        ("fetched", "ok", 0, "a"),
        ("hit", "ok", 0, "a"),
        ("revalidated", "ok", 25, "a"),
        ("hit", "ok", 25, "a"),
        ("fetched", "ok", 50, "c"),
        ("stale", "stale", 50, "c"),
        ("failure", "untrusted", None, None),
    ]


def test_past_the_ceiling(table):
    rows = table([(0, "u", 0, 0, "stored", "a"), (1, "u", 73 * HOUR, 1, "unreachable", None)], SCHEMA)
    last = fr.fold_cache(rows, 24.0, 72.0).orderBy("seq").collect()[-1]
    assert (last["result"], last["outcome"]) == ("failure", "unreachable") and "past the 72 hour limit" in last["detail"]


def test_not_modified_without_a_cache(table):
    assert timeline(table, [(0, "not_modified", None), (1, "stored", "a")]) == [
        ("failure", "unreachable", None, None),
        ("fetched", "ok", 1, "a"),
    ]


def test_attempt_ladder(table):
    rows = [
        ("disallowed", None, True, 200, 1, False, "ok", None, "disallowed"),
        ("allowed", "reset", True, 200, 1, False, "ok", None, "unreachable"),
        ("allowed", None, False, 304, 1, False, "ok", None, "untrusted"),
        ("allowed", None, True, 304, 1, False, "ok", None, "not_modified"),
        ("allowed", None, True, 429, 1, False, "ok", None, "blocked"),
        ("allowed", None, True, 500, 1, False, "ok", None, "unreachable"),
        ("allowed", None, True, 200, 4_000_001, False, "ok", None, "unusable"),
        ("allowed", None, True, 200, 1, True, "ok", None, "unusable"),
        ("allowed", None, True, 200, 1, False, "untrusted", None, "untrusted"),
        ("allowed", None, True, 200, 1, False, "ok", "thin", "unusable"),
        ("allowed", None, True, 200, 1, False, "ok", None, "stored"),
    ]
    schema = "policy string, error string, trusted boolean, http_status int, bytes long, machine boolean, forward string, thin string, expected string"
    got = fr.attempt(table(rows, schema)).collect()
    assert [r["attempt"] for r in got] == [r["expected"] for r in got]


def _random_events(count, span_hours, seed):
    generator = random.Random(seed)
    kinds = ["stored", "not_modified", "unreachable", "untrusted", "blocked"]
    rows = []
    for i in range(count):
        kind = generator.choice(kinds)
        digest = f"h{generator.randrange(4)}" if kind == "stored" else None
        rows.append((i, f"u{generator.randrange(3)}", generator.randrange(span_hours * 4) * HOUR // 4, i, kind, digest))
    return rows


def _fold(rows, ttl=24 * HOUR, ceiling=168 * HOUR):
    held, out = {}, {}
    for event, url, at, seq, kind, digest in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        state = held.get(url)
        age = None if state is None else at - state[0]
        if age is not None and age < ttl:
            out[event] = ("hit", *state)
        elif kind == "not_modified" and state:
            held[url] = (at, state[1])
            out[event] = ("revalidated", *held[url])
        elif kind == "stored":
            held[url] = (at, digest)
            out[event] = ("fetched", *held[url])
        elif kind != "untrusted" and state and age <= ceiling:
            out[event] = ("stale", *state)
        else:
            out[event] = ("failure", None, None)
    return out


@pytest.mark.parametrize("row_limit", [20_000, 0])
def test_fold_by_both_paths_is_the_sequential_fold(table, row_limit):
    rows = _random_events(500, 700, 5)
    got = fr.fold_cache(table(rows, SCHEMA), row_limit=row_limit).collect()
    assert {r["event_id"]: (r["result"], r["served_at"], r["served_hash"]) for r in got} == _fold(rows)


def test_stream_out_of_order_is_the_batch(spark, table):
    rows = _random_events(200, 400, 9)
    got = replay(spark, table(rows, SCHEMA), lateness_hours=30.0).collect()
    assert len(got) == len(rows)
    assert {r["event_id"]: (r["result"], r["served_at"], r["served_hash"]) for r in got} == _fold(rows)


@pytest.mark.parametrize("ttl, ceiling", [(24, 168), (0, 10), (5, 5)])
def test_folding_in_pieces_is_the_sequential_fold(ttl, ceiling):
    for seed in range(20):
        rows = [(e, "u", at, s, k, d) for e, _, at, s, k, d in _random_events(60, 200, seed)]
        frame = pd.DataFrame([(r[2], r[3], r[0], r[4], r[5]) for r in rows], columns=["at", "seq", "event_id", "attempt", "hash"]).sort_values(["at", "seq"])
        held, out = None, {}
        cuts = sorted(random.Random(seed).sample(range(61), 3))
        for first, last in zip([0, *cuts], [*cuts, 60]):
            if last > first:
                found, held = fold_in_order(frame.iloc[first:last].reset_index(drop=True), held, ttl * HOUR, ceiling * HOUR)
                for r in found.itertuples():
                    out[r.event_id] = (r.result, None if pd.isna(r.served_at) else int(r.served_at), r.served_hash)
        assert out == _fold(rows, ttl * HOUR, ceiling * HOUR)


def test_stream_forgets_and_drops_what_is_too_late(spark, table, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    hours = {"ttl_hours": 24.0, "ceiling_hours": 48.0, "lateness_hours": 10.0, "forget_hours": 100.0}
    day = 24 * HOUR
    batches = [
        [(1, "a", 0, 1, "stored", "x"), (2, "b", 0, 2, "stored", "y"), (3, "t", 2 * day, 3, "tick", None)],
        # 4 is later than the watermark allows, 5 confirms after 60 hours, 6 keeps "a" alive.
        [(4, "a", HOUR, 4, "blocked", None), (5, "a", 60 * HOUR, 5, "not_modified", None), (6, "t", 5 * day, 6, "tick", None)],
        [(7, "b", 5 * day, 7, "not_modified", None), (8, "a", 5 * day, 8, "not_modified", None), (9, "t", 9 * day, 9, "tick", None)],
    ]
    batches = [[(e, u, at + 365 * day, *rest) for e, u, at, *rest in rows] for rows in batches]
    for rows in batches:
        table(rows, SCHEMA).write.mode("append").parquet(source)
        run_available(spark, source, target, state, **hours)
    results = spark.read.option("recursiveFileLookup", True).schema(OUTPUT).parquet(target)
    got = {r["event_id"]: (r["result"], r["served_hash"]) for r in results.collect()}
    assert got == {1: ("fetched", "x"), 2: ("fetched", "y"), 5: ("revalidated", "x"), 7: ("failure", None), 8: ("revalidated", "x")}
    asked = table([r for rows in batches for r in rows if r[4] != "tick"], SCHEMA)
    assert [r["event_id"] for r in unanswered(asked, results).collect()] == [4]
    with pytest.raises(ValueError):
        run_available(spark, source, target, state, ceiling_hours=9.0, forget_hours=8.0)


class _State:
    """A state variable in memory that counts the calls made."""

    calls = 0

    def __init__(self):
        self.values = []

    def __getattr__(self, name):
        type(self).calls += 1
        return {
            "exists": lambda: bool(self.values), "get": lambda: self.values[0] if self.single else iter(list(self.values)),
            "update": lambda v: self.__dict__.update(values=[v]), "put": lambda v: self.__dict__.update(values=list(v)),
            "appendValue": lambda v: self.values.append(v), "appendList": lambda v: self.values.extend(v), "clear": lambda: self.values.clear(),
        }[name]


class _Handle:
    def getValueState(self, *_):
        state = _State()
        state.single = True
        return state

    def getListState(self, *_):
        state = _State()
        state.single = False
        return state

    def registerTimer(self, at):
        _State.calls += 1


class _Clock:
    def __init__(self, hours):
        self.hours = hours

    def getCurrentWatermarkInMs(self):
        return int(self.hours * HOUR) // 1000


def test_state_is_read_and_written_by_buckets_of_urls():
    generator = random.Random(3)
    rows = [(e, f"u{generator.randrange(400)}", at, seq, kind, digest) for e, _, at, seq, kind, digest in _random_events(4_000, 400, 11)]
    frame = pd.DataFrame(rows, columns=["event_id", "url", "at", "seq", "attempt", "content_hash"])
    fold, got = CacheFold(24.0, 168.0, 1000.0), []
    fold.init(_Handle())
    _State.calls = 0
    for since, until in ((0, 100), (100, 250), (250, 401)):
        now = frame[(frame["at"] < until * HOUR) & (frame["at"] >= since * HOUR)]
        fold.handleInputRows((7,), iter([now.sample(frac=1, random_state=1)]), _Clock(until))
        got += list(fold.handleExpiredTimer((7,), _Clock(until - 10), None))
    got += list(fold.handleExpiredTimer((7,), _Clock(401), None))
    plain = lambda x, kind: None if pd.isna(x) else kind(x)
    assert {r.event_id: (r.result, plain(r.served_at, int), plain(r.served_hash, str)) for r in pd.concat(got).itertuples()} == _fold(rows)
    # A few calls each time, and not some for each of 400 URLs.
    assert _State.calls < 60


def test_changes_and_newest(table):
    rows = table([(0, "u", 0, 0, "stored", "a"), (1, "u", 30 * HOUR, 1, "stored", "a"), (2, "u", 60 * HOUR, 2, "stored", "b")], SCHEMA)
    moved = fr.refreshes(rows)
    assert [r["changed"] for r in fr.content_changes(moved).orderBy("at").collect()] == [False, False, True]
    assert tuple(fr.cache_table(moved).first()) == ("u", 60 * HOUR, "b")


def test_as_of_crosses_slices(table):
    entries = table([("k", 10, 1, "a"), ("k", 500, 2, "b")], "k string, at long, seq long, v string")
    probes = table([("k", 5, 0), ("k", 10, 1), ("k", 499, 9), ("k", 9_999, 0), ("z", 1, 0)], "k string, at long, seq long")
    got = {(r["k"], r["at"]): r["e"] and r["e"]["v"] for r in fr.as_of(probes, entries, ["k"], "at", "seq", "e").collect()}
    assert got == {("k", 5): None, ("k", 10): "a", ("k", 499): "a", ("k", 9_999): "b", ("z", 1): None}


def test_a_busy_key_is_spread_over_slices(spark, table):
    rng = random.Random(8)
    keys = ["hot"] * 6 + ["a", "b", "c", "d"]
    stored = [(rng.choice(keys), rng.randrange(2_000), i, f"v{i}") for i in range(400)]
    asked = [(rng.choice(keys + ["none"]), rng.randrange(2_000), i) for i in range(1_500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        entries, probes = table(stored, "k string, at long, id long, v string"), table(asked, "k string, at long, id long")
        got = fr.as_of(probes, entries, ["k"], "at", "id", "e").collect()
        slices = ranged(probes.withColumn("z", F.lit(1)), ["k"], [F.col("at"), F.col("id")])
        sizes = {r["_slice"]: r["count"] for r in slices.filter("k = 'hot'").groupBy("_slice").count().collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sizes) >= 4 and max(sizes.values()) < 400
    assert len(got) == len(asked)
    for r in got:
        best = max(((a, i, v) for k, a, i, v in stored if k == r["k"] and (a, i) <= (r["at"], r["id"])), default=None)
        assert (r["e"] and r["e"]["v"]) == (best and best[2])


def test_reuse_needs_a_stored_answer(table):
    stored = table([("k", 0, 1)], "k string, at long, id long")
    asked = table([("k", 100 * HOUR, 2), ("k", 504 * HOUR, 3), ("z", HOUR, 4)], "k string, at long, id long")
    got = {r["id"]: r["reused"] for r in fr.reuse(asked, stored, ["k"], "at", "id", 504.0).collect()}
    assert got == {2: True, 3: False, 4: False}


def test_ledger_keeps_an_older_status(table):
    rows = table(
        [("u", 1, 1, "blocked", "r1", 403), ("u", 2, 2, "unreachable", "r2", None), ("v", 1, 3, "ok", "", 200)],
        "url string, at long, seq long, outcome string, reason string, status int",
    )
    got = {r["url"]: (r["outcome"], r["status"]) for r in fr.ledger(rows).collect()}
    assert got == {"u": ("unreachable", 403), "v": ("ok", 200)}


def test_newest_stream(spark, table, tmp_path):
    schema = "k string, at long, v string"
    from provenir.sources.writers import read_newest

    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in ([("a", 1, "x"), ("b", 5, "y")], [("a", 2, "z"), ("b", 4, "old")]):
        table(rows, schema).write.mode("append").parquet(source)
        keep_newest(spark.readStream.schema(schema).parquet(source), target, state, ["k"], [F.col("at")])
    got = read_newest(spark, target, schema, ["k"], [F.col("at")])
    assert {r["k"]: r["v"] for r in got.collect()} == {"a": "z", "b": "y"}
