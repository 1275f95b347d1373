from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from provenir.operators import audit, ranking as rk
from provenir.operators.large_groups import number_rows

CANDIDATE = "corridor string, url string, best double"
SCORE = "corridor string, url string, role string, score double"


def shortlist(table, pages, size=10, floor=1):
    candidates = table([("c", u, s) for u, s in pages], CANDIDATE)
    scores = table([("c", u, "fees", s) for u, s in pages], SCORE)
    rows = rk.shortlist(candidates, scores, ["corridor"], size, 3, floor, 6).orderBy("place").collect()
    return [r["url"] for r in rows]


def test_shortlist_fills_the_budget(table):
    pages = [(f"https://a.gov.example/{i:02d}", 50.0 - i) for i in range(12)]
    assert shortlist(table, pages) == [u for u, _ in pages[:10]]


def test_shortlist_reserves_a_place_per_domain(table):
    pages = [(f"https://interior.gov.example/{i:02d}", 50.0 - i) for i in range(12)]
    pages.append(("https://in.mission.org/quiet", 5.0))
    got = shortlist(table, pages)
    assert len(got) == 10 and got[-1] == "https://in.mission.org/quiet"


def test_no_role_is_never_admitted(table):
    assert shortlist(table, [("https://a.org/1", 9.0), ("https://b.org/2", 0.0)]) == ["https://a.org/1"]


def test_readable_only(table):
    rows = table([("c", "https://a.org/1", 1.0), ("c", "https://dead.org/1", 1.0), ("c", "https://b.org/2", 1.0)], CANDIDATE)
    blocked = table([("https://b.org/2",)], "url string")
    dead = table([("dead.org",)], "host string")
    assert [r["url"] for r in rk.readable_only(rows, blocked, dead).collect()] == ["https://a.org/1"]


def test_host_budget(table):
    one = table([("c", "a")], "by string, host string")
    many = table([("c", h) for h in "abcd"], "by string, host string")
    crowd = table([("c", str(i)) for i in range(30)], "by string, host string")
    assert [rk.host_budget(x, ["by"]).first()["budget"] for x in (one, many, crowd)] == [20, 10, 4]


def test_crawl_needs_a_strictly_better_score(table):
    schema = "by string, url string, best double, seq long"
    found = table([("c", "u1", 5.0, 1), ("c", "u2", 5.0, 2)], schema)
    crawled = table([("c", "u1", 5.0, 3), ("c", "u2", 6.0, 9), ("c", "u2", 6.0, 4), ("c", "u3", 1.0, 5)], schema)
    got = {r["url"]: (r["found_by"], r["seq"]) for r in rk.merge_candidates(found, crawled, ["by"]).collect()}
    assert got == {"u1": ("search", 1), "u2": ("crawl", 4), "u3": ("crawl", 5)}


def test_large_groups_number_like_a_plain_window(spark):
    rows = [("hot" if random.Random(i).random() < 0.6 else f"g{i % 5}", (i * 7919) % 1000, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    order = [F.col("v"), F.col("id")]
    window = Window.partitionBy("g").orderBy(*order)
    plain = {(r["id"], r["n"]) for r in df.withColumn("n", F.row_number().over(window)).collect()}
    assert {(r["id"], r["n"]) for r in number_rows(df, ["g"], order, "n").collect()} == plain


def test_audit(table):
    candidates = table([("c", "https://x/a", 3.0), ("c", "https://x/b", 2.0), ("c", "https://x/c", 1.0)], CANDIDATE)
    short = table([("c", "https://x/a"), ("c", "https://x/b")], "corridor string, url string")
    read = table([("c", "https://x/a")], "corridor string, url string")
    rows = audit.considered(candidates, short, read, ["corridor"])
    assert [r["position"] for r in rows.orderBy("position").collect()] == [1, 2, 3]
    asks = table([("c", f) for f in ("/a", "/b", "/c", "/d")], "corridor string, fragment string")
    got = {r["fragment"]: r["verdict"] for r in audit.classify_misses(asks, rows, ["corridor"]).collect()}
    assert got == {"/a": "fetched", "/b": "shortlisted, not read", "/c": "ranked out", "/d": "never seen"}


def test_misses_by_index_are_those_by_scanning(table):
    rng = random.Random(2)
    url = lambda: "https://" + "".join(rng.choices("abé/.-", k=rng.randint(0, 12)))
    records = [(rng.choice("kj"), url(), rng.random() < 0.3, rng.random() < 0.1) for _ in range(300)] + [("k", None, True, True)]
    asks = [(rng.choice("kjz"), "".join(rng.choices("abé/.", k=rng.randint(0, 6)))) for _ in range(80)] + [("k", None), ("k", "ab"), ("k", "ab")]
    got = audit.classify_misses(table(asks, "k string, fragment string"), table(records, "k string, url string, shortlisted boolean, fetched boolean"), ["k"])
    want = []
    for k, fragment in asks:
        stages = [3 if f else 2 if s else 1 for kk, u, s, f in records if kk == k and u is not None and fragment is not None and fragment in u]
        want.append((k, fragment, ["never seen", "ranked out", "shortlisted, not read", "fetched"][max(stages, default=0)], len(stages)))
    assert sorted(map(str, want)) == sorted(str((r["k"], r["fragment"], r["verdict"], r["matches"])) for r in got.collect())
