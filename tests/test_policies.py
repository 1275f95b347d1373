from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from provenir.operators import policies as pol

OURS = "User-agent: ExampleAgent\n"
CASES = [
    ("Disallow: /en/*/search.html", ["/en/anything/visa.html"], ["/en/anything/search.html", "/en/a/b/c/search.html"]),
    ("Disallow: /*/print$", ["/standard-visitor/printable-guide"], ["/standard-visitor/print"]),
    ("Disallow: /search/all*", [], ["/search/all?keywords=visa"]),
    ("Disallow: /forms/imm0143e.pdf", ["/forms/imm0143expdf"], ["/forms/imm0143e.pdf"]),
    ("Disallow: /guidance/\nAllow: /guidance/visas/", ["/guidance/visas/visitor.html"], ["/guidance/tax.html"]),
    ("Disallow: /visa\nAllow: /visa", ["/visa"], []),
    ("Disallow:", ["/", "/x"], []),
    ("Disallow: /admin\nUser-agent: Other\nDisallow: /", ["/visa"], ["/admin"]),
    ("Disallow: /x # note\nUser-agent: z\nUser-agent: exampleagent\nDisallow: /y", ["/z"], ["/x", "/y"]),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_rules(table, number):
    rules, allowed, refused = CASES[number]
    bodies = table([("https://h", 200, 10, OURS + rules)], "origin string, status int, bytes long, body string")
    rows = table([(f"https://h{p}",) for p in allowed + refused], "url string")
    got = {r["url"]: r["policy"] for r in pol.verdicts(rows, pol.policies(bodies, "ExampleAgent")).collect()}
    assert got == {f"https://h{p}": "allowed" for p in allowed} | {f"https://h{p}": "disallowed" for p in refused}


def test_agent_is_exact_and_star_is_the_fallback(table):
    body = "Disallow: /stray\nUser-agent: Example\nDisallow: /\nUser-agent: *\nAllow: /"
    bodies = table([("https://h", 200, 10, body)], "origin string, status int, bytes long, body string")
    rows = table([("https://h/visa",), ("https://h/stray",)], "url string")
    assert {r["policy"] for r in pol.verdicts(rows, pol.policies(bodies, "ExampleAgent")).collect()} == {"allowed"}


def test_statuses(table):
    body = "User-agent: *\nDisallow: /"
    bodies = table(
        [("https://a", 404, 1, body), ("https://b", 401, 1, body), ("https://c", 403, 1, body), ("https://d", 503, 1, body), ("https://e", 200, 512_001, body)],
        "origin string, status int, bytes long, body string",
    )
    rows = table([(f"https://{x}/p",) for x in "abcdef"], "url string")
    got = {r["url"][8]: (r["policy"], r["detail"]) for r in pol.verdicts(rows, pol.policies(bodies, "Any")).collect()}
    assert [got[x][0] for x in "abcdef"] == ["allowed"] * 3 + ["unreadable"] * 2 + ["allowed"]
    assert got["d"][1] == "answered HTTP 503"


def plain_verdict(rules, path):
    """The longest matching rule decides, an allowing one among equals."""
    found = []
    for allow, pattern in rules:
        anchored = pattern.endswith("$")
        regex = ".*".join(re.escape(p) for p in (pattern[:-1] if anchored else pattern).split("*")) + ("$" if anchored else "")
        if re.match(regex, path, re.S):
            found.append((-len(pattern), not allow))
    return "disallowed" if found and min(found)[1] else "allowed"


@pytest.mark.parametrize("hot", [100_000, 7])
def test_prefix_index_equals_plain_matching(table, hot):
    rng = random.Random(4)
    parts = ["a", "b", "ab", "é", "x.y", "*", "$", "(c)", "?q=1"]
    policies, rows = {}, []
    for origin in range(6):
        rules = [(rng.random() < 0.4, "/" + "/".join(rng.choices(parts, k=rng.randint(0, 3))) + rng.choice(["", "*", "$", "/"])) for _ in range(12)]
        policies[f"https://o{origin}"] = rules + [(False, "*.pdf$"), (rng.random() < 0.5, "/")][: origin % 3]
    for _ in range(600):
        # The first origin has most of the URLs.
        origin = "https://o0" if rng.random() < 0.6 else f"https://o{rng.randint(0, 7)}"
        path = "".join("/" + p for p in rng.choices(parts[:5] + ["z", "d.pdf"], k=rng.randint(0, 4)))
        rows.append((origin + path + rng.choice(["", "/", "?q=1"]),))
    bodies = table(
        [(o, 200, 10, "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}" for a, p in r)) for o, r in policies.items()],
        "origin string, status int, bytes long, body string",
    )
    frame = table(rows + [(None,)], "url string")
    out = pol.verdicts(frame, pol.policies(bodies, "Any"), hot=hot).collect()
    assert len(out) == len(rows) + 1
    seen = set()
    for r in out:
        split = re.match(r"(https://o\d)([^?]*)(\?.*)?$", r["url"] or "")
        if split is None:
            assert r["url"] is None and r["policy"] == "allowed"
            continue
        path = (split[2] or "/") + (split[3] or "")
        assert r["policy"] == plain_verdict(policies.get(split[1], []), path), r["url"]
        seen.add(r["policy"])
    assert seen == {"allowed", "disallowed"}


def test_urls_of_a_hot_origin_are_spread(spark, table):
    bodies = table([("https://h", 200, 10, "User-agent: *\nDisallow: /\nAllow: /p1")], "origin string, status int, bytes long, body string")
    rows = spark.range(4_000).selectExpr("concat('https://h/p', id) as url")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        out = pol.verdicts(rows, pol.policies(bodies, "Any"), hot=200)
        assert "rules" not in out.columns
        parts = out.select(F.spark_partition_id().alias("p"), "policy").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert len(parts) == 8 and max(r["count"] for r in parts) < 1_000


def test_only_paths_whose_origin_has_a_policy_are_asked(table, monkeypatch):
    asked, governing = [], pol.governing

    def watch(paths, *rest):
        asked.extend(r["origin"] for r in paths.collect())
        return governing(paths, *rest)

    monkeypatch.setattr(pol, "governing", watch)
    bodies = table([("https://a.gov", 200, 9, "User-agent: *\nDisallow: /private/")], "origin string, status int, bytes long, body string")
    rows = table([(u,) for u in ("https://a.gov/private/x", "https://a.gov/x", "https://a.gov/x", "https://b.gov/private/x", None)], "url string")
    got = sorted((r["url"] or "", r["policy"]) for r in pol.verdicts(rows, pol.policies(bodies, "A")).collect())
    assert got == [
        ("", "allowed"), ("https://a.gov/private/x", "disallowed"), ("https://a.gov/x", "allowed"), ("https://a.gov/x", "allowed"), ("https://b.gov/private/x", "allowed"),
    ]
    assert asked == ["https://a.gov", "https://a.gov"]
