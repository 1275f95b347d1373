"""The mini site: two trusted hosts, one link off them, pages for other audiences and countries."""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from provenir.operators import expansion, policies as pol
from provenir.params import LIMITS, Lexicon
from provenir.plans.discover import resolve
from tests.test_scoring import COUNTRIES, COUNTRY, LEX

MINISTRY, MISSION = "https://immigration.gov.example", "https://uk.embassy.gov.example"
FILL = "This page explains the matter in plain sentences for every reader who needs it. " * 8


def page(title, links=(), body=""):
    anchors = "".join(f'<p><a href="{href}">{text}</a></p>' for href, text in links)
    return f"<html><head><title>{title}</title></head><body><h1>{title}</h1>{anchors}<p>{FILL}{body}</p></body></html>"


SITE = {
    f"{MINISTRY}/visa/index.html": page("Visa", [
        ("/visa/short/novisa.html", "Visa Exemption Countries and Regions"), ("/visa/detail", "Check the visa requirement"),
        (f"{MISSION}/visa/index.html", "Embassy in the United Kingdom"), ("https://cheap-visas.example/apply-now", "Apply now with our partner visa"),
    ]),
    f"{MINISTRY}/visa/detail": page("By nationality", [
        ("/visa/detail/india.html", "India visa"), ("/visa/detail/china.html", "China visa"), ("/visa/2019/tourist-checklist.html", "2019 tourist checklist"),
    ]),
    f"{MINISTRY}/visa/detail/india.html": page("India", body="Visa requirement for Indian citizens. Tourist entry."),
    f"{MISSION}/visa/index.html": page("Visa", [("/visa/index_000070.html", "Temporary Visitor Visa"), ("/visa/spouse.html", "Spouse visa")]),
    f"{MISSION}/visa/index_000070.html": page("Temporary visitors", [("/visa/sightseeing.html", "Tourism")], "How to apply."),
    f"{MISSION}/visa/sightseeing.html": page("Sightseeing checklist", body="For tourism bring a passport, an itinerary and a bank statement."),
    f"{MINISTRY}/visa/portal": '<html><body><div id="app"></div><script>run()</script></body></html>',
}


@pytest.fixture(scope="module")
def resolved(table):
    corridors = table(
        [("testland/IN/GB/tourism", "testland", "Testland", "IN", "GB", "TL", "tourism"), ("empty/IN/GB/tourism", "empty", "Empty", "IN", "GB", "EM", "tourism")],
        "corridor_key string, slug string, display_name string, nationality string, applying_from string, destination_code string, purpose string",
    )
    key = "testland/IN/GB/tourism"
    domains = table([(key, "immigration.gov.example"), (key, "embassy.gov.example")], "corridor_key string, domain string")
    hits = table(
        [(key, 0, 0, f"{MINISTRY}/visa/index.html?utm_source=s", "Visa"), (key, 0, 1, "https://agency.example/x", "Agency visa"), (key, 1, 0, f"{MINISTRY}/visa/portal", "Visa portal"),
         (key, 2, 0, f"{MISSION}/visa/index.html", "Visa")],
        "corridor_key string, query_seq int, rank int, url string, title string",
    )
    pages = table(list(SITE.items()), "url string, html string")
    ledger = table([("https://x/none", "blocked", 403)], "url string, outcome string, status int")
    dead = table([("dead.example",)], "host string")
    countries = table(COUNTRIES, COUNTRY)
    configured = table([("testland", 1, "immigration.gov.example", "Ministry", "foreign_ministry")], "slug string, seq int, host string, authority string, kind string")
    lexicon = dataclasses.replace(LEX, terms=[*LEX.terms, ("application_route", "temporary visitor", 15.0)])
    limits = dataclasses.replace(LIMITS, role_score=15.0, readable_text=200)
    return resolve(corridors, domains, hits, pages, ledger, dead, countries, configured, lexicon, limits)


def test_pages_fill_their_roles(resolved):
    rows = {role: r["url"] for r in resolved.sources.collect() for role in r["roles"]}
    assert rows["visa_decision"] == f"{MINISTRY}/visa/detail/india.html"
    assert rows["document_checklist"] == f"{MISSION}/visa/sightseeing.html"
    assert {r["authority"] for r in resolved.sources.collect()} <= {"Ministry", "Testland mission (uk.embassy.gov.example)"}


def test_the_crawl_stays_on_trusted_pages(resolved):
    visited = {r["url"] for r in resolved.visited.collect()}
    seen = {r["url"] for r in resolved.considered.collect()}
    assert f"{MINISTRY}/visa/detail/india.html" in visited
    assert not any("cheap-visas" in u or "agency" in u or "china" in u or "2019" in u or "spouse" in u for u in visited | seen)


def test_refused_corridor_keeps_a_row(resolved):
    rows = {r["corridor_key"]: r for r in resolved.corridors.collect()}
    assert rows["testland/IN/GB/tourism"]["usable"] and not rows["empty/IN/GB/tourism"]["usable"]
    assert set(rows["empty/IN/GB/tourism"]["unresolved"]) == {"visa_decision", "document_checklist"}


def test_forward_chain(table):
    pages = table([(f"https://a.gov/{x}",) for x in "pqrstv"], "url string")
    forwards = table(
        [("https://a.gov/p", "https://a.gov/q"), ("https://a.gov/q", "https://a.gov/doc.pdf"), ("https://a.gov/r", "https://evil.org/x"),
         ("https://a.gov/s", "https://a.gov/private/x"), ("https://a.gov/t", "https://a.gov/p")],
        "url string, target string",
    )
    trusted = table([("a.gov",)], "domain string")
    bodies = table([("https://a.gov", 200, 9, "User-agent: *\nDisallow: /private/")], "origin string, status int, bytes long, body string")
    rows = expansion.follow_forwards(pages, forwards, trusted, pol.policies(bodies, "A"))
    got = {r["url"][-1]: (r["final_url"].split("gov/")[-1], r["hops"], r["outcome"]) for r in rows.collect()}
    assert got == {
        "p": ("doc.pdf", 2, "ok"), "q": ("doc.pdf", 1, "ok"), "r": ("r", 0, "untrusted"), "s": ("s", 0, "disallowed"),
        "t": ("q", 2, "unusable"), "v": ("v", 0, "ok"),
    }
    landed = expansion.check_landings(
        table([("https://a.gov/1", "https://a.gov/1"), ("https://a.gov/2", "https://a.gov/private/z"), ("https://a.gov/3", "https://b.org/")], "url string, final_url string"),
        trusted, pol.policies(bodies, "A"),
    )
    assert {r["url"][-1]: r["landing"] for r in landed.collect()} == {"1": "ok", "2": "disallowed", "3": "untrusted"}


def test_expansion_respects_budgets_and_levels(table):
    links = table(
        [("c", "s", "a", "h", 20.0, 1), ("c", "s", "b", "h", 30.0, 2), ("c", "s", "low", "h", 5.0, 3), ("c", "b", "a", "h", 40.0, 4), ("c", "b", "d", "h", 15.0, 5), ("c", "d", "e", "h", 99.0, 6), ("c", "s", "doc.pdf", "h", 50.0, 7)],
        "k string, src string, url string, host string, score double, seq long",
    )
    seeds = table([("c", "s", "h")], "k string, url string, host string")
    visited, candidates = expansion.expand_links(seeds, links, ["k"], is_document=F.col("url").endswith(".pdf"))
    assert {r["url"]: r["depth"] for r in visited.collect()} == {"s": 0, "a": 1, "b": 1, "d": 2}
    best = {r["url"]: r["score"] for r in candidates.collect()}
    assert best == {"a": 40.0, "b": 30.0, "low": 5.0, "d": 15.0, "doc.pdf": 50.0}
    few, _ = expansion.expand_links(seeds, links, ["k"], pages=2)
    assert {r["url"] for r in few.collect()} == {"s", "doc.pdf"}
    tight, _ = expansion.expand_links(seeds, links, ["k"], per_host=3, is_document=F.col("url").endswith(".pdf"))
    assert {r["url"] for r in tight.collect()} == {"s", "a", "b"}


def test_what_was_not_followed_has_a_reason(table):
    links = table(
        [("s", "a", "h", 1, 40.0), ("s", "b", "h", 2, 30.0), ("s", "c", "h", 3, 20.0), ("s", "low", "h", 4, 5.0), ("s", "doc.pdf", "h", 5, 50.0),
         ("s", "e", "g", 6, 35.0), ("a", "f", "g", 7, 15.0)],
        "src string, url string, host string, seq int, score double",
    )
    seeds = table([("c", "s", "h")], "k string, url string, host string")
    options = {"is_document": F.col("url").endswith(".pdf")}
    reasons = lambda found: {r["url"]: r["reason"] for r in found.left_out.collect()}
    found = expansion.expand(seeds, links, ["k"], per_host=3, **options)
    assert reasons(found) == {"doc.pdf": "document", "low": "score", "c": "host budget", "f": "depth"}
    few = expansion.expand(seeds, links, ["k"], pages=3, depth=1, **options)
    assert {r["url"] for r in few.visited.collect()} == {"s", "a", "e"}
    assert reasons(few) == {"doc.pdf": "document", "low": "score", "b": "page budget", "c": "page budget", "a": "depth", "e": "depth"}
    none = expansion.expand(seeds, links.limit(0), ["k"], depth=0)
    assert reasons(none) == {"s": "depth"}


def test_forwards_in_circles_and_duplicates(table):
    pages = table([(i, u) for i, u in enumerate(["https://a.net/1", "https://a.net/2", "https://a.net/3", "https://a.net/1", "https://a.net/9"])], "id int, url string")
    forwards = table([("https://a.net/1", "https://a.net/2"), ("https://a.net/2", "https://a.net/1"), ("https://a.net/3", "https://b.org/")], "url string, target string")
    policies = table([], "origin string, state string, detail string, rules array<struct<precedence:int,allow:boolean,pattern:string,regex:string>>")
    got = expansion.follow_forwards(pages, forwards, table([("a.net",)], "domain string"), policies)
    rows = {r["id"]: (r["final_url"][-1], r["hops"], r["outcome"]) for r in got.collect()}
    assert rows == {0: ("1", 2, "unusable"), 3: ("1", 2, "unusable"), 1: ("2", 2, "unusable"), 2: ("3", 0, "untrusted"), 4: ("9", 0, "ok")}
