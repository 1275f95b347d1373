from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from provenir.operators import lexicon as lx, roles as rl, scoring as sc
from provenir.params import ROLES, Lexicon

LEX = Lexicon(
    terms=[
        ("visa_decision", "visa requirement", 25.0), ("visa_decision", "entry visa", 15.0),
        ("document_checklist", "checklist", 25.0), ("application_route", "how to apply", 20.0), ("fees", "fee", 10.0),
        ("processing_times", "processing time", 12.0),
    ],
    purposes={"tourism": ["tourism", "tourist"], "study": ["student"]},
    off_scope=["student", "spouse"], hard_off_scope=["diplomatic passport", "spouse"], form=["application form"],
    language=["spanish"], index_stems=["index"], archive=["archive"], boilerplate=["privacy"],
    mission_markers=["consulado", "embaixada", "embassy"], document_nouns=["passport", "itinerary", "bank statement", "photograph"],
)
LINK = "id int, url string, text string, heading string, depth int, purpose string, nationality string, describes_nationality boolean, affinity string"


def score(table, *links):
    rows = table([(i, *link) for i, link in enumerate(links)], LINK)
    out = {}
    for r in sc.score_links(rows, ["id"], LEX).collect():
        out.setdefault(r["id"], {})[r["role"]] = (round(r["score"], 6), list(r["signals"]))
    return out


def test_link_scores_and_signals(table):
    got = score(
        table,
        ("https://g/a/b/c/d/visa-requirement", "Visa requirement", "Checklist", 1, "tourism", "IN", True, None),
        ("https://g/x/index.html", "Tourism", "", 0, "tourism", "IN", False, "own"),
        ("https://g/visa", "", "", 0, "study", "IN", False, None),
        ("https://g/plain", "nothing", "", 0, "tourism", "IN", False, None),
        ("https://g/checklist.pdf", "Student application form in Spanish", "", 2, "tourism", "IN", False, "other"),
    )
    first = got[0]
    assert first["visa_decision"][0] == 25 + 30 + 6 + 40 - 10
    assert first["visa_decision"][1] == [
        "url:visa requirement+25", "text:visa requirement+30", "mentions-visa+6", "nationality:IN+40", "depth1-10",
    ]
    assert first["document_checklist"] == (12.5 + 40 - 10, ["heading:checklist+12.5", "nationality:IN+40", "depth1-10"])
    assert got[1]["document_checklist"][0] == 18 + 20 - 18 + 8 + 30
    assert got[1]["application_route"][1] == ["purpose-label:tourism+18", "purpose:tourism+20", "section-index-18", "shallow+8", "mission+30"]
    assert got[2] == {"visa_decision": (14.0, ["mentions-visa+6", "shallow+8"])}
    assert 3 not in got
    pdf = got[4]["document_checklist"]
    assert pdf[0] == 25 - 30 - 35 - 25 + 8 - 20 - 45 + 10
    assert pdf[1][-2:] == ["other-mission-45", "pdf+10"]


BODY = "id int, url string, title string, content string, purpose string, nationality string, nationality_tokens array<string>"


def test_body_scores(table):
    rows = table(
        [
            (0, "https://g/a", "About", "visa requirement, entry visa. how to apply. fee. For a tourist.", "tourism", "IN", ["india", "indian"]),
            (1, "https://g/india", "About", "visa requirement how to apply fee processing time", "study", "IN", ["india"]),
            (2, "https://g/b", "Spouse", "passport, itinerary, bank statement", "study", "IN", ["india"]),
            (3, "https://g/c", "x", "nothing here", "study", "IN", ["india"]),
        ],
        BODY,
    )
    got = {}
    for r in sc.score_bodies(rows, ["id"], LEX).collect():
        got.setdefault(r["id"], {})[r["role"]] = (r["score"], list(r["signals"]))
    damp = math.sqrt(2 / 3)
    assert got[0]["visa_decision"][0] == pytest.approx((25 + 20) * damp)
    assert got[0]["visa_decision"][1][:2] == ["body:visa requirement+25", "(1 more phrasings, not added)"]
    assert got[0]["visa_decision"][1][-1] == "breadth:3x0.82"
    assert got[1]["fees"] == (50.0, ["body:fee+10", "body-nationality:IN+40"])
    assert got[2] == {"document_checklist": (27.0 - 30, ["names 3 documents (passport, itinerary, bank statement)+27", "title-off-scope:spouse-30"])}
    assert 3 not in got


def test_best_role(table):
    rows = table(
        [(0, "fees", 5.0), (0, "visa_decision", 5.0), (1, "fees", -3.0), (2, "fees", 9.0), (2, "general_entry", 1.0)],
        "id int, role string, score double",
    )
    lexicon = Lexicon(terms=[])
    got = {r["id"]: (r["role"], r["score"], r["runner_up"]) for r in sc.best_role(rows, ["id"], lexicon).collect()}
    assert got == {0: ("visa_decision", 5.0, 5.0), 1: ("irrelevant", 0.0, -3.0), 2: ("fees", 9.0, 1.0)}


def test_combined_score(table):
    link = table([("a", "fees", 10.0), ("b", "fees", 10.0)], "url string, role string, score double")
    body = table([("a", "fees", 20.0), ("a", "general_entry", 5.0)], "url string, role string, score double")
    read = table([("a",)], "url string")
    got = {(r["url"], r["role"]): r["score"] for r in sc.combine(link, body, ["url"], read, LEX).collect()}
    assert got == {("a", "fees"): 16.0, ("a", "general_entry"): 3.0, ("b", "fees"): 10.0}


COUNTRIES = [
    ("IN", "India", 1, ["republic of india"], ["indian"], ["in"], ["in", "delhi"]),
    ("US", "United States", 2, ["us", "usa"], ["american"], ["us"], ["us"]),
    ("GB", "United Kingdom", 3, ["uk"], ["british"], ["uk"], ["uk", "london", "edimburgo", "londres"]),
    ("CN", "China", 4, ["china"], ["chinese"], ["cn"], ["cn"]),
]
COUNTRY = "code string, name string, seq int, synonyms array<string>, demonyms array<string>, host_labels array<string>, mission_labels array<string>"


def test_country_mentions(table):
    rows = table(
        [
            (0, "Business for the United States", "https://x/a"), (1, "because of business", "https://x/a"),
            (2, "plain", "https://x/info-us"), (3, "plain", "https://in.x.org/a"), (4, "the United. States", "https://x/india"),
        ],
        "id int, text string, url string",
    )
    countries = table(COUNTRIES, COUNTRY)
    got = {(r["id"], r["code"]) for r in lx.country_mentions(rows, ["id"], countries).collect()}
    assert got == {(0, "US"), (2, "US"), (3, "IN"), (4, "IN")}
    described = {(r["id"], r["code"]) for r in lx.country_mentions(rows, ["id"], countries, by_host=False).collect()}
    assert described == {(0, "US"), (2, "US"), (4, "IN")}


def test_reject_cascade(table):
    links = [
        ("https://x/2019/list", "", ""), ("https://x/archive/a", "", ""), ("https://x/privacy", "", ""),
        ("https://x/a", "Spouse visa", ""), ("https://x/china", "China", ""), ("https://x/india", "India", ""), ("https://x/2025/a", "ok", ""),
    ]
    rows = table([(i, *link, "tourism", "IN", "GB") for i, link in enumerate(links)], "id int, url string, text string, heading string, purpose string, nationality string, applying_from string")
    got = lx.reject_links(rows, ["id"], LEX, table(COUNTRIES, COUNTRY), ["nationality", "applying_from"])
    assert [r["rejected"] for r in got.orderBy("id").collect()] == [
        "archived", "archived", "site furniture", "for another audience: spouse", "about another country: China", None, None,
    ]


def test_mission_affinity(table):
    cases = [
        ("https://www.gov.br/consulado-edimburgo/x", "own"), ("https://www.gov.br/consulado-londres", "own"), ("https://london.mfa.gov.sg/a", "own"),
        ("https://www.gov.br/embaixada-riade", "other"), ("https://www.gov.br/embaixada-kuala-lumpur", "other"), ("https://x/consulado_atlanta", "other"),
        ("https://x/embassy/index.html", None), ("https://x/ministry", None),
    ]
    rows = table([(u, ["uk", "London", "edimburgo", "londres"]) for u, _ in cases], "u string, labels array<string>")
    got = rows.select("u", lx.mission_affinity(F.col("u"), F.col("labels"), LEX.mission_markers).alias("a")).collect()
    assert {r["u"]: r["a"] for r in got} == dict(cases)


def test_country_lookup(table):
    rows = table([("gb",), ("united-kingdom",), (" United States ",), ("USA",), ("Atlantis",)], "asked string")
    got = {r["asked"]: r["code"] for r in lx.resolve_country(rows, table(COUNTRIES, COUNTRY)).collect()}
    assert got == {"gb": "GB", "united-kingdom": "GB", " United States ": "US", "USA": "US", "Atlantis": None}


def test_roles_from_scores_and_choices(table):
    scores = table(
        [("c", "u1", "visa_decision", 30.0, ["a", "b"]), ("c", "u2", "visa_decision", 30.0, ["z"]), ("c", "u1", "fees", 21.0, ["b", "c"]), ("c", "u3", "application_route", 19.0, [])],
        "k string, url string, role string, score double, signals array<string>",
    )
    won = rl.assign_roles(scores, ["k"], ROLES).collect()
    assert [(r["url"], r["roles"], r["score"], r["signals"]) for r in won] == [("u1", ["visa_decision", "fees"], 30.0, ["a", "b", "c"])]
    corridors = table([("c",), ("d",)], "k string")
    open_ = rl.unresolved_roles(corridors, rl.best_per_role(scores, ["k"]), ["k"]).collect()
    assert {(r["k"], r["role"]) for r in open_} == {("c", "document_checklist"), ("d", "visa_decision"), ("d", "document_checklist")}
    choices = table(
        [("c", 1, "fees", "s1", " why "), ("c", 2, "fees", "s2", "x"), ("c", 3, "nope", "s1", "x"), ("c", 4, "visa_decision", None, ""), ("c", 5, "general_entry", "s9", "x")],
        "k string, seq int, role string, source_id string, reason string",
    )
    known = table([("c", "s1", "https://x/202408/a"), ("c", "s2", "https://x/b")], "k string, source_id string, url string")
    kept, discarded = rl.validate_choices(choices, known, ["k"], ROLES)
    assert [(r["role"], r["source_id"], r["reason"]) for r in kept.collect()] == [("fees", "s1", "why")]
    assert {r["seq"]: r["cause"] for r in discarded.collect()} == {2: "answered more than once", 3: "unknown role", 5: "not a candidate"}
    named = rl.sources_from_choices(kept, known, ["k"], ROLES).first()
    assert named["signals"] == ["published in path: 2024-08", "why"]


def test_source_ids_are_numbered_in_arrival_order(table):
    rows = [
        (1, "https://www.a.org/visa/index.html"), (2, "https://www.a.org/x/index.htm"), (3, "https://www.a.org/y/index_2"),
        (4, "https://www.a.org/z/index"), (5, "https://www.a.org/"), (6, "https://www.a.org/docs/123.pdf"), (7, "https://www.a.org/2020"),
    ]
    df = table([("k", s, u) for s, u in rows], "k string, seq int, url string")
    got = rl.source_ids(df, ["k"], F.lit("testland-long"), "seq").orderBy("seq").collect()
    assert [r["source_id"] for r in got] == [
        "testland_www_index", "testland_www_index_2", "testland_www_index_2_2", "testland_www_index_3",
        "testland_www_index_4", "testland_www_docs", "testland_www_page",
    ]
