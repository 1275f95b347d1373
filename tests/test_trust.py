from __future__ import annotations

from pyspark.sql import functions as F

from provenir.functions import hosts
from provenir.operators import trust
from provenir.plans.registry import build_registry

HITS = "code string, query string, query_seq int, rank int, url string, title string"


def hits_of(table, code, found):
    rows = []
    for seq, (query, entries) in enumerate(found.items()):
        rows += [(code, query, seq, rank, url, f"T{seq}{rank}") for rank, url in enumerate(entries)]
    return table(rows, HITS)


def propose(table, found, tlds=(), denied=("ivisa.com",)):
    deny = table([(d, "commercial") for d in denied], "domain string, category string")
    rows = trust.propose_domains(hits_of(table, "XX", found), deny, list(tlds))
    return {r["domain"]: r for r in rows.collect()}


def test_dot_boundary(table):
    rows = table([(h,) for h in ["mfa.gov.sg", "london.mfa.gov.sg", "notmfa.gov.sg", "mfa.gov.sg.evil.example", ""]], "host string")
    domains = table([(".MFA.gov.sg.",)], "domain string")
    inside = {r["host"] for r in trust.within(rows, "host", domains).collect()}
    assert inside == {"mfa.gov.sg", "london.mfa.gov.sg"}
    outside = {r["host"] for r in trust.not_within(rows, "host", domains).collect()}
    assert outside == {"notmfa.gov.sg", "mfa.gov.sg.evil.example", ""}
    flags = {r["host"]: r["ok"] for r in trust.flag_within(rows, "host", domains, "ok").collect()}
    assert flags == {h: h in inside for h in inside | outside}


def test_one_query_is_not_enough(table):
    got = propose(table, {"q1": ["https://mofa.go.jp/a"], "q2": ["https://other.go.jp/a"]})
    assert all("by 1 queries" in r["rejected"] for r in got.values()) and len(got) == 2


def test_corroborated(table):
    got = propose(table, {"q1": ["https://www.mofa.go.jp/1"], "q2": ["https://www.mofa.go.jp/2", "https://www.mofa.go.jp/3", "https://www.mofa.go.jp/4"]})
    row = got["mofa.go.jp"]
    assert (row["governmental"], row["kind"], row["corroboration"], row["rejected"]) == (True, "foreign_ministry", 2, None)
    assert row["urls"] == ["https://www.mofa.go.jp/1", "https://www.mofa.go.jp/2", "https://www.mofa.go.jp/3"]
    assert row["titles"] == ["T00", "T10", "T11"]


def test_denied_and_suffix(table):
    got = propose(table, {"q1": ["https://www.ivisa.com/x", "https://gov.sg"], "q2": ["https://ivisa.com/y", "https://gov.sg/y"]})
    assert "no authority" in got["ivisa.com"]["rejected"] and "suffix of many" in got["gov.sg"]["rejected"]


def test_own_government_needs_one_query_when_independent(table):
    assert propose(table, {"q1": ["https://mofa.gov.vn"]}, ["vn"])["mofa.gov.vn"]["rejected"] is None
    assert "where 2" in propose(table, {"q1": ["https://interior.gov"]}, ["wl", "gov"])["interior.gov"]["rejected"]
    row = propose(table, {"q1": ["https://immigration.go.wl"]}, ["wl", "gov"])["immigration.go.wl"]
    assert row["rejected"] is None and row["matched"] == ["wl"] and row["independent"]


def test_foreign_government_is_not_first(table):
    found = {q: ["https://usembassy.gov/v", "https://immigration.gov.vn/v"] for q in ("q1", "q2")}
    deny = table([("a.b", "x")], "domain string, category string")
    rows = trust.propose_domains(hits_of(table, "VN", found), deny, ["vn"])
    assert [r["domain"] for r in rows.orderBy(*trust.proposal_order()).collect()][0] == "immigration.gov.vn"


def test_cap_keeps_the_best(table):
    counts = {"a.gov.wl": 4, "b.gov.wl": 4, "c.gov.wl": 3, "d.gov.wl": 2, "e.gov.wl": 1, "f.gov.wl": 1, "g.gov.wl": 1, "wlembassy.gov.wl": 1}
    found = {f"q{i}": [f"https://{d}/" for d, n in counts.items() if n > i] for i in range(4)}
    deny = table([("a.b", "x")], "domain string, category string")
    split = trust.split_trust(trust.propose_domains(hits_of(table, "WL", found), deny, ["wl"]))
    rows = {r["domain"]: r for r in split.collect()}
    accepted = sorted((r["place"], d) for d, r in rows.items() if r["accepted"])
    assert [d for _, d in accepted] == ["wlembassy.gov.wl", "a.gov.wl", "b.gov.wl", "c.gov.wl", "d.gov.wl"]
    assert all("own government" in rows[d]["withheld"] for d in ("e.gov.wl", "f.gov.wl", "g.gov.wl"))


def test_registry_build_merges(table):
    found = {"q1": ["https://mofa.gov.vn", "https://evisa.com.vn"], "q2": ["https://evisa.com.vn/2"]}
    schema = "code string, name string, trusted array<string>, reviewed array<struct<domain:string,evidence:string>>, unconfirmable array<string>"
    old = table([("JP", "Japan", ["mofa.go.jp"], [], [])], schema)
    countries = table([("VN", "Vietnam", ["vn"]), ("JP", "Japan", ["jp"]), ("ZZ", "Zed", ["zz"])], "code string, name string, tlds array<string>")
    reviewed = table([("VN", "immi.vn", "cited", 1)], "code string, domain string, evidence string, seq int")
    deny = table([("a.b", "x")], "domain string, category string")
    failed = table([("ZZ",)], "code string")
    rows, split = build_registry(hits_of(table, "VN", found), countries, old, reviewed, deny, failed)
    got = {r["code"]: r for r in rows.withColumn("domains", trust.effective_domains()).collect()}
    assert set(got) == {"JP", "VN"}
    assert got["VN"]["domains"] == ["immi.vn", "mofa.gov.vn"]
    assert got["VN"]["unconfirmable"] == ["evisa.com.vn"]
    asked = table([("VN",), ("QQ",)], "code string")
    answers = {r["code"]: r["refused"] for r in trust.destination_domains(asked, rows).collect()}
    assert answers["VN"] is None and "not in the registry" in answers["QQ"]


def test_trust_rule_gap(table):
    # One real authority per country; the marker half fails for those that use no marker.
    sites = {
        "AT": "bmeia.gv.at", "DE": "auswaertiges-amt.de", "IT": "esteri.it", "NL": "ind.nl", "SE": "migrationsverket.se",
        "FR": "france-visas.gouv.fr", "JP": "mofa.go.jp", "SG": "ica.gov.sg", "CH": "sem.admin.ch", "NZ": "immigration.govt.nz",
    }
    df = table(list(sites.items()), "code string, domain string")
    failing = {r["code"] for r in df.filter(~hosts.looks_governmental(F.col("domain"))).collect()}
    assert failing == {"AT", "DE", "IT", "NL", "SE"}


def test_authority_names(table):
    pages = table(
        [("x", "a.gov.x", "Xland"), ("x", "sub.a.gov.x", "Xland"), ("x", "emb.x", "Xland"), ("x", "immi.x", "Xland"), ("x", "plain.x", "Xland")],
        "slug string, host string, display_name string",
    )
    sources = table([("x", 1, "a.gov.x", "Ministry A", "foreign_ministry")], "slug string, seq int, host string, authority string, kind string")
    got = {r["host"]: (r["authority"], r["kind"]) for r in trust.name_authority(pages, sources).collect()}
    assert got["a.gov.x"] == got["sub.a.gov.x"] == ("Ministry A", "foreign_ministry")
    assert got["emb.x"] == ("Xland mission (emb.x)", "embassy_or_high_commission")
    assert got["immi.x"] == ("Xland immigration authority", "immigration_authority")
    assert got["plain.x"] == ("Xland authority (plain.x)", "foreign_ministry")


def test_mission_hosts(table):
    sources = table([("jp", "www.uk.emb-japan.go.jp"), ("jp", "mofa.go.jp")], "slug string, host string")
    labels = table([("GB", ["UK", "gb"])], "code string, host_labels array<string>")
    assert [tuple(r) for r in trust.mission_hosts(sources, labels).collect()] == [("jp", "GB", "uk.emb-japan.go.jp")]
