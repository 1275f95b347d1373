from __future__ import annotations

import copy
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenir import schemas
from provenir.operators import checks as ck
from provenir.operators import large_groups
from provenir.plans.grade import check_plans, grade

WHEN = datetime(2026, 8, 13, 9)


def source(name, stale=False):
    return {"source_id": name, "title": name, "url": f"https://x/{name}", "authority": "A", "retrieved_at": WHEN, "supporting_excerpt": "", "is_stale": stale}


def step(**changes):
    return {"title": "Apply", "action": "Send the form", "timing": "Early", "source_ids": ["s1"], "link_target": "none", "link_source_id": None} | changes


FAILURE = {"source_id": "f", "title": "F", "authority": "A", "outcome": "unreachable", "detail": "d", "attempted_url": "u", "final_url": None}
CLEAN = {
    "plan_id": "clean", "destination": "Land", "visa_required": True, "visa_type": None, "explanation": "e",
    "decision_source_ids": ["s1"], "application_document_source_ids": ["s2"],
    "where_to_apply": {"authority": "A", "application_method": "m", "location": None, "application_url": "u", "source_ids": ["s1"]},
    "requirements": [{"name": "n", "description": "d", "reason_it_applies": "r", "source_ids": ["s2"]}],
    "application_steps": [step(), step(link_target="source", link_source_id="s1"), step(link_target="application_route"), step()],
    "sources": [source("s1"), source("s2")], "unresolved_questions": [], "last_checked": WHEN, "status": "verified",
    "unavailable_sources": [],
}


def defect(name, **changes):
    return copy.deepcopy(CLEAN) | {"plan_id": name} | changes


def test_one_defect_per_plan(table):
    plans = {
        "clean": None,
        "unknown": "unknown_citation", "twice": "duplicate_source", "stale": "verified_with_stale", "failed": "verified_with_failure",
        "bare": "requirements_without_checklist", "silent": "no_checklist_no_question", "few": "step_count",
        "uncited": "link_not_cited", "nowhere": "route_link_without_location", "stray": "stray_link_id",
        "noid": "source_link_without_id", "long": "title_length",
    }
    steps = CLEAN["application_steps"]
    rows = [
        CLEAN,
        defect("unknown", decision_source_ids=["nope"]),
        defect("twice", sources=[source("s1"), source("s2"), source("s2")]),
        defect("stale", sources=[source("s1"), source("s2", True)]),
        defect("failed", unavailable_sources=[FAILURE]),
        defect("bare", application_document_source_ids=[], unresolved_questions=["q"]),
        defect("silent", application_document_source_ids=[], requirements=[]),
        defect("few", application_steps=steps[:3]),
        defect("uncited", application_steps=[step(link_target="source", link_source_id="s2"), *steps[1:]]),
        defect("nowhere", where_to_apply=None),
        defect("stray", application_steps=[step(link_source_id="s1"), *steps[1:]]),
        defect("noid", application_steps=[step(link_target="source"), *steps[1:]]),
        defect("long", application_steps=[step(title="x" * 71), *steps[1:]]),
    ]
    names = StructType.fromDDL(schemas.PLANS).fieldNames()
    df = table([tuple(r[n] for n in names) for r in rows], schemas.PLANS)
    got = {(r["entity_id"], r["rule"]) for r in check_plans(df).collect()}
    assert got == {(name, rule) for name, rule in plans.items() if rule}


def test_field_rules(table):
    rows = table([("ok", "GB"), ("bad", "gb"), ("none", None)], "id string, code string")
    found = ck.check_fields(rows, "id", [("iso_code", F.col("code").rlike("^[A-Z]{2}$"))])
    assert {r["entity_id"] for r in found.collect()} == {"bad", "none"}


def test_usability(table):
    rows = table(
        [("full", ["visa_decision"], 1, 0), ("blocked", ["fees"], 1, 2), ("nothing", [], 0, 2), ("open", ["fees"], 1, 0)],
        "id string, filled array<string>, sources int, blocking_urls int",
    )
    got = {r["id"]: (r["usable"], r["decision_is_unverified"]) for r in ck.corridor_usability(rows, ["visa_decision"]).collect()}
    assert got == {"full": (True, False), "blocked": (True, True), "nothing": (False, True), "open": (False, False)}


def test_grade_from_observations(table):
    hour = 3_600_000_000
    observed = table(
        [("u1", 0, 1, "stored", "a"), ("u2", 0, 2, "unreachable", None), ("u1", 30 * hour, 3, "unreachable", None)],
        "url string, at long, seq long, attempt string, content_hash string",
    )
    wanted = table([("p", "s1", "u1", 1), ("q", "s1", "u1", 1), ("q", "s2", "u2", 2), ("r", "s1", "u1", 3)], "plan_id string, source_id string, url string, seq long")
    plans = table([("p", True, False), ("q", True, False), ("r", True, False), ("n", False, False)], "plan_id string, has_checklist boolean, decision_is_unverified boolean")
    graded, fetched, failures = grade(observed, wanted, plans)
    assert {r["plan_id"]: r["graded"] for r in graded.collect()} == {"p": "verified", "q": "partial", "r": "partial", "n": "partial"}
    assert fetched.count() == 3 and [r["source_id"] for r in failures.collect()] == ["s2"]


def test_missing_sources_say_why(table):
    required = table([("p", "s1", 1), ("p", "s2", 2), ("p", "s3", 3)], "plan_id string, source_id string, seq int")
    fetched = table([("p", "s3")], "plan_id string, source_id string")
    failures = table([("p", "s1", "T", "A", "it failed")], "plan_id string, source_id string, title string, authority string, detail string")
    rows = ck.missing_sources(required, fetched, failures, ["plan_id"]).orderBy("seq").collect()
    assert [r["reason"] for r in rows] == ["T (A) could not be used: it failed", "The required source s2 was not retrieved."]


def test_tables_of_many_rows_are_dealt_over_as_many_tasks_as_they_need(spark, table, monkeypatch):
    monkeypatch.setattr(large_groups, "IN_TASK", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cited = table([(p, p % 7 + d) for p in range(60) for d in (0, 0, 1)], "plan_id long, source_id long")
        sources = table([(p, p % 7) for p in range(60)], "plan_id long, source_id long")
        few, many = ck.check_citations(cited, sources), ck.check_citations(cited, sources, rows=180)
        assert sorted(many.collect()) == sorted(few.collect()) and many.count() == 60
        # A task holds ten rows, whatever the number of shuffle partitions.
        assert [many.rdd.getNumPartitions(), large_groups.dealt(cited, 180, "plan_id").rdd.getNumPartitions()] == [36, 18]
        assert large_groups.dealt(cited, 80, "plan_id") is cited
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_folded_corridors_of_many_sources_are_dealt(table, monkeypatch):
    from provenir.plans.fold import check_folded, fold_corridors

    sources = table(
        [(f"s{i % 3}", f"p{i}", f"https://www.n{i % 4}.gov/{i}", ["document_checklist"] if i % 2 else ["visa_decision", "fees"]) for i in range(120)],
        "slug string, source_id string, url string, roles array<string>",
    )
    destinations = table([(f"s{i}", f"Land {i}", i == 0) for i in range(3)], "slug string, display_name string, decision_is_unverified boolean")
    providers = table([("s0", "agent.com", "p3"), ("s1", "agent.org", "gone")], "slug string, domain string, appointed_by string")
    refused = table([("s1", "https://n1.gov/x")], "slug string, url string")
    domains = table([(f"s{i}", f"n{j}.gov") for i in range(3) for j in range(3)], "slug string, domain string")

    def run():
        folded = fold_corridors(sources, destinations, providers, refused)
        return folded, [sorted(x.collect()) for x in (folded["required"], folded["providers"], check_folded(folded, domains))]

    few = run()[1]
    monkeypatch.setattr(large_groups, "IN_TASK", 10)
    folded, many = run()
    assert many == few and [len(x) for x in many] == [120, 1, 31]
    assert folded["checklist"].rdd.getNumPartitions() == 12
