"""Fetch observations, destinations and drafted plans → graded plans and their violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.operators import checks as ck
from provenir.operators import freshness as fr
from provenir.session import cut_lineage


def explode_plans(plans: DataFrame) -> dict[str, DataFrame]:
    """Nested plan rows as the long tables the checks read."""
    cited = F.flatten(
        F.array(
            F.col("decision_source_ids"),
            F.col("application_document_source_ids"),
            F.coalesce("where_to_apply.source_ids", F.array().cast("array<string>")),
            F.flatten(F.transform("requirements", lambda r: r["source_ids"])),
            F.flatten(F.transform("application_steps", lambda s: s["source_ids"])),
        )
    )
    steps = plans.select("plan_id", F.posexplode("application_steps").alias("step_no", "s")).select(
        "plan_id", "step_no", "s.*"
    )
    return {
        "plans": plans.select(
            "plan_id",
            "status",
            (F.size("application_document_source_ids") > 0).alias("has_checklist"),
            F.col("where_to_apply").isNotNull().alias("has_location"),
        ),
        "sources": plans.select("plan_id", F.inline("sources")),
        "failures": plans.select("plan_id", F.inline("unavailable_sources")),
        "requirements": plans.select("plan_id", F.inline("requirements")),
        "questions": plans.select("plan_id", F.explode("unresolved_questions").alias("question")),
        "citations": plans.select("plan_id", F.explode(cited).alias("source_id")),
        "steps": steps.drop("source_ids"),
        "step_citations": steps.select("plan_id", "step_no", F.explode("source_ids").alias("source_id")).distinct(),
    }


def check_plans(plans: DataFrame) -> DataFrame:
    """Every violation of nested plan rows."""
    t = explode_plans(plans)
    return ck.together(
        [
            ck.duplicates(t["plans"], [], "plan_id", "duplicate_plan"),
            ck.check_statuses(t["plans"], t["sources"], t["failures"]),
            ck.check_checklist(t["plans"], t["requirements"], t["questions"]),
            ck.check_citations(t["citations"], t["sources"]),
            ck.check_steps(t["plans"], t["steps"], t["step_citations"]),
        ]
    )


def grade(observations: DataFrame, wanted: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graded, fetched, failures).

    ``observations``: as ``freshness.attempt`` made them. ``wanted``: plan_id, source_id, url, seq of
    the plan's request time. ``plans``: plan_id, has_checklist, decision_is_unverified.
    """
    folded = cut_lineage(fr.fold_cache(observations))
    seen = wanted.join(
        folded.select("url", F.col("seq").alias("seq"), "result", "outcome", "served_at", "served_hash", "detail"),
        ["url", "seq"],
    )
    fetched = seen.filter(F.col("result") != "failure").select(
        "plan_id", "source_id", "url",
        F.timestamp_micros("served_at").alias("retrieved_at"),
        (F.col("result") == "stale").alias("is_stale"),
        F.col("served_hash").alias("content_hash"),
    )
    failures = seen.filter(F.col("result") == "failure").select(
        "plan_id", "source_id", "url", "outcome", "detail"
    )
    return ck.plan_status(plans, fetched, failures), fetched, failures
