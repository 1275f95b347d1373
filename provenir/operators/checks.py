"""Integrity checks: every rule yields violation rows (entity_id, rule, detail).

Plans, destinations and registries are checked in long form (one row per citation, source, step,
domain), so that no rule gathers a plan's or a registry's children into one row. ``rows`` is the number of
rows of the largest of a check's tables, if known: the tables are then dealt over as many tasks as that needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions import hosts, urls
from provenir.operators.large_groups import dealt
from provenir.operators.trust import matched_hosts
from provenir.params import LIMITS


def violations(rows: DataFrame, entity: Column | str, rule: str, detail: Column | str) -> DataFrame:
    entity = F.col(entity) if isinstance(entity, str) else entity
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return rows.select(
        entity.cast("string").alias("entity_id"),
        F.lit(rule).alias("rule"),
        detail.cast("string").alias("detail"),
    )


def together(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def duplicates(rows: DataFrame, entity: list[str], key: str, rule: str) -> DataFrame:
    """A key that must be unique (within its entity, if any) and is not."""
    many = rows.groupBy(*entity, key).agg(F.count("*").alias("_n")).filter("_n > 1")
    owner = F.col(entity[0]) if entity else F.col(key)
    return violations(many, owner, rule, F.col(key))


def overlaps(rows: DataFrame, entity: str, kind: str, key: str, rule: str) -> DataFrame:
    """A key that appears under two kinds of one entity that must be disjoint."""
    both = rows.groupBy(entity, key).agg(F.count_distinct(kind).alias("_n")).filter("_n > 1")
    return violations(both, entity, rule, F.col(key))


def check_statuses(plans: DataFrame, sources: DataFrame, failures: DataFrame, rows: int = 0) -> DataFrame:
    """A verified plan has no unavailable and no stale source."""
    verified = plans.filter(F.col("status") == "verified").select("plan_id")
    failed = verified.join(dealt(failures.select("plan_id"), rows, "plan_id").distinct(), "plan_id", "left_semi")
    stale = dealt(sources.filter("is_stale").select("plan_id"), rows, "plan_id").distinct()
    old = verified.join(stale, "plan_id", "left_semi")
    return together(
        [
            violations(failed, "plan_id", "verified_with_failure", "unavailable source"),
            violations(old, "plan_id", "verified_with_stale", "stale source"),
        ]
    )


def check_checklist(plans: DataFrame, requirements: DataFrame, questions: DataFrame, rows: int = 0) -> DataFrame:
    """Without a checklist source: no requirements, and at least one open question."""
    bare = plans.filter(~F.col("has_checklist")).select("plan_id")
    listed = bare.join(dealt(requirements.select("plan_id"), rows, "plan_id").distinct(), "plan_id", "left_semi")
    silent = bare.join(dealt(questions.select("plan_id"), rows, "plan_id").distinct(), "plan_id", "left_anti")
    return together(
        [
            violations(listed, "plan_id", "requirements_without_checklist", "requirement"),
            violations(silent, "plan_id", "no_checklist_no_question", "open question missing"),
        ]
    )


def check_citations(citations: DataFrame, sources: DataFrame, rows: int = 0) -> DataFrame:
    """Every cited id is a known source of the plan, and source ids are unique in it."""
    key = ["plan_id", "source_id"]
    sources = dealt(sources.select(*key), rows, *key)
    cited = dealt(citations.select(*key), rows, *key).distinct()
    unknown = cited.join(sources, key, "left_anti")
    return together(
        [
            violations(unknown, "plan_id", "unknown_citation", F.col("source_id")),
            duplicates(sources, ["plan_id"], "source_id", "duplicate_source"),
        ]
    )


def check_steps(plans: DataFrame, steps: DataFrame, step_citations: DataFrame, rows: int = 0) -> DataFrame:
    """Steps: four to eight, lengths, consistent links, and a place for route links."""
    counts = dealt(steps.select("plan_id"), rows, "plan_id").groupBy("plan_id").agg(F.count("*").alias("_n"))
    counted = plans.select("plan_id", "has_location").join(counts, "plan_id", "left")
    number = F.coalesce("_n", F.lit(0))
    wrong_count = counted.filter(~number.between(4, 8))
    where = F.concat(F.lit("step "), F.col("step_no").cast("string"))

    def length(column: str, low: int, high: int) -> DataFrame:
        bad = steps.filter(~F.length(column).between(low, high))
        return violations(bad, "plan_id", f"{column}_length", where)

    to_source = steps.filter(F.col("link_target") == "source")
    missing = to_source.filter(F.col("link_source_id").isNull())
    named = to_source.filter(F.col("link_source_id").isNotNull())
    key = ["plan_id", "step_no", "link_source_id"]
    known = step_citations.select("plan_id", "step_no", F.col("source_id").alias("link_source_id"))
    uncited = named.join(dealt(known, rows, *key).distinct(), key, "left_anti")
    stray = steps.filter((F.col("link_target") != "source") & F.col("link_source_id").isNotNull())
    routed = steps.filter(F.col("link_target") == "application_route")
    nowhere = routed.join(
        dealt(plans.filter(~F.col("has_location")).select("plan_id"), rows, "plan_id"), "plan_id", "left_semi"
    )
    return together(
        [
            violations(wrong_count, "plan_id", "step_count", number),
            length("title", 3, 70),
            length("action", 3, 320),
            length("timing", 3, 160),
            violations(missing, "plan_id", "source_link_without_id", where),
            violations(uncited, "plan_id", "link_not_cited", where),
            violations(stray, "plan_id", "stray_link_id", where),
            violations(nowhere, "plan_id", "route_link_without_location", where),
        ]
    )


def check_destinations(
    destinations: DataFrame,
    sources: DataFrame,
    checklist: DataFrame,
    required: DataFrame,
    domains: DataFrame,
    providers: DataFrame,
    unreadable: DataFrame,
    rows: int = 0,
) -> DataFrame:
    """Destination rules. All tables carry ``slug``; sources and unreadable carry ``url``."""
    key = ["slug", "source_id"]
    known = dealt(sources.select(*key), rows, *key)
    checklist = dealt(checklist, rows, *key)
    trusted = domains.select("slug", "domain").unionByName(providers.select("slug", "domain"))

    def off_trust(pages: DataFrame) -> DataFrame:
        hosted = pages.withColumn("host", urls.host(F.col("url")))
        inside = matched_hosts(hosted, "host", trusted, ["slug"]).select("slug", "host")
        inside = dealt(inside, rows, "slug", "host").distinct()
        return hosted.join(inside, ["slug", "host"], "left_anti")

    route = F.col("route_type")
    member = F.col("schengen_member")
    no_member = destinations.filter((route == "schengen_member") & member.isNull())
    has_member = destinations.filter((route == "national") & member.isNotNull())
    unverified = destinations.filter("decision_is_unverified").join(
        unreadable.select("slug").distinct(), "slug", "left_anti"
    )
    no_domains = sources.select("slug").distinct().join(
        domains.select("slug").distinct(), "slug", "left_anti"
    )
    suffixes = domains.filter(hosts.is_bare_suffix(F.col("domain")))
    appointed = providers.withColumnRenamed("appointed_by", "source_id").join(known, key, "left_anti")
    return together(
        [
            violations(no_member, "slug", "member_missing", "no member country"),
            violations(has_member, "slug", "member_on_national_route", F.col("schengen_member")),
            duplicates(checklist, ["slug"], "source_id", "duplicate_checklist_id"),
            violations(checklist.join(known, key, "left_anti"), "slug", "unknown_checklist_id", F.col("source_id")),
            violations(required.join(known, key, "left_anti"), "slug", "unknown_required_id", F.col("source_id")),
            violations(unverified, "slug", "unverified_without_authority", "no unreadable authority"),
            violations(off_trust(unreadable), "slug", "unreadable_off_trust", F.col("url")),
            violations(suffixes, "slug", "bare_suffix_trusted", F.col("domain")),
            violations(appointed, "slug", "unknown_appointing_source", F.col("domain")),
            violations(no_domains, "slug", "sources_without_domains", "no trusted domain"),
            violations(off_trust(sources), "slug", "source_off_trust", F.col("url")),
        ]
    )


def check_registry(entries: DataFrame) -> DataFrame:
    """``entries``: code, list (trusted/reviewed/unconfirmable), domain, evidence."""
    reviewed = entries.filter(F.col("list") == "reviewed")
    blank = reviewed.filter(urls.strip(F.coalesce("evidence", F.lit(""))) == "")
    return together(
        [
            overlaps(entries, "code", "list", "domain", "domain_in_two_lists"),
            violations(blank, "code", "reviewed_without_evidence", F.col("domain")),
        ]
    )


def check_fields(rows: DataFrame, entity: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """Row rules: each condition must hold (null fails)."""
    return together(
        [
            violations(rows.filter(~F.coalesce(ok, F.lit(False))), entity, name, "field rule")
            for name, ok in rules
        ]
    )


def check_policy(policies: DataFrame) -> DataFrame:
    short = policies.filter(F.col("stale_hours") < F.col("fresh_hours"))
    return violations(short, "name", "ceiling_below_ttl", "stale ceiling below TTL")


def corridor_usability(corridors: DataFrame, load_bearing: list[str]) -> DataFrame:
    """Add usable and decision_is_unverified. ``corridors``: filled (roles), sources, blocking_urls."""
    needed = F.array(*[F.lit(r) for r in load_bearing])
    complete = F.size(F.array_except(needed, F.col("filled"))) == 0
    blocked = F.col("blocking_urls") > 0
    return corridors.withColumn("usable", complete | (blocked & (F.col("sources") > 0))).withColumn(
        "decision_is_unverified", ~F.array_contains("filled", load_bearing[0]) & blocked
    )


def plan_status(plans: DataFrame, retrieved: DataFrame, failures: DataFrame) -> DataFrame:
    """Add ``graded`` and ``last_checked``.

    ``plans``: plan_id, has_checklist, decision_is_unverified. ``retrieved``: plan_id, is_stale,
    retrieved_at. ``failures``: plan_id.
    """
    seen = retrieved.groupBy("plan_id").agg(
        F.bool_or("is_stale").alias("_stale"), F.max("retrieved_at").alias("last_checked")
    )
    failed = failures.groupBy("plan_id").agg(F.count("*").alias("_failed"))
    joined = plans.join(seen, "plan_id", "left").join(failed, "plan_id", "left")
    partial = (
        ~F.col("has_checklist")
        | F.col("decision_is_unverified")
        | (F.coalesce("_failed", F.lit(0)) > 0)
        | F.coalesce("_stale", F.lit(False))
    )
    return joined.withColumn("graded", F.when(partial, "partial").otherwise("verified")).drop(
        "_stale", "_failed"
    )


def missing_sources(required: DataFrame, fetched: DataFrame, failures: DataFrame, by: list[str]) -> DataFrame:
    """Required ids that were not fetched, in order, each with the sentence that says why.

    ``required``: by, source_id, seq. ``failures``: by, source_id, title, authority, detail.
    """
    key = [*by, "source_id"]
    absent = required.join(fetched.select(*key).distinct(), key, "left_anti")
    told = failures.select(*key, failure_sentence().alias("_why"))
    generic = F.concat(F.lit("The required source "), F.col("source_id").cast("string"), F.lit(" was not retrieved."))
    return absent.join(told, key, "left").withColumn("reason", F.coalesce("_why", generic)).drop("_why")


def failure_sentence() -> Column:
    return F.concat(
        F.col("title"), F.lit(" ("), F.col("authority"), F.lit(") could not be used: "), F.col("detail")
    )


def cited_requirements(requirements: DataFrame, checklist: DataFrame, by: list[str]) -> DataFrame:
    """Requirements that cite at least one checklist source. One row per (by, requirement, source)."""
    return (
        requirements.join(checklist.select(*by, "source_id"), [*by, "source_id"], "left_semi")
        .select(*by, "requirement")
        .distinct()
    )


def finish_plans(drafts: DataFrame, destinations: DataFrame, unreadable: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plans, failures, rejected) of drafted plans.

    ``drafts``: plan_id, slug, destination, visa_required. A destination whose decision is
    unverified clears the decision; a draft naming another destination is rejected; each unreadable
    authority (slug, seq, url, authority, detail) becomes a ``blocked_n`` failure of the plan.
    """
    joined = drafts.join(
        destinations.select("slug", "display_name", "decision_is_unverified"), "slug"
    )
    rejected = joined.filter(F.col("destination") != F.col("display_name"))
    plans = joined.filter(F.col("destination") == F.col("display_name")).withColumn(
        "visa_required", F.when(~F.col("decision_is_unverified"), F.col("visa_required"))
    )
    failures = plans.select("plan_id", "slug").join(unreadable, "slug").select(
        "plan_id",
        F.concat(F.lit("blocked_"), F.col("seq").cast("string")).alias("source_id"),
        F.concat(F.lit("Official guidance at "), urls.host(F.col("url"))).alias("title"),
        "authority",
        F.lit("blocked").alias("outcome"),
        "detail",
        F.col("url").alias("attempted_url"),
    )
    violations_ = violations(rejected, "plan_id", "destination_mismatch", F.col("destination"))
    return plans, failures, violations_


POLICY_DEFAULTS = {"fresh_hours": LIMITS.fresh_hours, "stale_hours": LIMITS.stale_hours}
