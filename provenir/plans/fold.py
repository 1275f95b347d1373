"""Resolved corridors → destination configuration, and the rules it must still pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.functions import urls
from provenir.operators import checks as ck
from provenir.operators.large_groups import dealt
from provenir.params import LOAD_BEARING_ROLES
from provenir.session import cut_lineage

CHECKLIST = "document_checklist"


def fold_corridors(
    sources: DataFrame, destinations: DataFrame, providers: DataFrame, refused: DataFrame
) -> dict[str, DataFrame]:
    """Long tables of the configuration that resolved corridors amount to.

    ``sources``: slug, source_id, url, roles. ``destinations``: slug, display_name,
    decision_is_unverified. ``providers``: slug, domain, appointed_by. ``refused``: slug, url of
    settled refusals. A provider whose appointing page is gone is no longer authorised.
    """
    key = ["slug", "source_id"]
    # Every rule reads the sources; they are written once.
    sources = cut_lineage(sources)
    rows = sources.count()
    by_role = sources.select(*key, F.explode("roles").alias("role"))
    checklist = dealt(by_role.filter(F.col("role") == CHECKLIST).select(*key), rows, *key).distinct()
    deciding = dealt(by_role.filter(F.col("role").isin(LOAD_BEARING_ROLES)).select(*key), rows, *key).distinct()
    # Checklist pages come first, then the deciding pages that are not among them.
    required = checklist.withColumn("place", F.lit(1)).unionByName(
        deciding.join(checklist, key, "left_anti").withColumn("place", F.lit(2))
    )
    named = sources.select("slug", F.col("source_id").alias("appointed_by"))
    appointed = providers.join(dealt(named, rows, "slug", "appointed_by"), ["slug", "appointed_by"], "left_semi")
    host = urls.host(F.col("url"))
    unreadable = refused.join(destinations.select("slug", "display_name"), "slug").select(
        "slug",
        "url",
        F.concat(F.col("display_name"), F.lit(" authority ("), host, F.lit(")")).alias("authority"),
        F.lit("refused automated retrieval, so its guidance could not be verified").alias("detail"),
    )
    return {
        "destinations": destinations,
        "sources": sources.select(*key, "url"),
        "checklist": checklist,
        "required": required,
        "providers": appointed.select("slug", "domain", "appointed_by"),
        "unreadable": unreadable,
    }


def check_folded(folded: dict[str, DataFrame], domains: DataFrame) -> DataFrame:
    """Run the destination rules again over the folded configuration: nothing is exempt."""
    routes = folded["destinations"].select(
        "slug", F.lit("national").alias("route_type"), F.lit(None).cast("string").alias("schengen_member"),
        "decision_is_unverified",
    )
    return ck.check_destinations(
        routes, folded["sources"], folded["checklist"], folded["required"], domains,
        folded["providers"], folded["unreadable"], folded["sources"].count(),
    )
