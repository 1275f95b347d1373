"""Search hits of many countries → registry rows and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame

from provenir.operators import trust
from provenir.params import GOVERNMENT_HOST
from provenir.session import cut_lineage


def build_registry(
    hits: DataFrame,
    countries: DataFrame,
    registry: DataFrame,
    reviewed: DataFrame,
    denylist: DataFrame,
    failed: DataFrame,
    rebuild: bool = False,
    government: str = GOVERNMENT_HOST,
) -> tuple[DataFrame, DataFrame]:
    """(registry, split): the merged registry, and every domain with its trust decision.

    ``hits``: code, query, query_seq, rank, url, title. ``countries``: code, name, tlds.
    ``reviewed``: code, domain, evidence, seq. ``failed``: code, of countries whose searches failed;
    they keep the row they had, or stay out.
    """
    pending = trust.pending_countries(countries.select("code", "name", "tlds"), registry, rebuild)
    asked = hits.join(pending.select("code"), "code", "left_semi")
    proposals = trust.propose_domains(asked, denylist, pending.select("code", "tlds"), government, ["code"])
    split = cut_lineage(trust.split_trust(proposals, ["code"]))
    held = reviewed.join(pending.select("code"), "code", "left_semi")
    built = trust.registry_rows(split, held, ["code"]).join(pending.select("code", "name"), "code")
    rows = built.select(*registry.columns)
    return trust.merge_registry(registry, rows, failed), split
