"""Bench of the headline queries. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from provenir import catalog
from provenir.session import clear_stages, local_session, stage_folder

HEADLINE = [
    "domain_evidence", "trust_split", "registry_rows", "canonical_urls", "links", "clean_text", "link_scores",
    "body_scores", "mention_windows", "excerpt", "country_mentions", "role_rank", "shortlist_reserved",
    "assign_roles", "robots_verdict", "expand_links", "forward_chain", "cache_lookup", "cache_fold",
    "cache_fold_busy", "ledger", "plan_status", "integrity", "destination_rules",
]


#: Rows of which table a query goes through, for the rates.
RATED = {
    "links": "pages", "clean_text": "pages", "canonical_urls": "pages", "link_scores": "pages", "domain_evidence": "pages",
    "body_scores": "documents", "mention_windows": "documents", "excerpt": "documents", "country_mentions": "documents",
    "shortlist_reserved": "documents", "cache_lookup": "events", "cache_fold": "events", "cache_fold_busy": "events",
    "forward_chain": "orders", "plan_status": "lineitem", "integrity": "lineitem",
}


def split_tables(spark, folder: str, cpus: int) -> str:
    """The tables with text as several files each, as a large table would lie: one file is one split."""
    target = f"{stage_folder(spark)}-bench"
    for name in os.listdir(folder):
        table = spark.read.parquet(f"{folder}/{name}")
        parts = cpus if name.split(".")[0] in ("documents", "pages") else 1
        (table.repartition(parts) if parts > 1 else table).write.mode("overwrite").parquet(f"{target}/{name}")
    return target


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES")
    catalog.load()
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["newest_runs"](spark, folder).count()
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    folder = split_tables(spark, folder, cpus)
    times: dict[str, float] = {}
    rows = {name: spark.read.parquet(f"{folder}/{name}.parquet").count() for name in sorted(set(RATED.values()))}
    for name in chosen.split(",") if chosen else HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        clear_stages(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": {name: round(rows[RATED[name]] / t) for name, t in times.items() if name in RATED},
                "sf": sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
