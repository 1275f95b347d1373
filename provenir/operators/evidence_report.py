"""What could not be read, per host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.operators.checks import together
from provenir.params import SETTLED_REFUSALS


def rollup_failures(ledger: DataFrame) -> DataFrame:
    """(host, kind, reason) rows of a ledger (host, url, outcome, reason, status, at, seq).

    ``unreadable`` holds the first reason of every host; ``skipped`` every distinct reason of
    disallowed pages; ``inaccessible`` hosts that refused; ``refused`` the pages of settled
    refusals. Rows, not arrays, since a host or a run can have any number of them.
    """
    failed = ledger.filter(F.col("outcome") != "ok")
    first = (
        failed.filter(F.col("outcome") != "disallowed")
        .groupBy("host")
        .agg(F.min_by("reason", F.struct("at", "seq")).alias("reason"))
        .select("host", F.lit("unreadable").alias("kind"), "reason")
    )
    skipped = (
        failed.filter(F.col("outcome") == "disallowed")
        .select("host", F.lit("skipped").alias("kind"), "reason")
        .distinct()
    )
    blocked = failed.filter(F.col("outcome") == "blocked")
    hosts = blocked.select("host", F.lit("inaccessible").alias("kind"), F.lit("").alias("reason"))
    settled = blocked.filter(F.col("status").isin(SETTLED_REFUSALS))
    pages = settled.select("host", F.lit("refused").alias("kind"), F.col("url").alias("reason"))
    return together([first, skipped, hosts.distinct(), pages])
