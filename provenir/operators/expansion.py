"""Bounded link expansion with a ledger of what was left out, and forward chains.

The expansion is level-synchronous: one join per level over the links table, with the page and host
budgets taken by row numbers. A URL is visited at its smallest depth; its candidate row is the best
link found up to that level. The only loop is over levels (two by default), and every level is
written to the checkpoint folder before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions import urls
from provenir.operators import policies as pol
from provenir.operators.ranking import first_of, top
from provenir.operators.trust import flag_within
from provenir.params import LIMITS
from provenir.session import cut_lineage


class Expansion(NamedTuple):
    """``left_out``: by, url, reason (document, score, host budget, page budget, depth).

    A page visited at the last level is in it for ``depth``: its links were not looked at.
    """

    visited: DataFrame
    candidates: DataFrame
    left_out: DataFrame


def expand_links(*args, **options) -> tuple[DataFrame, DataFrame]:
    """The visited pages and the candidates of ``expand``."""
    return expand(*args, **options)[:2]


def expand(
    seeds: DataFrame,
    links: DataFrame | Callable[[DataFrame], DataFrame],
    by: list[str],
    budgets: DataFrame | None = None,
    depth: int = LIMITS.depth,
    pages: int = LIMITS.pages,
    per_host: int = LIMITS.pages_per_host,
    follow: float = LIMITS.follow_score,
    is_document: Column | None = None,
    judge: Callable[[DataFrame], DataFrame] | None = None,
) -> Expansion:
    """
    ``seeds``: by, url, host. ``links``: src, url, host, seq, any link columns, and ``by`` unless
    all groups share one web graph. ``judge`` scores and filters the links met at one level (it
    adds ``score`` and drops what is rejected or off the trusted hosts), so only links of visited
    pages are ever scored; without it ``links`` carries ``score``. ``links`` may also be a function
    that makes the links of the pages (by, src) visited at a level. ``budgets``: by, budget — pages
    one host may take, else ``per_host``. ``is_document`` marks links that are candidates but are
    never followed (PDFs).
    """
    keys = [*by, "url"]
    leaf = F.lit(False) if is_document is None else is_document
    links_at = links if callable(links) else lambda _: links
    # The largest budget bounds the row numbers, the row's own budget decides.
    largest = per_host
    if budgets is not None:
        largest = max(largest, budgets.agg(F.max("budget")).first()[0] or 0)
    visited = None
    candidates = None
    frontier = seeds.select(*keys, "host", F.lit(1000.0).alias("score"))
    for level in range(depth + 1):
        if visited is None:
            room = frontier.withColumn("_spent", F.lit(0)).withColumn("_host_spent", F.lit(0))
        else:
            spent = visited.groupBy(*by).agg(F.count("*").alias("_spent"))
            host_spent = visited.groupBy(*by, "host").agg(F.count("*").alias("_host_spent"))
            room = (
                frontier.join(visited.select(*keys), keys, "left_anti")
                .join(spent, by, "left")
                .join(host_spent, [*by, "host"], "left")
            )
        limit = F.lit(per_host)
        if budgets is not None:
            room = room.join(budgets.select(*by, "budget"), by, "left")
            limit = F.coalesce("budget", limit)
        order = [-F.col("score"), F.col("url")]
        fit = top(room, [*by, "host"], order, largest, "_h").filter(
            F.col("_h") <= limit - F.coalesce("_host_spent", F.lit(0))
        )
        taken = top(fit, by, order, pages, "_p").filter(
            F.col("_p") <= F.lit(pages) - F.coalesce("_spent", F.lit(0))
        )
        now = taken.select(*keys, "host", "score", F.lit(level).alias("depth"))
        visited = cut_lineage(now if visited is None else visited.unionByName(now))
        if level == depth:
            break
        here = visited.filter(F.col("depth") == level).select(*by, F.col("url").alias("src"))
        level_links = links_at(here).drop("depth")
        shared = [c for c in by if c in level_links.columns]
        met = level_links.join(here, [*shared, "src"])
        met = met.withColumn("depth", F.lit(level + 1))
        met = met if judge is None else judge(met)
        found = met.withColumn("_leaf", leaf).drop("src")
        best = first_of(
            found if candidates is None else candidates.unionByName(found),
            keys,
            [-F.col("score"), F.col("depth"), F.col("seq")],
        )
        candidates = cut_lineage(best)
        frontier = candidates.filter((F.col("score") >= follow) & ~F.col("_leaf")).select(
            *keys, "host", "score"
        )
    if candidates is None:
        candidates = seeds.limit(0).withColumn("_leaf", F.lit(False)).withColumn("score", F.lit(0.0))
    # What passed its host's budget at the last level and was still not taken fell to the page budget.
    fitting = fit.select(*keys, F.lit(True).alias("_fits"))
    reason = (
        F.when(F.col("_leaf"), "document")
        .when(F.coalesce(F.col("score") < follow, F.lit(True)), "score")
        .when(F.col("_fits"), "page budget")
        .otherwise("host budget")
    )
    left_out = (
        candidates.join(visited.select(*keys), keys, "left_anti").join(fitting, keys, "left").select(*keys, reason.alias("reason"))
    ).unionByName(visited.filter(F.col("depth") == depth).select(*keys, F.lit("depth").alias("reason")))
    return Expansion(visited, candidates.drop("_leaf"), left_out)


def follow_forwards(
    pages: DataFrame,
    forwards: DataFrame,
    trusted: DataFrame,
    policy_table: DataFrame,
    hops: int = LIMITS.forward_hops,
) -> DataFrame:
    """Follow meta-refresh forwards; add ``final_url``, ``hops`` and ``outcome``.

    ``forwards``: url, target, one row per forwarding page. Each target is checked against the trusted
    domains, then against the crawl policy, before it is followed; a chain still forwarding after the
    last hop, a circle included, is unusable. Pages that don't forward are joined once, to the ends.
    """
    # Only pages that forward take part below; each distinct target is judged once.
    targets = cut_lineage(forwards.select("target").distinct())
    hosted = targets.withColumn("_host", F.coalesce(urls.host(F.col("target")), F.lit("")))
    judged = pol.verdicts(flag_within(hosted, "_host", trusted, "_trusted"), policy_table, "target")
    stop = F.when(~F.col("_trusted"), "untrusted").when(
        F.col("policy") != "allowed", "disallowed"
    )
    judged = judged.select("target", stop.alias("_stop"))
    chain = cut_lineage(forwards.join(judged, "target").select(F.col("url").alias("final_url"), "target", "_stop"))
    current = chain.select(
        F.col("final_url").alias("url"), "final_url", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("outcome")
    )
    for hop in range(hops + 1):
        ahead = current.join(chain, "final_url", "left")
        open_ = F.col("outcome").isNull() & F.col("target").isNotNull()
        if hop == hops:
            current = ahead.select("url", "final_url", "hops", F.when(open_, "unusable").otherwise(F.col("outcome")).alias("outcome"))
        else:
            goes = open_ & F.col("_stop").isNull()
            current = ahead.select(
                "url",
                F.when(goes, F.col("target")).otherwise(F.col("final_url")).alias("final_url"),
                (F.col("hops") + goes.cast("int")).alias("hops"),
                F.when(open_, F.col("_stop")).otherwise(F.col("outcome")).alias("outcome"),
            )
    ended = cut_lineage(current)
    return (
        pages.join(ended, "url", "left")
        .withColumn("final_url", F.coalesce("final_url", "url"))
        .withColumn("hops", F.coalesce("hops", F.lit(0)))
        .withColumn("outcome", F.coalesce("outcome", F.lit("ok")))
    )


def check_landings(rows: DataFrame, trusted: DataFrame, policy_table: DataFrame) -> DataFrame:
    """Add ``landing``: untrusted, disallowed or ok, for the URL a request ended on."""
    # Hosts, paths and the answer are read from the rows, which are worked out once.
    hosted = cut_lineage(rows).withColumn("_host", urls.host(F.col("final_url")))
    flagged = flag_within(hosted, "_host", trusted, "_trusted")
    judged = pol.verdicts(flagged, policy_table, "final_url")
    moved = F.col("final_url") != F.col("url")
    landing = (
        F.when(~F.col("_trusted"), "untrusted")
        .when(moved & (F.col("policy") != "allowed"), "disallowed")
        .otherwise("ok")
    )
    return judged.withColumn("landing", landing).drop("_host", "_trusted", "policy", "detail", "origin")
