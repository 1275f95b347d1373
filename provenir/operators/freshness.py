"""Freshness: as-of lookups, the cache fold over fetch observations, ledgers and newest rows.

The fold is sequential per URL: a hit inside the TTL suppresses the fetch, so which observation
refreshes next depends on the one before. Two refreshes are at least one TTL apart, so a URL's
chain is short however many observations it has. URLs with few observations are folded inside one
row. URLs with many go another, exact way: every observation points at the one that would refresh
next, and the chain from the first stored page is followed by doubling the pointers, all by joins
on (url, time), so no task ever holds a URL's whole history.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.urls import strip
from provenir.operators.large_groups import carry_last
from provenir.operators.ranking import first_of
from provenir.params import LIMITS, REFUSALS
from provenir.session import cut_lineage

HOUR = 3_600_000_000
ROW_LIMIT = 20_000
FALLBACK = ("disallowed", "unreachable", "blocked", "unusable")


def as_of(
    probes: DataFrame,
    entries: DataFrame,
    by: list[str],
    at: str,
    tie: str,
    name: str,
    inclusive: bool = True,
) -> DataFrame:
    """Add ``name``: the last entry of the key at or before the probe, as a struct.

    ``at`` is in microseconds and ``tie`` orders rows of one instant. Probes and entries are sorted
    together by range, so a busy key is spread over as many tasks as its rows take; what a slice begins
    with comes from a table with one row per slice and key. ``by`` columns are not null.
    """
    held = F.struct(*[c for c in entries.columns if c not in by])
    place = [F.col(at).alias("_at"), F.col(tie).alias("_tie")]
    mixed = probes.select(*by, *place, F.lit(1 if inclusive else 0).alias("_side"), F.struct(*probes.columns).alias("_probe"))
    mixed = mixed.unionByName(
        entries.select(*by, *place, F.lit(0 if inclusive else 1).alias("_side"), held.alias("_entry")), allowMissingColumns=True
    )
    order = [F.col("_at"), F.col("_tie"), F.col("_side")]
    found = carry_last(mixed, by, order, "_entry", "_found")
    return found.filter(F.col("_probe").isNotNull()).select("_probe.*", F.col("_found").alias(name))


def attempt(observations: DataFrame, page_bytes: int = LIMITS.page_bytes) -> DataFrame:
    """Add ``attempt``: what the request alone says, before any cache is consulted.

    ``observations``: policy, error, trusted (boolean), http_status, bytes, machine (boolean),
    forward (ok or an outcome), thin (reason or null). A body beyond ``page_bytes`` is unusable.
    """
    status = F.col("http_status")
    ladder = (
        F.when(F.col("policy") != "allowed", "disallowed")
        .when(F.col("error").isNotNull(), "unreachable")
        .when(~F.col("trusted"), "untrusted")
        .when(status == 304, "not_modified")
        .when(status.isin(REFUSALS), "blocked")
        .when(status != 200, "unreachable")
        .when(F.col("bytes") > page_bytes, "unusable")
        .when(F.col("machine"), "unusable")
        .when(F.col("forward") != "ok", F.col("forward"))
        .when(F.col("thin").isNotNull(), "unusable")
        .otherwise("stored")
    )
    return observations.withColumn("attempt", ladder)


def _fold_rows(success: DataFrame, ttl: int) -> DataFrame:
    """Refreshes of URLs whose successful observations fit one row."""
    row = F.struct("at", "seq", "attempt", "content_hash")
    refresh = "struct<at:bigint,seq:bigint,attempt:string,content_hash:string>"

    def step(acc: Column, r: Column) -> Column:
        empty = F.size(acc) == 0
        due = F.when(empty, r["attempt"] == "stored").otherwise(
            r["at"] - F.element_at(acc, -1)["at"] >= F.lit(ttl)
        )
        return F.when(due, F.array_append(acc, r.cast(refresh))).otherwise(acc)

    folded = F.aggregate(
        F.sort_array(F.collect_list(row)).cast(f"array<{refresh}>"),
        F.array().cast(f"array<{refresh}>"),
        step,
    )
    return success.groupBy("url").agg(folded.alias("_r")).select("url", F.inline("_r"))


def _follow_pointers(success: DataFrame, ttl: int) -> DataFrame:
    """Refreshes of URLs with any number of observations, by doubling next-refresh pointers."""
    start = success.filter(F.col("attempt") == "stored").groupBy("url").agg(
        F.min(F.struct("at", "seq")).alias("_start")
    )
    alive = success.join(start, "url").filter(F.struct("at", "seq") >= F.col("_start"))
    nodes = cut_lineage(first_of(alive.drop("_start"), ["url", "at"], [F.col("seq")]))
    # With time running backwards, the next observation a TTL on is the last one before.
    back = nodes.select("url", (-F.col("at")).alias("_t"), F.lit(0).alias("_k"), F.col("at").alias("_node"))
    due = nodes.select("url", (-(F.col("at") + F.lit(ttl))).alias("_t"), F.lit(0).alias("_k"), "at")
    jumps = as_of(due, back, ["url"], "_t", "_k", "_next").filter(F.col("_next").isNotNull()).select(
        "url", "at", F.col("_next._node").alias("to")
    )
    span = nodes.agg((F.max("at") - F.min("at")).alias("s")).first()["s"] or 0
    rounds = max(1, math.ceil(math.log2(span / ttl + 2)))
    reached = start.select("url", F.col("_start.at").alias("at"))
    for turn in range(rounds):
        jumps = cut_lineage(jumps)
        reached = cut_lineage(
            reached.unionByName(
                reached.join(jumps, ["url", "at"]).select("url", F.col("to").alias("at"))
            ).distinct()
        )
        if turn + 1 < rounds:
            second = jumps.select("url", F.col("at").alias("to"), F.col("to").alias("_to"))
            jumps = jumps.join(second, ["url", "to"]).select("url", "at", F.col("_to").alias("to"))
    return reached.join(nodes, ["url", "at"]).select("url", "at", "seq", "attempt", "content_hash")


def refreshes(
    observations: DataFrame, ttl_hours: float = LIMITS.fresh_hours, row_limit: int = ROW_LIMIT
) -> DataFrame:
    """(url, at, seq, attempt, content_hash, held_hash): the observations that moved the cache.

    ``observations``: url, at (microseconds), seq, attempt, content_hash.
    """
    ttl = int(ttl_hours * HOUR)
    success = observations.filter(F.col("attempt").isin("stored", "not_modified")).select(
        "url", "at", F.col("seq").cast("long").alias("seq"), "attempt", "content_hash"
    )
    if ttl <= 0:
        # Nothing is ever a hit: every success from the first stored page on moves the cache.
        begun = success.filter(F.col("attempt") == "stored").groupBy("url").agg(F.min(F.struct("at", "seq")).alias("_start"))
        chain = success.join(begun, "url").filter(F.struct("at", "seq") >= F.col("_start")).drop("_start")
        held = Window.partitionBy("url").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
        stored = F.when(F.col("attempt") == "stored", F.col("content_hash"))
        return chain.withColumn("held_hash", F.last(stored, ignorenulls=True).over(held))
    sizes = success.groupBy("url").count()
    busy = sizes.filter(F.col("count") > row_limit).select("url")
    if busy.isEmpty():
        chain = _fold_rows(success, ttl)
    else:
        busy = cut_lineage(busy)
        chain = _fold_rows(success.join(busy, "url", "left_anti"), ttl).unionByName(
            _follow_pointers(success.join(busy, "url", "left_semi"), ttl)
        )
    held = Window.partitionBy("url").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    stored = F.when(F.col("attempt") == "stored", F.col("content_hash"))
    return chain.withColumn("held_hash", F.last(stored, ignorenulls=True).over(held))


def fold_cache(
    observations: DataFrame,
    ttl_hours: float = LIMITS.fresh_hours,
    ceiling_hours: float = LIMITS.stale_hours,
    row_limit: int = ROW_LIMIT,
) -> DataFrame:
    """Add what the cache makes of every observation.

    ``result``: hit, revalidated, fetched, stale or failure; ``outcome``: fresh/stale/the failure;
    ``served_at`` and ``served_hash``: the evidence handed on, with its original time when stale.
    """
    moved = refreshes(observations, ttl_hours, row_limit)
    state = moved.select("url", "at", "seq", "held_hash")
    rows = observations.withColumn("seq", F.col("seq").cast("long"))
    joined = as_of(rows, state, ["url"], "at", "seq", "_held", inclusive=False)
    held = F.col("_held")
    age = (F.col("at") - held["at"]) / F.lit(float(HOUR))
    return (
        joined.withColumn("age_hours", age)
        .withColumn("result", _result(held, F.col("age_hours"), ttl_hours, ceiling_hours))
        .withColumn("outcome", _outcome(F.col("result"), F.col("attempt")))
        .withColumn("detail", _detail(F.col("result"), F.col("age_hours"), ceiling_hours))
        .withColumn(
            "served_at",
            F.when(F.col("result").isin("fetched", "revalidated"), F.col("at")).when(
                F.col("result").isin("hit", "stale"), held["at"]
            ),
        )
        .withColumn(
            "served_hash",
            F.when(F.col("result") == "fetched", F.col("content_hash")).when(
                F.col("result") != "failure", held["held_hash"]
            ),
        )
        .drop("_held")
    )


def _result(held: Column, age: Column, ttl: float, ceiling: float) -> Column:
    tried = F.col("attempt")
    return (
        F.when(held.isNotNull() & (age < ttl), "hit")
        .when((tried == "not_modified") & held.isNotNull(), "revalidated")
        .when(tried == "stored", "fetched")
        .when(tried == "untrusted", "failure")
        .when(held.isNotNull() & (age <= ceiling), "stale")
        .otherwise("failure")
    )


def _outcome(result: Column, tried: Column) -> Column:
    failed = F.when(tried == "not_modified", "unreachable").otherwise(tried)
    return F.when(result == "failure", failed).when(result == "stale", "stale").otherwise("ok")


def _detail(result: Column, age: Column, ceiling: float) -> Column:
    past = F.concat(
        F.lit("the cached copy is "), F.round(age).cast("long").cast("string"),
        F.lit(f" hours old, past the {ceiling:.0f} hour limit"),
    )
    return F.when((result == "failure") & (F.col("attempt") != "untrusted") & (age > ceiling), past)


def content_changes(moved: DataFrame) -> DataFrame:
    """Stored pages with ``changed``: the hash differs from the one stored before."""
    stored = moved.filter(F.col("attempt") == "stored")
    earlier = F.lag("content_hash").over(Window.partitionBy("url").orderBy("at", "seq"))
    return stored.withColumn("previous_hash", earlier).withColumn(
        "changed", F.coalesce(F.col("content_hash") != earlier, F.lit(False))
    )


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row per key, as one aggregate (last of the order)."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, "_row.*")


def cache_table(moved: DataFrame) -> DataFrame:
    """One current row per URL."""
    return newest(moved, ["url"], [F.col("at"), F.col("seq")]).select(
        "url", F.col("at").alias("fetched_at"), F.col("held_hash").alias("content_hash")
    )


def reuse(
    requests: DataFrame,
    stored: DataFrame,
    by: list[str],
    at: str,
    tie: str,
    hours: float | dict[str, float],
    held: str = "held",
) -> DataFrame:
    """Add ``held`` (the last stored answer), ``age_hours`` and ``reused``: it is younger than ``hours``.

    ``hours`` may name several flags with a limit each; all are told from one lookup.
    """
    limits = hours if isinstance(hours, dict) else {"reused": hours}
    joined = as_of(requests, stored, by, at, tie, held)
    age = (F.col(at) - F.col(f"{held}.{at}")) / F.lit(float(HOUR))
    joined = joined.withColumn("age_hours", age)
    return joined.withColumns(
        {name: F.coalesce(F.col("age_hours") < limit, F.lit(False)) for name, limit in limits.items()}
    )


def ledger(outcomes: DataFrame, key: str = "url") -> DataFrame:
    """Last outcome per URL; an older status survives a later failure that carries none."""
    order = F.struct("at", "seq")
    status = F.max_by(F.when(F.col("status").isNotNull(), F.col("status")),
                      F.when(F.col("status").isNotNull(), order))
    last = F.max_by(F.struct("outcome", "reason", "at", "seq"), order)
    return outcomes.groupBy(key).agg(last.alias("_l"), status.alias("status")).select(
        key, "_l.outcome", "_l.reason", "_l.at", "_l.seq", "status"
    )


def crawl_outcome(rows: DataFrame, page_bytes: int = LIMITS.page_bytes) -> DataFrame:
    """Add ``outcome``: how one crawl request ended (the first test that applies).

    A body beyond ``page_bytes`` is unusable.

    ``rows``: policy, error, landing_trusted, landing_policy, http_status, bytes, content_type, body.
    """
    status = F.col("http_status")
    ladder = (
        F.when(F.col("policy") != "allowed", "disallowed")
        .when(F.col("error").isNotNull(), "unreachable")
        .when(~F.col("landing_trusted"), "untrusted")
        .when(F.col("landing_policy") != "allowed", "disallowed")
        .when(status.isin(REFUSALS), "blocked")
        .when(status != 200, "unusable")
        .when(F.col("bytes") > page_bytes, "unusable")
        .when(~F.lower(F.coalesce("content_type", F.lit("text/html"))).contains("html"), "unusable")
        .when(strip(F.col("body")) == "", "unusable")
        .otherwise("ok")
    )
    return rows.withColumn("outcome", ladder)
