"""Ranking, shortlists and budgets.

Every top-k is a ``row_number() <= k`` filter, which Spark applies per task before the shuffle
(WindowGroupLimit), so a corridor or role holding a third of all rows sends k rows per task.
Full rankings go through ``number_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions import hosts, urls
from provenir.operators.large_groups import number_rows
from provenir.params import LIMITS


def top(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of every group."""
    partition = [F.col(c) for c in group] or [F.lit(1)]
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def first_of(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of every group, as an aggregate that combines before the shuffle."""
    rest = [name for name in df.columns if name not in group]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*group).agg(best).select(*group, "_row.*")


def first_seen(hits: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per canonical URL: the first by (query_seq, rank)."""
    return first_of(hits, [*by, "url"], [F.col("query_seq"), F.col("rank")])


def rank_for_role(scores: DataFrame, by: list[str], name: str = "place") -> DataFrame:
    """Every positive candidate's place within its role: score down, then URL."""
    positive = scores.filter(F.col("score") > 0)
    return number_rows(positive, [*by, "role"], [-F.col("score"), F.col("url")], name)


def readable_only(candidates: DataFrame, blocked: DataFrame, dead_hosts: DataFrame) -> DataFrame:
    """Drop refused URLs and hosts that do not resolve; every other failure stays in."""
    return (
        candidates.withColumn("_host", urls.host(F.col("url")))
        .join(blocked.select("url"), "url", "left_anti")
        .join(dead_hosts.select(F.col("host").alias("_host")), "_host", "left_anti")
        .drop("_host")
    )


def reserved_per_domain(
    candidates: DataFrame, by: list[str], floor: int = LIMITS.shortlist_domain_floor
) -> DataFrame:
    """Each registrable domain's best positive rows, up to the floor."""
    positive = candidates.filter(F.col("best") > 0)
    if "domain" not in candidates.columns:
        positive = positive.withColumn("domain", hosts.registrable_domain(urls.host(F.col("url"))))
    return top(positive, [*by, "domain"], [-F.col("best"), F.col("url")], floor, "_floor").drop("_floor")


def shortlist(
    candidates: DataFrame,
    scores: DataFrame,
    by: list[str],
    size: int = LIMITS.shortlist,
    per_role: int = LIMITS.shortlist_per_role,
    floor: int = LIMITS.shortlist_domain_floor,
    roles: int = 6,
) -> DataFrame:
    """The few rows per corridor worth reading.

    ``candidates``: by, url, best (and domain, if it is not the URL's own). ``scores``: by, url,
    role, score. Best rows per role come first, then the best overall fill the places, then each
    domain's best rows are reserved; when that is too many, reserved rows win.
    """
    keys = [*by, "url"]
    best_first = [-F.col("best"), F.col("url")]
    role_rows = top(
        scores.filter(F.col("score") > 0), [*by, "role"], [-F.col("score"), F.col("url")], per_role
    )
    chosen = role_rows.select(*keys).distinct()
    taken = chosen.groupBy(*by).agg(F.count("*").alias("_taken"))
    # The fill never reaches past size places, and at most per_role * roles rows are chosen before.
    fill = (
        top(candidates.filter(F.col("best") > 0), by, best_first, size + per_role * roles, "_p")
        .select(*keys, "best")
        .join(chosen, keys, "left_anti")
    )
    fill = (
        top(fill, by, best_first, size, "_p")
        .join(taken, by, "left")
        .filter(F.col("_p") <= size - F.coalesce("_taken", F.lit(0)))
        .select(*keys)
    )
    reserved = top(reserved_per_domain(candidates, by, floor), by, best_first, size, "_p")
    reserved = reserved.select(*keys, F.lit(1).alias("reserved"))
    wanted = (
        chosen.unionByName(fill)
        .withColumn("reserved", F.lit(0))
        .unionByName(reserved)
        .groupBy(*keys)
        .agg(F.max("reserved").alias("reserved"))
    )
    kept = top(
        candidates.join(wanted, keys), by, [-F.col("reserved"), *best_first], size, "_p"
    ).drop("_p")
    place = Window.partitionBy(*[F.col(c) for c in by]).orderBy(*best_first)
    return kept.withColumn("place", F.row_number().over(place))


def host_budget(
    seeds: DataFrame,
    by: list[str],
    per_host: int = LIMITS.pages_per_host,
    lowest: int = LIMITS.pages_per_host_floor,
    pages: int = LIMITS.pages,
) -> DataFrame:
    """Pages one host may take, given how many seed hosts share the page budget."""
    count = F.count_distinct("host")
    shared = F.least(F.lit(per_host), F.greatest(F.lit(lowest), F.floor(F.lit(pages) / count)))
    budget = F.when(count > 1, shared).otherwise(per_host).cast("int").alias("budget")
    return seeds.groupBy(*by).agg(count.alias("seed_hosts"), budget)


def entry_points(proposals: DataFrame, by: list[str], word: str = "visa") -> DataFrame:
    """Page to enter a domain by: topic in the path, then the shortest URL, then arrival.

    ``proposals``: by, domain, urls (at most three examples).
    """
    shown = proposals.select(*by, "domain", F.posexplode("urls").alias("seq", "url"))
    off_topic = (~urls.path(F.lower(F.col("url"))).contains(word)).cast("int")
    return shown.groupBy(*by, "domain").agg(
        F.min_by("url", F.struct(off_topic, F.length("url"), F.col("seq"))).alias("entry_url")
    )


def merge_candidates(found: DataFrame, crawled: DataFrame, by: list[str]) -> DataFrame:
    """Search and crawl candidates as one row per URL.

    A crawled row replaces a found one only with a strictly better score; among crawled rows the
    first seen wins a tie. Both carry: by, url, best, seq.
    """
    both = found.withColumn("found_by", F.lit("search")).withColumn("_pref", F.lit(0)).unionByName(
        crawled.withColumn("found_by", F.lit("crawl")).withColumn("_pref", F.lit(1))
    )
    order = [-F.col("best"), F.col("_pref"), F.col("seq")]
    return first_of(both, [*by, "url"], order).drop("_pref")
