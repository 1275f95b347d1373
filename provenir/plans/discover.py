"""Search hits, pages and links of many corridors → the pages that fill their roles.

All corridors run in one job; ``corridor_key`` is a column throughout. Page text is joined for
shortlisted pages only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.functions import urls
from provenir.operators import audit, lexicon as lx, pages as pg, ranking as rk, roles as rl
from provenir.operators import scoring as sc
from provenir.operators.expansion import expand_links
from provenir.operators.trust import name_authority, own_missions, within
from provenir.params import LIMITS, LOAD_BEARING_ROLES, Lexicon, Limits
from provenir.session import cut_lineage

KEY = ["corridor_key"]
PAGE = ["corridor_key", "url"]


@dataclass
class Resolved:
    sources: DataFrame
    unresolved: DataFrame
    corridors: DataFrame
    considered: DataFrame
    visited: DataFrame


def _with_context(
    links: DataFrame, corridors: DataFrame, countries: DataFrame, lexicon: Lexicon, configured: DataFrame
) -> DataFrame:
    """Corridor columns, nationality flag and mission affinity of candidate links."""
    rows = links.join(
        corridors.select(*KEY, "slug", "purpose", "nationality", "applying_from", "destination_code"), KEY
    )
    about = lx.country_mentions(rows, PAGE, countries, by_host=False)
    named = about.select(*PAGE, F.col("code").alias("nationality"), F.lit(True).alias("_about"))
    labels = countries.select(F.col("code").alias("applying_from"), "mission_labels")
    judged = (
        rows.join(named, [*PAGE, "nationality"], "left")
        .join(labels, "applying_from", "left")
        .withColumn("describes_nationality", F.coalesce("_about", F.lit(False)))
        .withColumn(
            "affinity",
            lx.mission_affinity(F.col("url"), F.col("mission_labels"), lexicon.mission_markers),
        )
        .drop("_about", "mission_labels")
    )
    residences = countries.select("code", F.col("mission_labels").alias("host_labels"))
    return own_missions(judged, configured.select("slug", "host"), residences, "applying_from").drop("slug")


def score_candidates(
    links: DataFrame, corridors: DataFrame, countries: DataFrame, lexicon: Lexicon, configured: DataFrame
) -> DataFrame:
    """Role scores (long) of unique candidate links that are not rejected."""
    ready = _with_context(links, corridors, countries, lexicon, configured)
    allowed = ["nationality", "applying_from", "destination_code"]
    judged = lx.reject_links(ready, PAGE, lexicon, countries, allowed)
    return sc.score_links(judged.filter(F.col("rejected").isNull()), PAGE, lexicon)


def resolve(
    corridors: DataFrame,
    domains: DataFrame,
    hits: DataFrame,
    pages: DataFrame,
    ledger: DataFrame,
    dead_hosts: DataFrame,
    countries: DataFrame,
    configured: DataFrame,
    lexicon: Lexicon,
    limits: Limits = LIMITS,
) -> Resolved:
    """
    ``corridors``: corridor_key, slug, display_name, nationality, applying_from, destination_code,
    purpose. ``domains``: corridor_key, domain. ``hits``: corridor_key, query_seq, rank, url,
    title. ``pages``: url, html. ``ledger``: url, outcome, status. ``countries``: as in ``schemas``.
    ``configured``: slug, seq, host, authority, kind of hand-configured sources.
    """
    trusted = domains.select(*KEY, "domain")

    def links(visited: DataFrame) -> DataFrame:
        """Links of visited pages; the markup of other pages is never parsed."""
        wanted = pages.join(visited.select(F.col("src").alias("url")).distinct(), "url", "left_semi")
        found = pg.extract_links(wanted).select(
            F.col("src_page").alias("src"), "url", "text", "heading", F.col("pos").cast("long").alias("seq")
        )
        return found.withColumn("host", urls.host(F.col("url"))).withColumn("title", F.lit(None).cast("string"))

    def judge(met: DataFrame) -> DataFrame:
        """Score the links met at one level; keep those on the corridor's domains, not rejected."""
        inside = within(met, "host", trusted, KEY).filter(urls.looks_crawlable(F.col("url")))
        unique = cut_lineage(rk.first_of(inside, PAGE, [F.col("seq"), F.col("src")]))
        ready = _with_context(unique, corridors, countries, lexicon, configured)
        allowed = ["nationality", "applying_from", "destination_code"]
        kept = lx.reject_links(ready, PAGE, lexicon, countries, allowed).filter(
            F.col("rejected").isNull()
        )
        scores = sc.score_links(kept, PAGE, lexicon).groupBy(*PAGE).agg(F.max("score").alias("score"))
        return (
            kept.select(*unique.columns)
            .join(scores, PAGE, "left")
            .withColumn("score", F.coalesce("score", F.lit(0.0)))
        )

    found = hits.select(
        *KEY, "query_seq", "rank", "title", urls.canonical_url(F.col("url")).alias("url")
    ).withColumn("host", urls.host(F.col("url")))
    found = rk.first_seen(within(found, "host", trusted, KEY), KEY)
    found = cut_lineage(
        found.select(
            *PAGE, "host", "title",
            F.coalesce("title", F.lit("")).alias("text"),
            F.lit("").alias("heading"),
            F.lit(0).alias("depth"),
            (F.shiftleft(F.col("query_seq").cast("long"), 32) + F.col("rank")).alias("seq"),
        )
    )
    search_scores = score_candidates(found, corridors, countries, lexicon, configured)
    search_best = search_scores.groupBy(*PAGE).agg(F.max("score").alias("score"))
    search = found.join(search_best, PAGE, "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )
    budgets = rk.host_budget(found, KEY, limits.pages_per_host, limits.pages_per_host_floor, limits.pages)
    visited, crawled = expand_links(
        found, links, KEY, budgets, limits.depth, limits.pages, limits.pages_per_host,
        limits.follow_score, urls.is_pdf(F.col("url")), judge,
    )
    columns = [*PAGE, "host", "title", "text", "heading", "depth", "seq", F.col("score").alias("best")]
    merged = cut_lineage(
        rk.merge_candidates(search.select(*columns), crawled.select(*columns), KEY)
    )
    titles = pages.select("url", pg.page_title(F.col("html")).alias("_page_title"))
    wanted = merged.filter(F.coalesce("title", F.lit("")) == "").select("url").distinct()
    merged = (
        merged.join(titles.join(wanted, "url", "left_semi"), "url", "left")
        .withColumn(
            "title",
            F.coalesce(
                F.nullif("title", F.lit("")), F.nullif("_page_title", F.lit("")), F.nullif("text", F.lit(""))
            ),
        )
        .drop("_page_title")
    )
    scores = cut_lineage(score_candidates(merged.drop("best"), corridors, countries, lexicon, configured))
    open_ = rk.readable_only(merged, ledger.filter(F.col("outcome") == "blocked"), dead_hosts)
    open_scores = scores.join(open_.select(*PAGE), PAGE, "left_semi")
    short = cut_lineage(
        rk.shortlist(
            open_, open_scores, KEY, limits.shortlist, limits.shortlist_per_role,
            limits.shortlist_domain_floor, len(lexicon.roles),
        )
    )
    texts = pages.join(short.select("url").distinct(), "url", "left_semi").select(
        "url", pg.readable_text(F.col("html")).alias("content")
    )
    tokens = lx.country_tokens(countries).groupBy(F.col("code").alias("nationality")).agg(
        F.sort_array(F.collect_set("token")).alias("nationality_tokens")
    )
    read = (
        short.join(texts, "url")
        .filter(F.length("content") >= limits.readable_text)
        .join(corridors.select(*KEY, "purpose", "nationality"), KEY)
        .join(tokens, "nationality", "left")
        .withColumn("nationality_tokens", F.coalesce("nationality_tokens", F.array().cast("array<string>")))
        .withColumn("title", F.coalesce("title", F.lit("")))
    )
    read = cut_lineage(read)
    bodies = sc.score_bodies(read, PAGE, lexicon)
    links_of_read = scores.join(read.select(*PAGE), PAGE, "left_semi")
    combined = sc.combine(links_of_read, bodies, PAGE, read, lexicon)
    signals = scores.select(*PAGE, "role", "signals")
    final = cut_lineage(combined.join(signals, [*PAGE, "role"], "left").withColumn(
        "signals", F.coalesce("signals", F.array().cast("array<string>"))
    ))
    won = rl.best_per_role(final, KEY, limits.role_score)
    sources = rl.assign_roles(final, KEY, lexicon.roles, limits.role_score)
    sources = sources.join(merged.select(*PAGE, "host", "title"), PAGE).join(
        corridors.select(*KEY, "slug", "display_name"), KEY
    )
    named = name_authority(sources, configured)
    first_role = F.array_position(
        F.array(*[F.lit(r) for r in lexicon.roles]), F.get("roles", F.lit(0))
    ).cast("int")
    named = rl.source_ids(named.withColumn("seq", first_role), KEY, F.col("slug"), "seq")
    unresolved = rl.unresolved_roles(corridors, won, KEY)
    settled = ledger.filter((F.col("outcome") == "blocked") & F.col("status").isin(401, 403))
    blocking = rl.decision_blocking(scores, settled, KEY, lexicon.roles[0])
    counts = read.groupBy(*KEY).agg(F.count("*").alias("pages_fetched"))
    rows = rl.corridor_results(
        corridors, named, unresolved, blocking, KEY, LOAD_BEARING_ROLES, counts
    )
    seen = audit.considered(merged.select(*PAGE, "best", "found_by", "title", "depth"), short, read, KEY)
    return Resolved(named, unresolved, rows, seen, visited)
