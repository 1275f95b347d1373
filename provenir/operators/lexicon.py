"""Vocabulary joins: countries named by a text, reject reasons, mission affinity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions import text as tx
from provenir.functions import urls
from provenir.operators.vocabulary import HELD, Vocabulary, attach, link_probes, met_with
from provenir.params import Lexicon

def country_tokens(countries: DataFrame) -> DataFrame:
    """(code, name, seq, token): sorted distinct lower-case names, synonyms and demonyms."""
    listed = F.concat(F.array("name"), F.col("synonyms"), F.col("demonyms"))
    tokens = F.array_sort(F.array_distinct(F.transform(listed, F.lower)))
    return countries.select("code", "name", "seq", F.explode(tokens).alias("token"))


def _long_names(tokens: DataFrame) -> DataFrame:
    """Names of several words under that of their words which fewest of them have: (word, name)."""
    each = tokens.select("token", F.explode(F.array_distinct(tx.words(F.col("token")))).alias("word")).distinct()
    counts = each.groupBy("word").agg(F.count("*").alias("_n"))
    best = F.min_by("word", F.struct("_n", -F.length("word"), "word")).alias("word")
    rarest = each.join(counts, "word").groupBy("token").agg(best)
    return tokens.join(rarest, "token").select("word", F.struct("token", "code", "name", "seq").alias("long"))


def _as_words(text: Column, token: Column) -> Column:
    """The token stands in the (lower-case) text as whole words."""
    escaped = F.regexp_replace(token, r"([\\.\[\]{}()+?^|$*])", r"\\$1")
    whole = F.concat(F.lit(f"(^|{tx.WORD_EDGE})"), escaped, F.lit(f"($|{tx.WORD_EDGE})"))
    return F.contains(text, token) & F.rlike(text, whole)


def country_mentions(
    rows: DataFrame,
    keys: list[str],
    countries: DataFrame,
    text: str = "text",
    url: str | None = "url",
    by_host: bool = True,
) -> DataFrame:
    """Distinct (keys, code, name, seq) of the countries each row refers to.

    A token matches as whole words of the text, as a path segment or as a hyphen part of one, and
    with ``by_host`` a host label matches too. One-word tokens are joined on the distinct words of
    the text. Names of several words are joined on their rarest word and verified in the row, however
    many there are; a name without a word names nothing.
    """
    named = ["code", "name", "seq"]
    tokens = country_tokens(countries)
    single = F.col("token") == F.get(tx.words(F.col("token")), F.lit(0))
    in_text = rows.select(*keys, F.explode(F.array_distinct(tx.words(F.col(text)))).alias("token"))
    found = met_with(in_text, tokens.filter(single), "token").select(*keys, *named)
    longer = _long_names(tokens.filter(~F.coalesce(single, F.lit(False))))
    met = met_with(in_text, longer.withColumnRenamed("word", "token"), "token").groupBy(*keys).agg(F.collect_set("long").alias("_long"))
    texts = rows.select(*keys, F.lower(text).alias("_text")).join(met, keys)
    found = found.unionByName(
        texts.select(*keys, F.inline(F.filter("_long", lambda n: _as_words(F.col("_text"), n["token"])))).select(*keys, *named)
    )
    if url is not None:
        link = F.col(url)
        parts = F.flatten(
            F.transform(urls.segments(link), lambda s: F.array_append(F.split(s, "-"), s))
        )
        pieces = rows.select(*keys, F.explode(F.array_distinct(parts)).alias("token"))
        found = found.unionByName(
            met_with(pieces, tokens, "token").select(*keys, *named)
        )
        if by_host:
            labels = rows.select(*keys, F.explode(F.split(urls.host(link), r"\.")).alias("label"))
            hosts = countries.select(*named, F.explode("host_labels").alias("label"))
            found = found.unionByName(met_with(labels, hosts, "label").select(*keys, *named))
    return found.distinct()


def foreign_country(
    rows: DataFrame, keys: list[str], countries: DataFrame, allowed: list[str]
) -> DataFrame:
    """(keys, foreign): the first country in registry order, outside the row's own ones.

    ``allowed`` names the columns that hold the corridor's own country codes.
    """
    mentions = country_mentions(rows, keys, countries).join(
        rows.select(*keys, F.array(*allowed).alias("_own")).distinct(), keys
    )
    outside = mentions.filter(~F.array_contains("_own", F.col("code")))
    return outside.groupBy(*keys).agg(F.min_by("name", "seq").alias("foreign"))


def is_archived(url: Column, listed: Column) -> Column:
    """An archive segment, or a year from 1990 to 2024 as a whole segment."""
    years = F.lit("^(199[0-9]|20[01][0-9]|202[0-4])$")
    return urls.let(
        urls.segments(url),
        lambda s: F.arrays_overlap(s, listed) | F.exists(s, lambda part: F.rlike(part, years)),
    )


def is_boilerplate(url: Column, listed: Column) -> Column:
    return F.arrays_overlap(urls.segments(url), listed)


def wrong_audience(text: Column, heading: Column, url: Column, listed: Column) -> Column:
    """The first of the listed terms that the link carries."""
    return tx.first_matching(F.lower(F.concat_ws(" ", text, heading, urls.searchable(url))), listed)


def reject_links(
    links: DataFrame, keys: list[str], lexicon: Lexicon | Vocabulary, countries: DataFrame, allowed: list[str]
) -> DataFrame:
    """Add ``rejected``: the first reason that applies, null for a link to keep.

    Hard off-scope terms that are the purpose's own don't reject.

    The country test is the only one that joins, and it sees only what the cheaper tests left.
    """
    url = F.col("url")
    links, phrases = attach(links, keys, lexicon, link_probes())
    cheap = F.coalesce(
        F.when(is_archived(url, phrases.tokens("archive")), "archived"),
        F.when(is_boilerplate(url, phrases.tokens("boilerplate")), "site furniture"),
        F.concat(
            F.lit("for another audience: "),
            wrong_audience(F.col("text"), F.col("heading"), url, phrases.hard_off(F.col("purpose"))),
        ),
    )
    judged = links.withColumn("_cheap", cheap)
    foreign = foreign_country(judged.filter(F.col("_cheap").isNull()), keys, countries, allowed)
    return (
        judged.join(foreign, keys, "left")
        .withColumn(
            "rejected",
            F.coalesce("_cheap", F.concat(F.lit("about another country: "), F.col("foreign"))),
        )
        .drop("_cheap", "foreign", HELD)
    )


def mission_in_path(url: Column, markers: list[str]) -> Column:
    """What follows a mission marker in the path: first segment, then first marker."""
    prefixes = tx.texts(markers)

    def post(segment: Column) -> Column:
        hits = F.filter(
            prefixes,
            lambda m: F.startswith(segment, F.concat(m, F.lit("-")))
            | F.startswith(segment, F.concat(m, F.lit("_"))),
        )
        first = F.get(hits, F.lit(0))
        return segment.substr(F.length(first) + 2, F.length(segment))

    posts = F.filter(F.transform(urls.segments(url), post), lambda p: p.isNotNull())
    return F.get(posts, F.lit(0))


def mission_affinity(url: Column, mission_labels: Column, markers: list[str]) -> Column:
    """``own``, ``other`` or null: the post a page belongs to, against the residence's labels."""
    labels = F.transform(mission_labels, F.lower)
    by_host = F.arrays_overlap(F.split(urls.host(url), r"\."), labels)
    post = F.lower(mission_in_path(url, markers))
    named = F.array_contains(labels, post) | F.arrays_overlap(F.split(post, "-"), labels)
    return F.when(by_host, "own").when(post.isNull(), None).when(named, "own").otherwise("other")


def resolve_country(requests: DataFrame, countries: DataFrame, asked: str = "asked") -> DataFrame:
    """Code for a request that names a country by code, slug, name or synonym, in that order.

    Unknown names keep a row with a null code.
    """
    alias = F.array(
        F.struct(F.lit(0).alias("rule"), F.lower("code").alias("alias")),
        F.struct(F.lit(1).alias("rule"), tx.slug(F.col("name"), 64, "-").alias("alias")),
        F.struct(F.lit(2).alias("rule"), F.lower("name").alias("alias")),
    )
    synonyms = F.transform(
        "synonyms", lambda s: F.struct(F.lit(3).alias("rule"), F.lower(s).alias("alias"))
    )
    listed = countries.select("code", "seq", F.inline(F.concat(alias, synonyms)))
    best = listed.groupBy("alias").agg(F.min_by("code", F.struct("rule", "seq")).alias("code"))
    return requests.withColumn("alias", F.lower(urls.strip(asked))).join(best, "alias", "left").drop("alias")


def resolve_requests(requests: DataFrame, configured: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``resolved_by`` (configured or registry) and ``refused``, the reason when a request can't be resolved.

    ``requests``: destination, nationality (null: unknown). ``configured`` and ``registry``: destination.
    A configured destination comes first, the registry stands in for the rest.
    """
    own = configured.select("destination").distinct().withColumn("_configured", F.lit(True))
    listed = registry.select("destination").distinct().withColumn("_listed", F.lit(True))
    found = F.when(F.col("_configured"), "configured").when(F.col("_listed"), "registry")
    refused = (
        F.when(F.col("nationality").isNull(), "unknown country")
        .when(F.col("destination") == F.col("nationality"), "destination is the own country")
        .when(found.isNull(), "the country is not in the registry")
    )
    return (
        requests.join(own, "destination", "left")
        .join(listed, "destination", "left")
        .withColumn("refused", refused)
        .withColumn("resolved_by", F.when(F.col("refused").isNull(), found))
        .drop("_configured", "_listed")
    )
