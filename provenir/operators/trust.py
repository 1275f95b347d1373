"""Domain trust: dot-boundary joins, evidence per domain, the trust split and registry rows.

A host is within a domain when it equals it or ends with ``.domain``. Exploding the host's own
suffixes turns that into an equality join, done once per distinct host; whether the domain side is
broadcast is left to Spark's size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions import hosts, urls
from provenir.params import GOVERNMENT_HOST, LIMITS
from provenir.session import cut_lineage


def matched_hosts(df: DataFrame, host: str, domains: DataFrame, by: list[str] = ()) -> DataFrame:
    """Distinct (by, host, domain) pairs with the host within the domain."""
    by = list(by)
    suffixes = (
        df.filter(F.col(host) != "")
        .select(*by, host)
        .distinct()
        .withColumn("_suffix", F.explode(hosts.dot_suffixes(F.col(host))))
    )
    named = domains.select(
        *by, "domain", F.lower(F.trim(F.col("domain"), F.lit("."))).alias("_suffix")
    ).distinct()
    return suffixes.join(named, [*by, "_suffix"]).select(*by, host, "domain")


def _inside(df: DataFrame, host: str, domains: DataFrame, by: list[str]) -> DataFrame:
    """The distinct (by, host) inside the domains, written once, so that their size is known.

    Hosts are far fewer than rows, so the rows themselves are normally not shuffled at all, and a
    host that holds a third of them is no hot key.
    """
    pairs = matched_hosts(df, host, domains, by).select(*by, host).distinct()
    return cut_lineage(pairs)


def within(df: DataFrame, host: str, domains: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows whose host is within one of the domains."""
    return df.join(_inside(df, host, domains, list(by)), [*by, host], "left_semi")


def not_within(df: DataFrame, host: str, domains: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows whose host is within none of the domains."""
    return df.join(_inside(df, host, domains, list(by)), [*by, host], "left_anti")


def flag_within(
    df: DataFrame, host: str, domains: DataFrame, name: str, by: list[str] = ()
) -> DataFrame:
    """All rows, with a boolean column saying whether the host is within one of the domains."""
    inside = cut_lineage(
        matched_hosts(df, host, domains, by).select(*by, host).distinct().withColumn(name, F.lit(True))
    )
    return df.join(inside, [*by, host], "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(False))
    )


def trusted_domains_of(destinations: DataFrame) -> DataFrame:
    """(slug, domain) for trusted domains and appointed providers alike."""
    trusted = destinations.select("slug", F.explode("trusted_domains").alias("domain"))
    appointed = destinations.select("slug", F.explode("appointed_providers").alias("p"))
    return trusted.unionByName(appointed.select("slug", F.col("p.domain").alias("domain")))


def propose_domains(
    hits: DataFrame,
    denylist: DataFrame,
    tlds: list[str] | DataFrame,
    government: str = GOVERNMENT_HOST,
    by: list[str] = (),
    needed: int = LIMITS.queries_needed,
    needed_own: int = LIMITS.queries_needed_own,
) -> DataFrame:
    """Evidence per registrable domain, with the reason of the rejected ones.

    ``hits``: by, query, query_seq, rank, url, title. ``tlds``: the destination's own top-level
    domains, a list for one destination or a table (by, tlds) for many. The examples are the first three in
    (query_seq, rank) order; the limit is taken before the shuffle, so a domain holding a third of
    all hits sends three rows per task.
    """
    by = list(by)
    key = [*by, "domain"]
    rows = hits.withColumn("host", urls.host(F.col("url"))).filter(F.col("host") != "")
    rows = rows.withColumn("domain", hosts.registrable_domain(F.col("host")))
    rows = rows.select(*key, "host", "query", "query_seq", "rank", "url", "title")
    # Three aggregations read these narrow rows; the hits behind them are read once.
    rows = cut_lineage(flag_within(rows, "host", denylist.select("domain"), "denied"))
    seen = F.struct("query_seq", "rank")
    evidence = rows.groupBy(*key).agg(
        F.count_distinct("query").alias("corroboration"),
        F.bool_or("denied").alias("_denied"),
        F.min_by("denied", seen).alias("_denied_first"),
    )
    first = Window.partitionBy(*key).orderBy("query_seq", "rank")

    def first_three(source: DataFrame, column: str, name: str) -> DataFrame:
        kept = source.select(*key, "query_seq", "rank", column)
        kept = kept.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= 3)
        ordered = F.sort_array(F.collect_list(F.struct("_n", column)))
        return kept.groupBy(*key).agg(F.transform(ordered, lambda r: r[column]).alias(name))

    shown = first_three(rows, "url", "urls")
    titles = first_three(rows.filter(F.coalesce("title", F.lit("")) != ""), "title", "titles")
    domain = F.col("domain")
    if isinstance(tlds, DataFrame):
        evidence = evidence.join(tlds.select(*by, F.col("tlds").alias("_tlds")), by, "left")
        own_tlds = F.coalesce("_tlds", F.array().cast("array<string>"))
    else:
        own_tlds = F.array(*[F.lit(t) for t in tlds]).cast("array<string>")
    matched = hosts.matched_tlds(domain, own_tlds)
    judged = (
        evidence.withColumn("governmental", hosts.looks_governmental(domain, government))
        .withColumn("matched", matched)
        .withColumn("belongs", F.size("matched") > 0)
        .withColumn("own_government", F.col("governmental") & F.col("belongs"))
        .withColumn("independent", hosts.is_independent(F.col("matched"), government))
        .withColumn("kind", hosts.kind_hint(domain))
    )
    bar = F.when(F.col("own_government") & F.col("independent"), needed_own).otherwise(needed)
    suffix = hosts.is_bare_suffix(domain)
    few = F.format_string(
        "found by %d queries where %d have to agree", F.col("corroboration"), bar
    )
    denied = F.lit("listed as no authority")
    reason = (
        F.when(suffix & ~F.col("_denied_first"), "no site of its own but a suffix of many")
        .when(F.col("_denied"), denied)
        .when(F.col("corroboration") < bar, few)
    )
    return (
        judged.withColumn("rejected", reason)
        .drop("_denied", "_denied_first", "_tlds")
        .join(shown, key, "left")
        .join(titles, key, "left")
        .withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    )


PROPOSAL_ORDER = ["own_government", "belongs", "governmental"]


def proposal_order() -> list[Column]:
    """Own government first, then own domain, then governmental, then by evidence and name."""
    flags = [(~F.col(name)).cast("int") for name in PROPOSAL_ORDER]
    return [*flags, -F.col("corroboration"), F.col("domain")]


def split_trust(
    proposals: DataFrame, by: list[str] = (), maximum: int = LIMITS.trusted_domains
) -> DataFrame:
    """Add ``accepted`` with its place, or the reason a domain is withheld."""
    by = list(by)
    order = [F.col("kind").isNull().cast("int"), -F.col("corroboration"), F.col("domain")]
    own = proposals.filter(F.col("rejected").isNull() & F.col("own_government"))
    partition = [F.col(c) for c in by] or [F.lit(1)]
    best = (
        own.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
        .filter(F.col("place") <= maximum)
        .select(*by, "domain", "place")
    )
    marked = proposals.join(best, [*by, "domain"], "left")
    reason = (
        F.when(F.col("place").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("rejected").isNotNull(), F.col("rejected"))
        .when(F.col("own_government"), f"own government, but not among the {maximum} best")
        .when(F.col("governmental"), "governmental, but of another country")
        .when(F.col("belongs"), "own top-level domain, but not confirmable as governmental")
        .otherwise("neither governmental nor under the own top-level domain")
    )
    return marked.withColumn("accepted", F.col("place").isNotNull()).withColumn("withheld", reason)


def unconfirmable(split: DataFrame) -> DataFrame:
    """Domains under the own top-level domain that carry no governmental marker."""
    return split.filter(F.col("rejected").isNull() & F.col("belongs") & ~F.col("governmental"))


def registry_rows(split: DataFrame, reviewed: DataFrame, by: list[str]) -> DataFrame:
    """One row per country: accepted minus reviewed (in trust order), reviewed, unconfirmable.

    ``reviewed``: by, domain, evidence, seq. The accepted list is at most the cap long; the
    unconfirmable domains are de-duplicated before they are gathered.
    """
    held = reviewed.select(*by, "domain").distinct()
    open_ = split.join(held, [*by, "domain"], "left_anti")
    trusted = (
        open_.filter("accepted")
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct("place", "domain"))).alias("_t"))
        .select(*by, F.transform("_t", lambda r: r["domain"]).alias("trusted"))
    )
    doubtful = (
        unconfirmable(open_)
        .filter(~F.col("accepted"))
        .groupBy(*by)
        .agg(F.sort_array(F.collect_set("domain")).alias("unconfirmable"))
    )
    kept = reviewed.groupBy(*by).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("seq", "domain", "evidence"))),
            lambda r: F.struct(r["domain"].alias("domain"), r["evidence"].alias("evidence")),
        ).alias("reviewed")
    )
    empty = F.array().cast("array<string>")
    none = F.array().cast("array<struct<domain:string,evidence:string>>")
    return (
        split.select(*by)
        .distinct()
        .join(trusted, by, "left")
        .join(kept, by, "left")
        .join(doubtful, by, "left")
        .withColumn("trusted", F.coalesce("trusted", empty))
        .withColumn("reviewed", F.coalesce("reviewed", none))
        .withColumn("unconfirmable", F.coalesce("unconfirmable", empty))
    )


def effective_domains(maximum: int = LIMITS.trusted_domains) -> Column:
    """Reviewed domains first, then the trusted ones not reviewed, up to the cap."""
    reviewed = F.transform("reviewed", lambda r: r["domain"])
    return F.slice(F.concat(reviewed, F.array_except(F.col("trusted"), reviewed)), 1, maximum)


def pending_countries(countries: DataFrame, registry: DataFrame, rebuild: bool = False) -> DataFrame:
    """Countries a registry run has still to do."""
    return countries if rebuild else countries.join(registry, "code", "left_anti")


def merge_registry(registry: DataFrame, built: DataFrame, failed: DataFrame) -> DataFrame:
    """Newly built rows replace old ones; a country that failed keeps what it had, or stays out."""
    fresh = built.join(failed.select("code"), "code", "left_anti")
    return registry.join(fresh.select("code"), "code", "left_anti").unionByName(fresh)


def destination_domains(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Domains for a requested country, or why it is refused."""
    rows = registry.withColumn("domains", effective_domains()).select(
        "code", "domains", "unconfirmable"
    )
    joined = requests.join(rows.withColumn("_known", F.lit(True)), "code", "left")
    refusal = (
        F.when(F.col("_known").isNull(), "the country is not in the registry")
        .when((F.size("domains") == 0) & (F.size("unconfirmable") > 0), F.concat(
            F.lit("no domain could be confirmed; candidates: "), F.array_join("unconfirmable", ", ")
        ))
        .when(F.size("domains") == 0, "no domain of its own government was found")
    )
    return joined.withColumn("refused", refusal).drop("_known")


def name_authority(pages: DataFrame, sources: DataFrame, display: str = "display_name") -> DataFrame:
    """Authority and kind behind a page's host.

    ``pages``: slug, host, display name. ``sources``: slug, seq, host, authority, kind. A source on
    the same host wins, then the first source on a containing host, then a plain description.
    """
    first = F.min_by(F.struct("authority", "kind"), "seq")
    exact = sources.groupBy("slug", "host").agg(first.alias("_exact"))
    above = sources.select("slug", F.col("host").alias("domain"), "seq", "authority", "kind")
    pairs = matched_hosts(pages, "host", above, ["slug"]).join(above, ["slug", "domain"])
    wide = pairs.groupBy("slug", "host").agg(first.alias("_wide"))
    host, name = F.lower("host"), F.col(display)
    mission = host.contains("emb") | host.contains("consul")
    immigration = host.contains("immi") | host.contains("ica")
    plain = (
        F.when(mission, F.concat(name, F.lit(" mission ("), F.col("host"), F.lit(")")))
        .when(immigration, F.concat(name, F.lit(" immigration authority")))
        .otherwise(F.concat(name, F.lit(" authority ("), F.col("host"), F.lit(")")))
    )
    kind = (
        F.when(mission, "embassy_or_high_commission")
        .when(immigration, "immigration_authority")
        .otherwise("foreign_ministry")
    )
    known = cut_lineage(exact.join(wide, ["slug", "host"], "full"))
    return (
        pages.join(known, ["slug", "host"], "left")
        .withColumn("authority", F.coalesce("_exact.authority", "_wide.authority", plain))
        .withColumn("kind", F.coalesce("_exact.kind", "_wide.kind", kind))
        .drop("_exact", "_wide")
    )


def mission_hosts(sources: DataFrame, residences: DataFrame) -> DataFrame:
    """Hosts of configured sources, without ``www.``, whose first label is one of a country's labels.

    ``sources``: slug, host. ``residences``: code, host_labels.
    """
    bare = F.regexp_replace(F.lower("host"), r"^www\.", "")
    labelled = sources.withColumn("host", bare).withColumn("label", F.substring_index(bare, ".", 1))
    labels = residences.select("code", F.explode("host_labels").alias("label")).withColumn(
        "label", F.lower("label")
    )
    return labelled.join(labels, "label").select("slug", "code", "host").distinct()


def own_missions(rows: DataFrame, sources: DataFrame, residences: DataFrame, residence: str) -> DataFrame:
    """Rows (slug, host, affinity and the residence's code) with hosts of configured missions as ``own``.

    A host within a configured mission of the row's destination for its residence is the residence's own
    mission, unless its address names another one.
    """
    missions = mission_hosts(sources, residences).select("slug", F.col("code").alias(residence), F.col("host").alias("domain"))
    flagged = flag_within(rows, "host", missions, "_mission", ["slug", residence])
    return flagged.withColumn("affinity", F.coalesce("affinity", F.when(F.col("_mission"), "own"))).drop("_mission")
