"""Which page fills which role, from scores or from supplied decisions, and source identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions import text as tx
from provenir.functions import urls
from provenir.operators.ranking import first_of
from provenir.params import LIMITS, REPORTED_ROLES


def role_position(roles: list[str], role: str = "role") -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in roles]), F.col(role))


def first(items: Column, n: int | None) -> Column:
    """The first ``n`` of an array; None takes all."""
    return items if n is None else F.slice(items, 1, n)


def best_per_role(scores: DataFrame, by: list[str], minimum: float = LIMITS.role_score) -> DataFrame:
    """One page per role: the best score of at least the minimum, URL breaking ties."""
    good = scores.filter((F.col("score") >= minimum) & (F.col("score") > 0))
    return first_of(good, [*by, "role"], [-F.col("score"), F.col("url")])


def assign_roles(
    scores: DataFrame,
    by: list[str],
    roles: list[str],
    minimum: float = LIMITS.role_score,
    signals: int | None = 6,
) -> DataFrame:
    """(by, url, roles, score, signals, signals_found): pages that won roles, in role order.

    ``signals`` are the first so many, None keeps all; ``signals_found`` counts them before the cut. A page may win several roles; at most one row per role is gathered. ``scores`` carries the
    link signals of (by, url, role).
    """
    won = best_per_role(scores, by, minimum).withColumn("_seq", role_position(roles))
    row = F.sort_array(F.collect_list(F.struct("_seq", "role", "signals")))
    found = F.array_distinct(F.flatten(F.transform("_rows", lambda r: r["signals"])))
    return (
        won.groupBy(*by, "url")
        .agg(row.alias("_rows"), F.max("score").alias("score"))
        .select(
            *by,
            "url",
            F.transform("_rows", lambda r: r["role"]).alias("roles"),
            F.round("score", 1).alias("score"),
            first(found, signals).alias("signals"),
            F.size(found).alias("signals_found"),
        )
    )


def unresolved_roles(
    corridors: DataFrame, filled: DataFrame, by: list[str], reported: list[str] = REPORTED_ROLES
) -> DataFrame:
    """(by, role, note) for every reported role no page fills."""
    asked = corridors.select(
        *by, F.explode(F.array(*[F.lit(r) for r in reported])).alias("role")
    )
    missing = asked.join(filled.select(*by, "role"), [*by, "role"], "left_anti")
    words = F.replace(F.col("role"), F.lit("_"), F.lit(" "))
    return missing.withColumn(
        "note", F.concat(F.lit("no page scored high enough to be the "), words)
    )


def validate_choices(
    choices: DataFrame, candidates: DataFrame, by: list[str], roles: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded) of supplied decisions.

    ``choices``: by, seq, role, source_id (null refuses), reason. ``candidates``: by, source_id.
    The first valid choice of a role is kept; an unknown role, an invented id and a repeat are
    discarded with the reason; a refusal is silent.
    """
    known = candidates.select(*by, "source_id").distinct().withColumn("_real", F.lit(True))
    judged = choices.join(known, [*by, "source_id"], "left")
    cause = (
        F.when(~F.coalesce(F.col("role").isin(roles), F.lit(False)), "unknown role")
        .when(F.col("source_id").isNull(), "refused")
        .when(F.col("_real").isNull(), "not a candidate")
    )
    judged = judged.withColumn("cause", cause)
    valid = judged.filter(F.col("cause").isNull())
    kept = first_of(
        valid.select(*by, "role", "seq", "source_id", urls.strip(F.col("reason")).alias("reason")),
        [*by, "role"],
        [F.col("seq")],
    )
    repeats = (
        valid.join(kept.select(*by, "role", F.col("seq").alias("_first")), [*by, "role"])
        .filter(F.col("seq") > F.col("_first"))
        .withColumn("cause", F.lit("answered more than once"))
    )
    wrong = judged.filter(F.col("cause").isNotNull() & (F.col("cause") != "refused"))
    columns = [*by, "seq", "role", "source_id", "cause"]
    return kept, wrong.select(*columns).unionByName(repeats.select(*columns))


def sources_from_choices(
    kept: DataFrame,
    candidates: DataFrame,
    by: list[str],
    roles: list[str],
    signals: int | None = 6,
    reason_length: int | None = 160,
) -> DataFrame:
    """Pages named by valid decisions, with their reasons and the date their path names.

    Signals beyond ``signals`` and reasons beyond ``reason_length`` characters are cut, None keeps
    all; ``signals_found`` counts them before the cut.
    """
    named = kept.join(candidates.select(*by, "source_id", "url"), [*by, "source_id"])
    reason = F.col("reason") if reason_length is None else F.substring("reason", 1, reason_length)
    row = F.sort_array(F.collect_list(F.struct(role_position(roles).alias("_seq"), "role", reason.alias("reason"))))
    published = urls.published_date(F.col("url"))
    dated = F.when(
        published.isNotNull(), F.array(F.concat(F.lit("published in path: "), published))
    ).otherwise(F.array().cast("array<string>"))
    reasons = F.filter(
        F.array_distinct(F.transform("_rows", lambda r: r["reason"])), lambda r: r != ""
    )
    return (
        named.groupBy(*by, "url")
        .agg(row.alias("_rows"))
        .select(
            *by,
            "url",
            F.transform("_rows", lambda r: r["role"]).alias("roles"),
            first(F.concat(dated, reasons), signals).alias("signals"),
            F.size(F.concat(dated, reasons)).alias("signals_found"),
        )
    )


def source_id_base(prefix: Column, url: Column) -> Column:
    """Readable identifier of a page, from its URL alone, before collisions are numbered."""
    host = urls.host(url)
    label = tx.slug(F.when(host == "", "src").otherwise(F.substring_index(host, ".", 1)), 16)
    parts = F.filter(F.split(urls.path(url), "/"), lambda s: s != "")
    count = F.size(parts)
    last = F.get(parts, count - 1)
    stem = tx.slug(F.regexp_replace(last, r"(.)\.[^.]*$", "$1"), 24)
    above = F.when(count > 1, tx.slug(F.get(parts, count - 2), 24)).otherwise("page")
    weak = (stem == "") | stem.rlike("^[0-9]+$")
    chosen = F.when(count == 0, "index").when(weak, above).otherwise(stem)
    lead = tx.slug(prefix, 8)
    pieces = F.array(F.when(lead == "", "dst").otherwise(lead), label, chosen)
    base = F.array_join(F.filter(pieces, lambda p: p != ""), "_")
    return F.trim(F.substring(base, 1, 48), F.lit("_"))


def source_ids(sources: DataFrame, by: list[str], prefix: Column, seq: str) -> DataFrame:
    """Add ``source_id``, unique per ``by``; collisions take ``_2``, ``_3``… in arrival order.

    ``sources`` are the pages that won roles, so a group holds at most one row per role; it is
    folded inside one row, each page taking the first name no earlier page took.
    """
    rest = [name for name in sources.columns if name not in by]
    row = F.struct(F.col(seq).alias("_seq"), F.col("_base"), F.struct(*rest).alias("_row"))
    gathered = (
        sources.withColumn("_base", source_id_base(prefix, F.col("url")))
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    )

    def name_next(taken: Column, r: Column) -> Column:
        numbered = F.transform(
            F.sequence(F.lit(2), F.size(taken) + 2),
            lambda n: F.concat(F.substring(r["_base"], 1, 44), F.lit("_"), n.cast("string")),
        )
        options = F.filter(
            F.concat(F.array(r["_base"]), numbered), lambda o: ~F.array_contains(taken, o)
        )
        return F.array_append(taken, F.get(options, F.lit(0)))

    names = F.aggregate("_rows", F.array().cast("array<string>"), name_next)
    return (
        gathered.withColumn("_names", names)
        .select(*by, F.inline(F.arrays_zip("_rows", "_names")))
        .select(*by, "_rows._row.*", F.col("_names").alias("source_id"))
    )


def corridor_results(
    corridors: DataFrame,
    sources: DataFrame,
    unresolved: DataFrame,
    blocking: DataFrame,
    by: list[str],
    load_bearing: list[str],
    counts: DataFrame,
) -> DataFrame:
    """One row per corridor, refused ones included.

    Sources are at most one per role. Blocking URLs and inaccessible pages can be many, so the row
    carries their number and the long tables stay the place to read them.
    """
    filled = sources.groupBy(*by).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles")))).alias("filled"),
        F.count("*").alias("sources"),
    )
    open_roles = unresolved.groupBy(*by).agg(
        F.array_sort(F.collect_set("role")).alias("unresolved"),
        F.array_sort(F.collect_set("note")).alias("notes"),
    )
    blocked = blocking.groupBy(*by).agg(F.count("*").alias("blocking_urls"))
    none = F.array().cast("array<string>")
    row = (
        corridors.select(*by)
        .join(filled, by, "left")
        .join(open_roles, by, "left")
        .join(blocked, by, "left")
        .join(counts, by, "left")
        .withColumn("filled", F.coalesce("filled", none))
        .withColumn("unresolved", F.coalesce("unresolved", none))
        .withColumn("notes", F.coalesce("notes", none))
        .withColumn("sources", F.coalesce("sources", F.lit(0)))
        .withColumn("blocking_urls", F.coalesce("blocking_urls", F.lit(0)))
    )
    needed = F.array(*[F.lit(r) for r in load_bearing])
    complete = F.size(F.array_except(needed, F.col("filled"))) == 0
    blocked_decision = (F.col("blocking_urls") > 0) & (F.col("sources") > 0)
    return (
        row.withColumn("usable", complete | blocked_decision)
        .withColumn(
            "decision_is_unverified",
            ~F.array_contains("filled", load_bearing[0]) & (F.col("blocking_urls") > 0),
        )
        .withColumn(
            "notes",
            F.when(F.col("usable"), F.col("notes")).otherwise(
                F.array_append("notes", F.lit("refused: a load-bearing role has no page"))
            ),
        )
    )


def decision_blocking(scores: DataFrame, settled: DataFrame, by: list[str], role: str) -> DataFrame:
    """(by, url) of candidates for the deciding role whose page is settled as refused.

    ``scores``: by, url, role, score. ``settled``: url.
    """
    deciding = scores.filter((F.col("role") == role) & (F.col("score") > 0))
    return deciding.join(settled.select("url"), "url", "left_semi").select(*by, "url").distinct()
