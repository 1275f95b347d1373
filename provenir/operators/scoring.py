"""Role scores of links and page texts.

Scores of one row are computed inside the row from the phrases of the vocabulary and come out long: one
row per (keys, role) with its score and the signals that made it. The vocabulary is a ``Lexicon``, whose
phrases are constants, or a ``Vocabulary`` of tables, whose phrases in a row are found by an index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions import text as tx
from provenir.functions import urls
from provenir.functions.urls import let
from provenir.operators.vocabulary import Constant, Held, Vocabulary, attach, link_probes
from provenir.params import MISSION_ROLES, Lexicon, Weights

_SCORED = "array<struct<role:string,score:double,signals:array<string>>>"
_TEXTS = "array<string>"


def _signed(value: float) -> str:
    return f"{value:+g}"


def _some(items: list[Column]) -> Column:
    """Array of the non-null ones."""
    return F.array_compact(F.array(*items)) if items else F.array().cast(_TEXTS)


def _link_base(phrases: Constant | Held, w: Weights, ctx: Column) -> Column:
    """Per role the sum of its weighted phrase hits, in listed order, with their signals."""

    def in_url(t):
        return F.contains(ctx["u"], t["p"])

    def in_label(t):
        return (ctx["label"] != "") & F.contains(ctx["label"], t["p"])

    def in_heading(t):
        return (ctx["heading"] != "") & F.contains(ctx["heading"], t["p"])

    def hits_of(t: Column) -> Column:
        points = F.when(in_url(t), t["w"]).otherwise(0.0) + F.when(
            in_label(t), t["w"] * w.link_text
        ).when(in_heading(t), t["w"] * w.heading).otherwise(0.0)
        reasons = F.array_compact(
            F.array(
                F.when(in_url(t), F.concat(F.lit("url:"), t["p"], F.lit("+"), t["plain"])),
                F.when(in_label(t), F.concat(F.lit("text:"), t["p"], F.lit("+"), t["text"])).when(
                    in_heading(t), F.concat(F.lit("heading:"), t["p"], F.lit("+"), t["head"])
                ),
            )
        )
        return F.struct(points.alias("points"), reasons.alias("reasons"))

    def total(entry: Column, hits: Column) -> Column:
        return F.struct(
            entry["role"].alias("role"),
            F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + h["points"]).alias("score"),
            F.flatten(F.transform(hits, lambda h: h["reasons"])).alias("signals"),
        )

    scored = F.transform(
        phrases.terms(),
        lambda entry: let(F.transform(entry["terms"], hits_of), lambda hits: total(entry, hits)),
    )
    return F.filter(scored.cast(_SCORED), lambda r: r["score"] != 0)


def _add(rows: Column, roles: list[str], when: Column, points, signal) -> Column:
    """Add points and a signal to the listed roles of the array (all roles when empty)."""

    def one(r: Column) -> Column:
        hit = when & (r["role"].isin(roles) if roles else F.lit(True))
        return F.struct(
            r["role"].alias("role"),
            F.when(hit, r["score"] + points).otherwise(r["score"]).alias("score"),
            F.when(hit, F.array_append(r["signals"], signal)).otherwise(r["signals"]).alias("signals"),
        )

    return F.transform(rows, one)


def _single(role: str, score: float, signal: Column) -> Column:
    return F.struct(
        F.lit(role).alias("role"), F.lit(score).alias("score"), F.array(signal).alias("signals")
    )


def score_links(links: DataFrame, keys: list[str], lexicon: Lexicon | Vocabulary) -> DataFrame:
    """Score every link for every role.

    ``links``: keys, url, text, heading, depth, purpose, nationality, describes_nationality
    (boolean), affinity (own/other/null), each of the last two made by a join of its own.
    """
    w = lexicon.weights
    url = F.col("url")
    links, phrases = attach(links, keys, lexicon, link_probes())
    context = F.struct(
        urls.searchable(url).alias("u"),
        F.lower(urls.strip(F.col("text"))).alias("label"),
        F.lower(urls.strip(F.col("heading"))).alias("heading"),
        urls.strip(F.concat_ws(" ", F.lower(urls.strip(F.col("text"))), F.lower(urls.strip(F.col("heading"))))).alias("anchor"),
    )

    def first_hit(ctx: Column, listed: Column) -> Column:
        """First phrase in the URL or in the anchor, in listed order."""
        found = F.filter(listed, lambda p: F.contains(ctx["u"], p) | F.contains(ctx["anchor"], p))
        return F.get(found, F.lit(0))

    def build(ctx: Column) -> Column:
        purpose = F.col("purpose")
        base = _link_base(phrases, w, ctx)
        topic = F.contains(ctx["u"], F.lit(lexicon.topic_word)) | F.contains(
            ctx["anchor"], F.lit(lexicon.topic_word)
        )
        decision = lexicon.roles[0]
        topic_signal = F.lit(f"mentions-{lexicon.topic_word}+{w.base_topic:g}")

        def with_topic(rows: Column) -> Column:
            alone = F.array(_single(decision, w.base_topic, topic_signal)).cast(_SCORED)
            return F.when(topic & (F.size(rows) == 0), alone).otherwise(
                _add(rows, [decision], topic, w.base_topic, topic_signal)
            )

        label_hit = (ctx["label"] != "") & (F.size(tx.matching(ctx["label"], phrases.own(purpose))) > 0)

        def with_purpose_label(rows: Column) -> Column:
            signal = F.concat(F.lit("purpose-label:"), purpose, F.lit(f"+{w.base_purpose:g}"))
            fresh = F.array(*[_single(r, w.base_purpose, signal) for r in MISSION_ROLES]).cast(_SCORED)
            have = F.transform(rows, lambda r: r["role"])
            absent = F.filter(fresh, lambda r: ~F.array_contains(have, r["role"]))
            return F.when(label_hit, F.concat(rows, absent)).otherwise(rows)

        own_hit = first_hit(ctx, phrases.own(purpose))
        off_hit = first_hit(ctx, phrases.off(purpose))
        form_hit = first_hit(ctx, phrases.phrases("form"))
        language_hit = tx.first_matching(ctx["anchor"], phrases.phrases("language"))
        parts = urls.segments(url)
        last = F.coalesce(F.element_at(F.concat(F.array(F.lit("")), parts), -1), F.lit(""))
        stem = F.regexp_replace(last, r"\.[^.]*$", "")
        depth = F.coalesce("depth", F.lit(0))
        shared = [
            (F.col("describes_nationality"), F.lit(w.nationality),
             F.concat(F.lit("nationality:"), F.col("nationality"), F.lit(f"+{w.nationality:g}"))),
            (own_hit.isNotNull(), F.lit(w.purpose),
             F.concat(F.lit("purpose:"), purpose, F.lit(f"+{w.purpose:g}"))),
            (off_hit.isNotNull(), F.lit(w.off_scope),
             F.concat(F.lit("off-scope:"), off_hit, F.lit(f"{w.off_scope:g}"))),
            (form_hit.isNotNull(), F.lit(w.form),
             F.concat(F.lit("form:"), form_hit, F.lit(f"{w.form:g}"))),
            (language_hit.isNotNull(), F.lit(w.language),
             F.concat(F.lit("translation:"), language_hit, F.lit(f"{w.language:g}"))),
            (F.array_contains(phrases.tokens("index_stem"), stem),
             F.lit(w.index_page), F.lit(f"section-index{w.index_page:g}")),
            (F.size(parts) <= 4, F.lit(w.shallow), F.lit(f"shallow+{w.shallow:g}")),
            (depth > 0, depth * F.lit(w.depth),
             F.concat(F.lit("depth"), depth.cast("string"), (depth * F.lit(w.depth)).cast("int").cast("string"))),
        ]

        def with_shared(rows: Column) -> Column:
            points = sum((F.when(hit, p).otherwise(0.0) for hit, p, _ in shared), F.lit(0.0))
            reasons = F.array_compact(F.array(*[F.when(hit, s) for hit, _, s in shared]))
            both = F.struct(points.alias("points"), reasons.alias("reasons"))
            return let(
                both,
                lambda extra: F.transform(
                    rows,
                    lambda r: F.struct(
                        r["role"].alias("role"),
                        (r["score"] + extra["points"]).alias("score"),
                        F.concat(r["signals"], extra["reasons"]).alias("signals"),
                    ),
                ),
            )

        def with_mission(rows: Column) -> Column:
            own = _add(rows, MISSION_ROLES, F.col("affinity") == "own", w.own_mission,
                       F.lit(f"mission{_signed(w.own_mission)}"))
            other = _add(own, MISSION_ROLES, F.col("affinity") == "other", w.other_mission,
                         F.lit(f"other-mission{_signed(w.other_mission)}"))
            return _add(other, MISSION_ROLES[:1], urls.is_pdf(url), w.pdf_checklist,
                        F.lit(f"pdf+{w.pdf_checklist:g}"))

        topical = let(let(base, with_topic), with_purpose_label)
        return let(
            topical, lambda rows: F.when(F.size(rows) > 0, let(with_shared(rows), with_mission))
        )

    return links.select(*keys, F.inline(let(context, build)))


def document_nouns(haystack: Column, lexicon: Lexicon) -> Column:
    """The distinct document nouns a (lower-case) text names, in listed order."""
    return tx.matching(haystack, lexicon.document_nouns)


def score_bodies(pages: DataFrame, keys: list[str], lexicon: Lexicon | Vocabulary) -> DataFrame:
    """Score every page text for every role.

    ``pages``: keys, url, title, content, purpose, nationality, nationality_tokens.
    """
    w = lexicon.weights
    pages, phrases = attach(pages, keys, lexicon, [F.lower(F.concat_ws("\n", "title", "content"))])
    context = F.struct(
        F.lower(F.concat_ws("\n", "title", "content")).alias("hay"),
        F.lower(F.concat_ws("\n", F.col("title"), urls.searchable(F.col("url")))).alias("identity"),
        F.lower("title").alias("title"),
    )

    def strongest(entry: Column, found: Column) -> Column:
        best = F.get(found, F.lit(0))
        more = F.size(found) - 1
        signals = F.array_compact(
            F.array(
                F.concat(F.lit("body:"), best["p"], F.lit("+"), best["plain"]),
                F.when(more > 0, F.format_string("(%d more phrasings, not added)", more)),
            )
        )
        return F.when(
            F.size(found) > 0,
            F.struct(
                entry["role"].alias("role"), best["w"].alias("score"), signals.alias("signals")
            ),
        )

    def base_of(ctx: Column) -> Column:
        scored = F.transform(
            phrases.terms(heaviest_first=True),
            lambda entry: let(
                F.filter(entry["terms"], lambda t: F.contains(ctx["hay"], t["p"])),
                lambda found: strongest(entry, found),
            ),
        )
        return F.array_compact(scored.cast(_SCORED))

    checklist = MISSION_ROLES[0]

    def build(ctx: Column) -> Column:
        base = base_of(ctx)

        def with_nouns(rows: Column) -> Column:
            def add(named: Column) -> Column:
                bonus = F.least(F.size(named), F.lit(w.document_noun_cap)) * F.lit(w.document_noun)
                signal = F.format_string(
                    "names %d documents (%s)+%d",
                    F.size(named), F.array_join(F.slice(named, 1, 4), ", "), bonus.cast("int"),
                )
                enough = F.size(named) >= w.document_noun_floor
                present = F.exists(rows, lambda r: r["role"] == checklist)
                fresh = F.array(
                    F.struct(F.lit(checklist).alias("role"), bonus.alias("score"), F.array(signal).alias("signals"))
                ).cast(_SCORED)
                return F.when(enough & ~present, F.concat(rows, fresh)).otherwise(
                    _add(rows, [checklist], enough, bonus, signal)
                )

            return let(tx.matching(ctx["hay"], phrases.phrases("document_noun")), add)

        purpose = F.col("purpose")
        written_for = F.exists("nationality_tokens", lambda t: F.contains(ctx["identity"], F.lower(t)))
        own = F.size(tx.matching(ctx["hay"], phrases.own(purpose))) > 0
        off = tx.first_matching(ctx["title"], phrases.off(purpose))
        shared = [
            (written_for, w.nationality,
             F.concat(F.lit("body-nationality:"), F.col("nationality"), F.lit(f"+{w.nationality:g}"))),
            (own, w.purpose, F.concat(F.lit("body-purpose:"), purpose, F.lit(f"+{w.purpose:g}"))),
            (off.isNotNull(), w.off_scope,
             F.concat(F.lit("title-off-scope:"), off, F.lit(f"{w.off_scope:g}"))),
        ]

        def with_shared(rows: Column) -> Column:
            points = sum((F.when(hit, p).otherwise(0.0) for hit, p, _ in shared), F.lit(0.0))
            reasons = F.array_compact(F.array(*[F.when(hit, s) for hit, _, s in shared]))
            return let(
                F.struct(points.alias("points"), reasons.alias("reasons"), written_for.alias("own")),
                lambda extra: let(
                    F.transform(
                        rows,
                        lambda r: F.struct(
                            r["role"].alias("role"),
                            (r["score"] + extra["points"]).alias("score"),
                            F.concat(r["signals"], extra["reasons"]).alias("signals"),
                        ),
                    ),
                    lambda scored: damp(scored, extra["own"]),
                ),
            )

        def damp(rows: Column, own_page: Column) -> Column:
            def scale(breadth: Column) -> Column:
                factor = F.sqrt(F.lit(float(w.breadth)) / breadth)
                return F.when(
                    (breadth > w.breadth) & ~own_page,
                    F.transform(
                        rows,
                        lambda r: F.struct(
                            r["role"].alias("role"),
                            (r["score"] * factor).alias("score"),
                            F.array_append(
                                r["signals"], F.format_string("breadth:%dx%.2f", breadth, factor)
                            ).alias("signals"),
                        ),
                    ),
                ).otherwise(rows)

            return let(F.size(F.filter(rows, lambda r: r["score"] > 0)), scale)

        return let(
            let(base, with_nouns), lambda rows: F.when(F.size(rows) > 0, with_shared(rows))
        )

    return pages.select(*keys, F.inline(let(context, build)))


def combine(link: DataFrame, body: DataFrame, keys: list[str], read: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Combined score per (keys, role): the link's own, or link and body shares once it was read.

    ``read`` holds the keys of the pages whose body was scored, also those that scored nothing.
    """
    w = lexicon.weights
    both = link.select(*keys, "role", F.col("score").alias("link")).join(
        body.select(*keys, "role", F.col("score").alias("body")), [*keys, "role"], "full"
    )
    marked = both.join(read.select(*keys).distinct().withColumn("_read", F.lit(True)), keys, "left")
    zero = F.lit(0.0)
    link_score, body_score = F.coalesce("link", zero), F.coalesce("body", zero)
    mixed = F.lit(w.link_share) * link_score + F.lit(w.body_share) * body_score
    return marked.withColumn("score", F.when(F.col("_read"), mixed).otherwise(link_score)).drop("_read")


def best_role(scores: DataFrame, keys: list[str], lexicon: Lexicon) -> DataFrame:
    """(keys, role, score, runner_up): strictly best role, listed order among equals, or none."""
    place = F.array_position(F.array(*[F.lit(r) for r in lexicon.roles]), F.col("role"))
    best = F.max_by(F.struct("role", "score"), F.struct("score", -place))
    # At most one row per role is gathered here.
    ordered = F.sort_array(F.collect_list("score"), asc=False)
    rows = scores.groupBy(*keys).agg(best.alias("_b"), ordered.alias("_all"))
    positive = F.col("_b.score") > 0
    return rows.select(
        *keys,
        F.when(positive, F.col("_b.role")).otherwise("irrelevant").alias("role"),
        F.when(positive, F.col("_b.score")).otherwise(0.0).alias("score"),
        F.coalesce(
            F.get("_all", F.when(positive, F.lit(1)).otherwise(F.lit(0))), F.lit(0.0)
        ).alias("runner_up"),
    )
