"""Page and text jobs. Each works inside its row: no shuffle, whatever the site's size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions import text as tx
from provenir.functions import urls
from provenir.functions.urls import let
from provenir.params import CHROME_ELEMENTS, LIMITS, MACHINE_CONTENT_TYPES

_HEADING = r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>"
_ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
_HREF = r"""(?is)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_TAG = r"(?s)<!--.*?-->|<[A-Za-z/!?][^>]*>"
_LINK_TYPE = (
    "array<struct<url:string,text:string,heading:string,depth:int,discovered_from:string,pos:int,found:int>>"
)


def inner_text(markup: Column, decode: Callable[[Column], Column] = tx.decode_entities) -> Column:
    """Text of a fragment on one line."""
    bare = F.regexp_replace(markup, _TAG, " ")
    return tx.collapse_spaces(decode(bare))


def _head(text: Column, length: int | None) -> Column:
    return text if length is None else F.substring(text, 1, length)


def page_title(
    html: Column, maximum: int | None = LIMITS.page_title, decode: Callable[[Column], Column] = tx.decode_entities
) -> Column:
    """First h1 when it has text, else the title element, else empty; None keeps the whole of it."""
    heading = inner_text(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1), decode)
    title = inner_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), decode)
    return _head(F.when(heading != "", heading).otherwise(title), maximum)


def readable_text(html: Column, maximum: int | None = None) -> Column:
    """Text without page furniture: trimmed, non-blank lines."""
    kept = html
    for element in CHROME_ELEMENTS:
        kept = F.regexp_replace(kept, rf"(?is)<{element}\b.*?</{element}\s*>", "")
    bare = tx.decode_entities(F.regexp_replace(kept, _TAG, "\n"))
    joined = F.array_join(tx.plain_lines(bare), "\n")
    return joined if maximum is None else urls.strip(F.substring(joined, 1, maximum))


def _href(attributes: Column) -> Column:
    value = F.regexp_extract(attributes, _HREF, 1)
    bare = F.regexp_replace(value, r"""^["']|["']$""", "")
    return urls.strip_invisible(urls.strip(tx.decode_entities(bare)))


def links_of(
    html: Column,
    base: Column,
    maximum: int | None = LIMITS.links_per_page,
    text_length: int | None = LIMITS.link_text,
) -> Column:
    """The links of one page in document order, each under the last heading before it.

    The page is cut before every heading; within a cut all links share that heading. The first
    occurrence of a URL stays. At most ``maximum`` links, and labels and headings of at most
    ``text_length`` characters; None takes all. ``found`` counts a page's links before the cut.
    """
    cuts = F.split(html, r"(?i)(?=<h[1-3]\b)")

    def of_cut(cut: Column) -> Column:
        heading = _head(inner_text(F.regexp_extract(cut, _HEADING, 1)), text_length)
        attributes = F.regexp_extract_all(cut, F.lit(_ANCHOR), F.lit(1))
        labels = F.regexp_extract_all(cut, F.lit(_ANCHOR), F.lit(2))
        pairs = F.arrays_zip(attributes.alias("a"), labels.alias("l"))
        listed = let(
            heading,
            lambda h: F.transform(
                pairs,
                lambda p: F.struct(
                    _href(p["a"]).alias("target"), p["l"].alias("label"), h.alias("heading")
                ),
            ),
        )
        return F.when(F.size(attributes) > 0, listed)

    found = F.flatten(F.filter(F.transform(cuts, of_cut), lambda c: c.isNotNull()))
    usable = F.filter(
        found,
        lambda r: (r["target"] != "")
        & ~F.rlike(r["target"], F.lit("^(mailto:|tel:|javascript:|#)"))
        & ~F.rlike(r["target"], F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*\s|[/?#]|$)")),
    )

    def resolved(b: Column) -> Column:
        return F.transform(
            usable,
            lambda r: F.struct(
                let(
                    urls.parts(r["target"]),
                    lambda t: urls.canonical_parts(urls.resolve_parts(b, t)),
                ).alias("url"),
                _head(inner_text(r["label"]), text_length).alias("text"),
                r["heading"].alias("heading"),
            ),
        )

    def first_of_each(rows: Column) -> Column:
        kept = let(
            F.transform(rows, lambda r: r["url"]),
            lambda listed: let(
                F.array_distinct(listed),
                lambda once: F.transform(
                    once if maximum is None else F.slice(once, 1, maximum),
                    lambda u: F.struct(
                        F.get(rows, (F.array_position(listed, u) - 1).cast("int")).alias("row"), F.size(once).alias("found")
                    ),
                ),
            ),
        )
        return F.transform(
            kept,
            lambda k, i: let(k["row"], lambda r: F.struct(
                r["url"].alias("url"),
                r["text"].alias("text"),
                r["heading"].alias("heading"),
                F.lit(0).alias("depth"),
                base.alias("discovered_from"),
                i.cast("int").alias("pos"),
                k["found"].alias("found"),
            )),
        )

    return let(let(urls.parts(base), resolved), first_of_each).cast(_LINK_TYPE)


def extract_links(
    pages: DataFrame, maximum: int | None = LIMITS.links_per_page, text_length: int | None = LIMITS.link_text
) -> DataFrame:
    """Links table of a pages table (url, html and any key columns); ``found``: links of the page before the cut."""
    keys = [name for name in pages.columns if name not in ("html", "url")]
    links = links_of(F.col("html"), F.col("url"), maximum, text_length)
    return pages.select(
        *keys, F.col("url").alias("src_page"), F.inline(links)
    )


def forward_target(html: Column, base: Column) -> Column:
    """Where a meta-refresh page forwards to, or null."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    refresh = F.filter(
        tags, lambda t: F.rlike(t, F.lit(r"""(?i)http-equiv\s*=\s*["']?\s*refresh\s*["'\s/>]"""))
    )
    first = F.get(refresh, 0)
    content = F.regexp_extract(first, r"""(?is)\bcontent\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    bare = tx.decode_entities(F.regexp_replace(content, r"""^(["'])(.*)\1$""", "$2"))
    target = urls.strip(F.regexp_extract(bare, r"""(?i)url\s*=\s*['"]?([^'";]+)""", 1))
    return F.when(F.coalesce(target, F.lit("")) != "", urls.resolve(base, target))


def is_machine_readable(content_type: Column) -> Column:
    lowered = F.lower(content_type)
    test = F.lit(False)
    for marker in MACHINE_CONTENT_TYPES:
        test = test | lowered.contains(marker)
    return test


def is_pdf_response(content_type: Column, url: Column) -> Column:
    return F.lower(content_type).contains("application/pdf") | urls.is_pdf(url)
