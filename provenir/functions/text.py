"""Text expressions: phrases, words, titles, entities, placeholder lines."""

from __future__ import annotations

import html.entities
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenir.functions.urls import let, strip
from provenir.params import LIMITS

WORD_EDGE = r"[^\p{L}\p{N}_]"


def texts(items: list[str]) -> Column:
    """An array literal of any length as one expression (folded to a constant by the optimizer)."""
    if not items:
        return F.array().cast("array<string>")
    return F.split(F.lit("\x01".join(items)), "\x01")


def rows(items: list[dict], schema: str) -> Column:
    """An array of structs as one expression (folded to a constant by the optimizer)."""
    return F.from_json(F.lit(json.dumps(items)), f"array<struct<{schema}>>")


def contains_phrase(text: Column, phrase: Column) -> Column:
    return F.contains(F.lower(text), F.lower(phrase))


def contains_word(text: Column, phrase: str) -> Column:
    """The phrase stands as whole words in the text, any case."""
    escaped = re.sub(r"([^\w\s])", r"\\\1", phrase.lower())
    return F.lower(text).rlike(f"(^|{WORD_EDGE}){escaped}($|{WORD_EDGE})")


def words(text: Column) -> Column:
    """Lower-case word tokens: maximal runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def matching(text: Column, phrases: list[str] | Column) -> Column:
    """The listed phrases the (already lower-case) text contains, in listed order.

    A list becomes a literal; a column holds the lower-case phrases of its row.
    """
    listed = phrases if isinstance(phrases, Column) else texts([p.lower() for p in phrases])
    return let(text, lambda t: F.filter(listed, lambda p: F.contains(t, p)))


def first_matching(text: Column, phrases: list[str] | Column) -> Column:
    return F.get(matching(text, phrases), F.lit(0))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column, cut: int = 24, joint: str = "_") -> Column:
    cleaned = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", joint), F.lit(joint))
    return F.trim(F.substring(cleaned, 1, cut), F.lit(joint))


def clean_title(
    raw: Column, fallback: Column, maximum: int | None = LIMITS.title, marks: tuple[str, ...] = ("|", "—", " - ")
) -> Column:
    """Drop the site name that follows the first of the separators ``marks``, when the head can stand.

    Longer than ``maximum`` characters it is cut; None keeps it whole.
    """
    title = collapse_spaces(raw)
    chosen = title
    for mark in reversed(marks):
        head = strip(F.substring_index(title, mark, 1))
        chosen = F.when(title.contains(mark) & (F.length(head) >= 8), head).otherwise(chosen)
    cut = chosen if maximum is None else F.substring(chosen, 1, maximum)
    return F.when(F.coalesce(title, F.lit("")) == "", fallback).otherwise(
        F.when(cut == "", fallback).otherwise(cut)
    )


def tidy_step_title(text: Column) -> Column:
    """Trim punctuation that means a sentence was still going."""
    trimmed = strip(text)
    tidy = strip(F.rtrim(trimmed, F.lit(",;:")))
    return F.coalesce(F.nullif(tidy, F.lit("")), trimmed)


def decode_entities(text: Column) -> Column:
    """Named (HTML 4 set, taken from the standard library) and numeric character references."""
    known = sorted(html.entities.name2codepoint.items()) + [("apos", 39)]
    named = F.map_from_arrays(
        texts([name for name, _ in known]), texts([chr(point) for _, point in known])
    )

    def code_point(number: Column) -> Column:
        # UTF-32 bytes of the number, four bytes per character; what is no character is U+FFFD.
        good = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        point = F.when(good, number).otherwise(F.lit(0xFFFD).cast("bigint"))
        return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")

    def piece(p: Column) -> Column:
        body = F.regexp_replace(p, "^&|;$", "")
        decimal = F.regexp_extract(body, "^#([0-9]{1,7})$", 1)
        hexa = F.regexp_extract(body, "^#[xX]([0-9A-Fa-f]{1,6})$", 1)
        return (
            F.when(~p.startswith("&"), p)
            .when(decimal != "", code_point(F.nullif(decimal, F.lit("")).cast("bigint")))
            .when(hexa != "", code_point(F.conv(F.nullif(hexa, F.lit("")), 16, 10).cast("bigint")))
            .otherwise(F.coalesce(named[body], p))
        )

    pieces = F.regexp_extract_all(text, F.lit("&#?[A-Za-z0-9]+;?|[^&]+|&"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def decode_named(text: Column, names: dict[str, str]) -> Column:
    """Only the listed references, each ended by its semicolon; ``&amp;`` last, so that nothing is decoded twice."""
    for name in sorted(names, key=lambda n: n == "amp"):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(names[name]))
    return text


def plain_lines(text: Column) -> Column:
    """Trimmed, non-blank lines."""
    return F.filter(
        F.transform(F.split(text, r"\r\n|\r|\n"), strip),
        lambda line: line != "",
    )


def is_placeholder_line(line: Column) -> Column:
    """What ``PLACEHOLDER_LINE`` matches, without groups that repeat: Java's matcher recurses into
    those, and a line of some thousand parts overflows its stack."""
    joined = (
        F.rlike(line, F.lit(r"\A[a-z][a-z0-9]*[.\-_][a-z0-9\-]"))
        & ~F.rlike(line, F.lit(r"[^a-z0-9.\-_]"))
        & ~F.rlike(line, F.lit(r"[._]([._]|\z)"))
    )
    return joined | F.rlike(line, F.lit(r"\A[a-z]+[A-Z][A-Za-z0-9]*\z"))


def looks_untranslated(text: Column) -> Column:
    """At least four lines, at least four of them translation keys, and at least half of all."""

    def judge(lines: Column) -> Column:
        keys = F.size(F.filter(lines, is_placeholder_line))
        return (F.size(lines) >= 4) & (keys >= 4) & (keys * 2 >= F.size(lines))

    return let(plain_lines(text), judge)


def thin_reason(text: Column, floor: int = LIMITS.readable_text) -> Column:
    """Why a page's text cannot serve as evidence, or null."""
    return F.when(F.length(text) < floor, "too little readable text").when(
        looks_untranslated(text), "translation placeholders instead of text"
    )
