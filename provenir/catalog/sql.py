"""Pieces of the check SQL."""

from __future__ import annotations

import html.entities

from provenir.params import SUFFIX_MARKERS

SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
TAG = r"(?s)<!--.*?-->|<[A-Za-z/!?][^>]*>"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(items) -> str:
    return ", ".join(q(i) for i in items)


def part(url: str, n: int) -> str:
    return f"regexp_extract({url}, {q(SPLIT)}, {n})"


def host(url: str) -> str:
    return (
        f"rtrim(regexp_replace(regexp_replace(lower({part(url, 3)}), '^[^@]*@', ''), "
        f"':[0-9]*$', ''), '.')"
    )


def registrable(h: str) -> str:
    labels = f"string_split(trim(lower({h}), '.'), '.')"
    return (
        f"CASE WHEN len({labels}) <= 2 THEN array_to_string({labels}, '.') "
        f"WHEN {labels}[-2] IN ({strings(SUFFIX_MARKERS)}) OR {labels}[-2] = '' OR {labels}[-1] = '' "
        f"THEN array_to_string({labels}[-3:], '.') "
        f"ELSE array_to_string({labels}[-2:], '.') END"
    )


def decode(x: str) -> str:
    return (
        f"replace(replace(replace(replace({x}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), "
        f"'&amp;', '&')"
    )


def decode_all(x: str) -> str:
    """Every named (HTML 4) and numeric reference, also one that no semicolon ends."""
    known = sorted(html.entities.name2codepoint.items()) + [("apos", 39)]
    names = f"map([{strings(name for name, _ in known)}], [{strings(chr(point) for _, point in known)}])"
    body = "regexp_replace(c, '^&|;$', '', 'g')"
    decimal, hexa = f"regexp_extract({body}, '^#([0-9]{{1,7}})$', 1)", f"regexp_extract({body}, '^#[xX]([0-9A-Fa-f]{{1,6}})$', 1)"

    def char(number: str) -> str:
        good = f"({number}) BETWEEN 1 AND 55295 OR ({number}) BETWEEN 57344 AND 1114111"
        return f"chr((CASE WHEN {good} THEN {number} ELSE 65533 END)::INTEGER)"

    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '&#?[A-Za-z0-9]+;?|[^&]+|&'), lambda c: "
        f"CASE WHEN NOT starts_with(c, '&') THEN c WHEN {decimal} <> '' THEN {char(f'TRY_CAST({decimal} AS BIGINT)')} "
        f"WHEN {hexa} <> '' THEN {char(f"TRY_CAST('0x' || {hexa} AS BIGINT)")} ELSE coalesce({names}[{body}], c) END), '')"
    )


def inner_text(x: str, decode=decode) -> str:
    bare = f"regexp_replace({x}, {q(TAG)}, ' ', 'g')"
    return f"trim(regexp_replace({decode(bare)}, '\\s+', ' ', 'g'))"


def page_title(html: str, decode=decode) -> str:
    h1 = inner_text(f"regexp_extract({html}, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1)", decode)
    t = inner_text(f"regexp_extract({html}, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)", decode)
    return f"substring(CASE WHEN {h1} <> '' THEN {h1} ELSE {t} END, 1, 200)"


def segments(url: str) -> str:
    return f"list_filter(string_split(lower({part(url, 4)}), '/'), lambda s: s <> '')"


PAGES = (
    "p AS (SELECT page_id, regexp_replace(url, '\\.example\\.(com|net|org)', '.\\1') AS url, html "
    "FROM pages)"
)


def lang(url: str) -> str:
    return f"regexp_extract({url}, '^https?://[^/]*/([a-z]{{2}})/', 1)"


def lang_seq(x: str) -> str:
    return f"list_position(['de', 'en', 'es', 'fr'], {x})"


def values(rows, columns: str) -> str:
    def cell(v):
        if isinstance(v, str):
            return q(v)
        if isinstance(v, list):
            return "[" + strings(v) + "]"
        return "NULL" if v is None else str(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({columns})"


def case(value: str, mapping: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {value} = {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"


def escape_path(x: str) -> str:
    """Percent-encode what a path cannot carry."""
    safe = "^[!$-;=@-_a-z|~]"
    pieces = f"regexp_extract_all({x}, '(?s)[!$-;=@-_a-z|~]+|.')"
    return (
        f"array_to_string(list_transform({pieces}, lambda c: CASE WHEN regexp_matches(c, {q(safe)}) "
        f"THEN c ELSE url_encode(c) END), '')"
    )


# The links of every page: regex semantics, heading carried forward, first occurrence kept.
def links(decode=decode) -> str:
    return (
        PAGES
        + r""",
tok0 AS (
  SELECT page_id, url, html,
         regexp_extract_all(html, '(?is)<h[1-3]\b[^>]*>.*?</h[1-3]\s*>|<a\b[^>]*>.*?</a\s*>') AS toks
  FROM p),
tok AS (
  SELECT page_id, url AS src_page, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM tok0),
tok2 AS (
  SELECT *, CASE WHEN regexp_matches(tok, '(?is)^<h') THEN substring("""
        + inner_text("regexp_replace(tok, '(?is)^<h[1-3][^>]*>(.*)</h[1-3]\\s*>$', '\\1')", decode)
        + r""", 1, 300) END AS h,
  CASE WHEN regexp_matches(tok, '(?is)^<a') THEN """
        + decode("regexp_extract(tok, '(?is)\\bhref\\s*=\\s*\"([^\"]*)\"', 1)")
        + r""" END AS href FROM tok),
tok3 AS (
  SELECT page_id, src_page, i, tok, href,
         coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS heading FROM tok2),
lnk0 AS (
  SELECT page_id, src_page, i, heading, """
        + part("src_page", 1)
        + " || '://' || lower("
        + part("src_page", 3)
        + ") || CASE WHEN "
        + escape_path("href")
        + " = '/' THEN '/' ELSE rtrim("
        + escape_path("href")
        + r""", '/') END AS url, substring("""
        + inner_text("regexp_replace(tok, '(?is)^<a[^>]*>(.*)</a\\s*>$', '\\1')", decode)
        + r""", 1, 300) AS text
  FROM tok3 WHERE href LIKE '/%'),
lnk1 AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY i) AS rn FROM lnk0),
lnk AS (
  SELECT page_id, src_page, url, text, heading,
         row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos
  FROM lnk1 WHERE rn = 1)"""
    )


LINKS = links()
