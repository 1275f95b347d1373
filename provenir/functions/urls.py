"""URL expressions. All of them stay inside the JVM; none raises on a malformed URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenir.params import (
    DATED_SEGMENT,
    FURNITURE_PATH,
    MACHINE_HOST_LABELS,
    MACHINE_SEGMENTS,
    SKIPPED_EXTENSIONS,
    TRACKING_KEYS,
)

# RFC 3986 appendix B, groups: scheme, authority (with slashes), authority, path, query.
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_HOST = (
    r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*?)\.*(?::[0-9]*)?"
    r"(?:[/?#].*)?$"
)
# Characters a URL path or query carries unescaped, as runs, or one character to be escaped.
_PIECES = r"(?s)[!$-;=@-_a-z|~]+|."


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a lambda variable is never re-inlined)."""
    return F.transform(F.array(value), body)[0]


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 3)


def path(url: Column) -> Column:
    return _part(url, 4)


def query(url: Column) -> Column:
    return _part(url, 5)


def strip_invisible(text: Column) -> Column:
    """Drop Unicode formatting characters."""
    return F.regexp_replace(text, r"\p{Cf}", "")


def _form_decode(text: Column) -> Column:
    # A percent sign that opens no escape stands for itself.
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _form_encode(text: Column) -> Column:
    return F.replace(
        F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")
    )


def canonical_query(raw: Column) -> Column:
    """Decode the pairs, drop the tracking keys, sort by key and value, encode again."""

    def pair(piece: Column) -> Column:
        at = F.instr(piece, "=")
        key = F.when(at > 0, F.substring_index(piece, "=", 1)).otherwise(piece)
        value = F.when(at > 0, F.expr("''")).otherwise(F.lit(""))
        value = F.when(at > 0, piece.substr(at + 1, F.length(piece))).otherwise(value)
        return F.struct(_form_decode(key).alias("k"), _form_decode(value).alias("v"))

    pairs = F.transform(F.filter(F.split(raw, "&"), lambda p: p != ""), pair)
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING_KEYS))
    text = F.transform(
        F.array_sort(kept),
        lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"])),
    )
    return F.array_join(text, "&")


def parts(url: Column) -> Column:
    """Scheme ``s``, authority ``h``, path ``p`` and query ``q`` from one pass over the URL."""
    marked = F.regexp_replace(url, _SPLIT, "$1\x01$3\x01$4\x01$5\x01$2")
    return let(
        F.split(marked, "\x01"),
        lambda a: F.struct(
            F.lower(F.get(a, 0)).alias("s"),
            F.get(a, 1).alias("h"),
            F.get(a, 2).alias("p"),
            F.get(a, 3).alias("q"),
            (F.get(a, 4) != "").alias("named"),
        ),
    )


def canonical_parts(raw: Column) -> Column:
    """Canonical text of already split URL parts (a struct as ``parts`` makes it)."""

    def tidy(r: Column) -> Column:
        host_ = F.lower(r["h"])
        return F.struct(
            r["s"].alias("s"),
            F.when((r["s"] == "http") & host_.endswith(":80"), F.regexp_replace(host_, ":80$", ""))
            .when(
                (r["s"] == "https") & host_.endswith(":443"), F.regexp_replace(host_, ":443$", "")
            )
            .otherwise(host_)
            .alias("h"),
            F.when(r["p"] == "", "/")
            .when((r["p"] != "/") & r["p"].endswith("/"), F.rtrim(r["p"], F.lit("/")))
            .otherwise(r["p"])
            .alias("p"),
            F.when(r["q"] == "", "").otherwise(canonical_query(r["q"])).alias("q"),
        )

    def joined(r: Column) -> Column:
        return F.concat(
            F.when(r["s"] == "", "").otherwise(F.concat(r["s"], F.lit(":"))),
            F.when(r["h"] == "", "").otherwise(F.concat(F.lit("//"), r["h"])),
            F.when((r["h"] != "") & (r["p"] != "") & ~r["p"].startswith("/"), "/").otherwise(""),
            r["p"],
            F.when(r["q"] == "", "").otherwise(F.concat(F.lit("?"), r["q"])),
        )

    return let(let(raw, tidy), joined)


def canonical_url(url: Column) -> Column:
    """One comparable form of a URL: case, ports, trailing slashes, tracking, order, fragment."""
    return canonical_parts(parts(strip_invisible(strip(url))))


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dots; empty when there is none."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def segments(url: Column) -> Column:
    """Non-empty lower-case path segments."""
    return F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")


def is_pdf(url: Column) -> Column:
    return F.lower(path(url)).endswith(".pdf")


def published_date(url: Column) -> Column:
    """The date a dated path names, ``YYYY-MM`` or ``YYYY-MM-DD``, from its first dated segment."""

    def text(segment: Column) -> Column:
        day = F.regexp_extract(segment, DATED_SEGMENT, 3)
        return F.concat_ws(
            "-",
            F.regexp_extract(segment, DATED_SEGMENT, 1),
            F.regexp_extract(segment, DATED_SEGMENT, 2),
            F.when(day != "", day),
        )

    dated = F.filter(segments(url), lambda s: F.rlike(s, F.lit(DATED_SEGMENT)))
    return F.when(F.size(dated) > 0, text(F.get(dated, 0)))


def is_machine_endpoint(url: Column) -> Column:
    """True for URLs that serve a program: by first host label or by a whole path segment."""
    named = F.array(*[F.lit(s) for s in MACHINE_SEGMENTS])
    return F.substring_index(host(url), ".", 1).isin(MACHINE_HOST_LABELS) | F.arrays_overlap(
        segments(url), named
    )


def looks_crawlable(url: Column) -> Column:
    """Everything of the crawlable test but the trust of the host, which is a join."""
    lowered = F.lower(path(url))
    extensions = "(" + "|".join(e.replace(".", r"\.") for e in SKIPPED_EXTENSIONS) + ")$"
    return (
        scheme(url).isin("http", "https")
        & ~lowered.rlike(extensions)
        & ~is_machine_endpoint(url)
        & ~lowered.rlike(FURNITURE_PATH)
    )


def searchable(url: Column) -> Column:
    """URL flattened so that phrases written with spaces can match it."""
    return F.translate(F.lower(url), "-_/.+", "     ")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def policy_path(url: Column) -> Column:
    """What a crawl-policy rule is matched against: the path with its query."""
    path_ = F.when(path(url) == "", "/").otherwise(path(url))
    return F.when(query(url) == "", path_).otherwise(F.concat(path_, F.lit("?"), query(url)))


def agent_token(agent: Column) -> Column:
    token = strip(F.substring_index(agent, "/", 1))
    return F.when(token == "", "*").otherwise(token)


def escape_unsafe(text: Column) -> Column:
    """Percent-encode what a URL path cannot carry; existing escapes stay."""
    pieces = F.transform(
        F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)),
        lambda p: F.when(F.rlike(p, F.lit("^[!$-;=@-_a-z|~]")), p).otherwise(
            F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))
        ),
    )
    return F.when(text.rlike(r"[^!$-;=@-_a-z|~]"), F.array_join(pieces, "")).otherwise(text)


def _without_dots(path_: Column) -> Column:
    """Remove ``.`` and ``..`` segments (RFC 3986, 5.2.4)."""
    parts = F.split(path_, "/")
    walked = F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(
            part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(part == ".", acc)
        .otherwise(F.array_append(acc, part)),
    )
    last = F.element_at(parts, -1)
    tail = F.when(last.isin(".", "..") & (F.size(walked) > 0), "/").otherwise("")
    cleaned = F.concat(F.lit("/"), F.array_join(walked, "/"), tail)
    return F.when(path_.rlike(r"(^|/)\.\.?(/|$)"), cleaned).otherwise(path_)


def resolve_parts(base: Column, target: Column) -> Column:
    """Resolve split target parts against split base parts (RFC 3986, 5.3), as parts."""
    own = (target["s"] != "") | target["named"]
    folder = F.regexp_replace(base["p"], r"[^/]*$", "")
    merged = F.when((base["h"] != "") & (base["p"] == ""), F.lit("/")).otherwise(folder)
    relative = (
        F.when(target["p"] == "", base["p"])
        .when(target["p"].startswith("/"), target["p"])
        .otherwise(F.concat(merged, target["p"]))
    )
    opaque = (target["s"] != "") & ~target["named"]
    path_ = let(F.when(own, target["p"]).otherwise(relative), _without_dots)
    query_ = F.when(~own & (target["p"] == "") & (target["q"] == ""), base["q"])
    return F.struct(
        F.when(target["s"] != "", target["s"]).otherwise(base["s"]).alias("s"),
        F.when(own, target["h"]).otherwise(base["h"]).alias("h"),
        F.when(opaque, target["p"]).otherwise(let(path_, escape_unsafe)).alias("p"),
        escape_unsafe(F.coalesce(query_, target["q"])).alias("q"),
    )


def resolve(base: Column, target: Column) -> Column:
    """Resolve a link target against the URL of the page it stands on."""

    def text(r: Column) -> Column:
        return F.concat(
            r["s"],
            F.lit(":"),
            F.when(r["h"] == "", "").otherwise(F.concat(F.lit("//"), r["h"])),
            r["p"],
            F.when(r["q"] == "", "").otherwise(F.concat(F.lit("?"), r["q"])),
        )

    return let(
        parts(base), lambda b: let(parts(target), lambda t: let(resolve_parts(b, t), text))
    )
