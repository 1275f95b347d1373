"""Host expressions: public suffixes, registrable domains, government shape, ownership."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenir.params import GOVERNMENT_HOST, KIND_HINTS, SUFFIX_MARKERS


def _labels(domain: Column) -> Column:
    return F.split(F.trim(F.lower(domain), F.lit(".")), r"\.")


def is_bare_suffix(domain: Column) -> Column:
    """Too broad to trust: one label, an empty label, or a marker directly under a TLD."""
    labels = _labels(domain)
    return (
        (F.size(labels) < 2)
        | F.array_contains(labels, "")
        | ((F.size(labels) == 2) & F.get(labels, 0).isin(SUFFIX_MARKERS))
    )


def registrable_domain(host: Column) -> Column:
    """Last two labels, or last three when the last two are themselves a suffix."""
    labels = _labels(host)
    two = F.array_join(F.slice(labels, -2, 2), ".")
    return (
        F.when(F.size(labels) <= 2, F.array_join(labels, "."))
        .when(is_bare_suffix(two), F.array_join(F.slice(labels, -3, 3), "."))
        .otherwise(two)
    )


def dot_suffixes(host: Column) -> Column:
    """The host and every parent of it, so that a suffix test becomes an equality."""
    name = F.rtrim(F.lower(host), F.lit("."))
    count = F.size(F.split(name, r"\."))
    return F.transform(
        F.sequence(F.lit(1), count),
        lambda n: F.call_function("substring_index", name, F.lit("."), -n),
    )


def looks_governmental(domain: Column, pattern: str = GOVERNMENT_HOST) -> Column:
    return domain.rlike(pattern)


def matched_tlds(domain: Column, tlds: Column) -> Column:
    """Those of the destination's own top-level domains the domain sits under, in listed order."""
    name = F.trim(F.lower(domain), F.lit("."))
    return F.filter(
        tlds, lambda t: (name == t) | name.endswith(F.concat(F.lit("."), F.trim(t, F.lit("."))))
    )


def is_independent(matched: Column, pattern: str = GOVERNMENT_HOST) -> Column:
    """Some matched top-level domain is not itself the governmental marker."""
    return F.exists(matched, lambda t: ~F.rlike(t, F.lit(pattern)))


def kind_hint(domain: Column, hints: list[tuple[str, str]] = KIND_HINTS) -> Column:
    """Kind of the first hint, in listed order, that the domain contains."""
    hint = F.lit(None).cast("string")
    for token, kind in reversed(hints):
        hint = F.when(domain.contains(token), kind).otherwise(hint)
    return hint
