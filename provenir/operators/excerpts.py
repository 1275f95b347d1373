"""Keyword-in-context: mention windows and the budgeted excerpt, inside each page's row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions import urls
from provenir.functions.urls import let
from provenir.params import GAP_MARK, LIMITS
from provenir.session import cut_lineage

_SPANS = "array<struct<s:int,e:int>>"


def mention_pattern(terms: list[str]) -> str:
    """Whole words: longer terms in any case, terms of up to three letters in upper case only."""
    cleaned = {t.strip() for t in terms if t.strip()}
    long_ = sorted({re.escape(t.lower()) for t in cleaned if len(t) > 3})
    short = sorted({re.escape(t.upper()) for t in cleaned if len(t) <= 3})
    options = ([f"(?iu:{'|'.join(long_)})"] if long_ else []) + short
    if not options:
        return r"(?!)"
    # The look-ahead on the first letter spares most positions the costly word-boundary test.
    first = sorted({re.escape(t[0]) for t in cleaned})
    return rf"(?U)(?=(?iu:[{''.join(first)}]))\b(?:{'|'.join(options)})\b"


def _pieces(text: Column, pattern: Column, start: Column) -> Column:
    """The text from ``start`` on, cut into gap, mention, gap, mention, …, gap.

    One pass marks the mentions and a cheap split cuts at the marks. The character before the
    start only decides whether a word begins there.
    """
    before = text.substr(start, F.lit(1))
    edge = F.when(start == 0, "").when(before.rlike(r"(?U)\w"), "_").otherwise(" ")
    tail = F.replace(F.concat(edge, text.substr(start + 1, F.length(text))), F.lit("\x01"), F.lit(" "))
    return F.split(F.regexp_replace(tail, pattern, F.lit("\x01$0\x01")), "\x01")


def windows(
    text: Column,
    pattern: Column | str,
    start: Column,
    half: Column,
    first: Column,
    budget: Column | None = None,
) -> Column:
    """Spans of ``half`` around every mention from ``start`` on, merged where they touch.

    ``first`` is the span before them. With a budget no further mention is taken once the spans
    fill it; the first mention is always looked at.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    shift = F.when(start == 0, 0).otherwise(start - 1).cast("int")

    def step(acc: Column, piece: Column, length: Column) -> Column:
        at = acc["at"]
        end_of = (at + F.length(piece)).cast("int")
        s = F.greatest(at - half, F.lit(0)).cast("int")
        e = F.least(end_of + half, length).cast("int")
        last = F.element_at(acc["spans"], -1)
        grown = F.greatest(last["e"], e)
        touches = s <= last["e"]
        spans = F.when(
            touches,
            F.array_append(
                F.slice(acc["spans"], F.lit(1), F.size(acc["spans"]) - 1),
                F.struct(last["s"].alias("s"), grown.alias("e")),
            ),
        ).otherwise(F.array_append(acc["spans"], F.struct(s.alias("s"), e.alias("e"))))
        used = (acc["used"] + F.when(touches, grown - last["e"]).otherwise(e - s)).cast("int")
        full = F.lit(False) if budget is None else used >= budget
        gap = F.struct(
            end_of.alias("at"), F.lit(True).alias("hit"), acc["used"].alias("used"),
            acc["full"].alias("full"), acc["spans"].alias("spans"),
        )
        mention = F.struct(
            end_of.alias("at"), F.lit(False).alias("hit"), used.alias("used"),
            full.alias("full"), spans.alias("spans"),
        )
        return F.when(acc["full"], acc).when(acc["hit"], mention).otherwise(gap)

    begin = F.struct(
        shift.alias("at"),
        F.lit(False).alias("hit"),
        (first["e"] - first["s"]).cast("int").alias("used"),
        F.lit(False).alias("full"),
        F.array(first).cast(_SPANS).alias("spans"),
    )
    # The length is bound first: inside the fold it would be counted again at every step.
    return let(
        F.length(text),
        lambda n: F.aggregate(
            _pieces(text, pattern, start), begin, lambda acc, piece: step(acc, piece, n)
        )["spans"],
    )


def _total(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda acc, s: acc + s["e"] - s["s"])


def excerpt(text: Column, pattern: Column | str, budget: int, head: int, window: int) -> Column:
    """The head of a page, then what it says around each mention, within the budget.

    Budget the mentions leave over reads on from each span in turn. Gaps are marked.
    """
    if budget <= 0:
        return F.lit("")
    total = F.lit(budget)

    def trim(spans: Column) -> Column:
        """Cut the spans, in order, to the budget."""
        walked = F.aggregate(
            spans,
            F.struct(F.array().cast(_SPANS).alias("kept"), F.lit(0).alias("used")),
            lambda acc, s: F.when(acc["used"] >= total, acc).otherwise(
                let(
                    F.least(s["e"], s["s"] + total - acc["used"]).cast("int"),
                    lambda e: F.struct(
                        F.array_append(acc["kept"], F.struct(s["s"].alias("s"), e.alias("e"))).alias("kept"),
                        (acc["used"] + e - s["s"]).cast("int").alias("used"),
                    ),
                )
            ),
        )
        return walked["kept"]

    def grow(kept: Column, length: Column) -> Column:
        """Spend what is left, span by span, each up to the next one's start."""
        def step(acc: Column, i: Column) -> Column:
            here = F.get(kept, i)
            limit = F.coalesce(F.get(kept, i + 1)["s"], length)
            end = F.least(here["e"] + acc["left"], limit).cast("int")
            return F.struct(
                F.array_append(acc["spans"], F.struct(here["s"].alias("s"), end.alias("e"))).alias("spans"),
                (acc["left"] - (end - here["e"])).cast("int").alias("left"),
            )

        start = F.struct(F.array().cast(_SPANS).alias("spans"), (total - _total(kept)).cast("int").alias("left"))
        return F.aggregate(F.sequence(F.lit(0), F.size(kept) - 1), start, step)["spans"]

    def emit(t: Column, spans: Column, length: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["e"])
            mark = F.when(s["s"] > before, F.lit(GAP_MARK)).otherwise("")
            return F.concat(mark, t.substr(s["s"] + 1, s["e"] - s["s"]))

        end = F.when(F.element_at(spans, -1)["e"] < length, F.lit(GAP_MARK)).otherwise("")
        return F.concat(F.array_join(F.transform(spans, piece), ""), end)

    def build(t: Column, length: Column) -> Column:
        head_end = F.least(F.lit(max(min(head, budget), 0)), length).cast("int")
        half = F.lit(max(min(window, budget - max(min(head, budget), 0)) // 2, 0))
        first = F.struct(F.lit(0).alias("s"), head_end.alias("e"))
        spans = windows(t, pattern, head_end, half, first, total)
        shaped = let(let(spans, trim), lambda kept: grow(kept, length))
        return F.when(length <= budget, t).otherwise(let(shaped, lambda s: emit(t, s, length)))

    return let(text, lambda t: let(F.length(t), lambda n: build(t, n)))


def candidate_packets(
    candidates: DataFrame, corridors: DataFrame, by: list[str], roles: list[str]
) -> DataFrame:
    """One JSON text per corridor for the decider: traveller, roles, candidates without scores.

    ``candidates`` is a shortlist, so a corridor gathers at most its size. A corridor without
    candidates gets a packet without any; a null value keeps its key.
    """
    title = F.coalesce(
        F.nullif(urls.strip(F.col("title")), F.lit("")), urls.strip(F.col("text")), F.lit("")
    )
    item = F.struct(
        "place", F.col("source_id").alias("id"), title.alias("title"), "url",
        F.col("published").alias("published"), "excerpt",
    )
    listed = candidates.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    bare = F.transform(
        "_items",
        lambda r: F.struct(
            r["id"].alias("id"), r["title"].alias("title"), r["url"].alias("url"),
            r["published"].alias("published"), r["excerpt"].alias("excerpt"),
        ),
    )
    packet = F.to_json(
        F.struct(
            F.col("traveller"), F.array(*[F.lit(r) for r in roles]).alias("roles"),
            F.coalesce(bare, F.array().cast(_CANDIDATES)).alias("candidates"),
        ),
        {"ignoreNullFields": "false"},
    )
    return corridors.join(listed, by, "left").select(*by, F.coalesce(F.size("_items"), F.lit(0)).alias("candidates"), packet.alias("packet"))


_CANDIDATES = "array<struct<id:string,title:string,url:string,published:string,excerpt:string>>"
_SOURCE = ("source_id", "title", "url", "authority", "content")


def bare_type(sources: DataFrame) -> str:
    kinds = dict(sources.dtypes)
    return "array<struct<" + ",".join(f"{c}:{kinds[c]}" for c in _SOURCE) + ">>"


def research_packets(
    sources: DataFrame, requests: DataFrame, by: list[str], maximum: int
) -> DataFrame:
    """One JSON text per request: destination, traveller, sources; null with a reason when too long.

    Texts longer than ``maximum`` together are told from their summed lengths and never gathered. A
    request without sources gets a packet without any.
    """
    total = sources.groupBy(*by).agg(F.sum(F.length("content")).alias("_length"))
    total = cut_lineage(requests.select(*by).join(total, by, "left"))
    sources = sources.join(total.filter(F.col("_length") <= maximum).select(*by), by, "left_semi")
    item = F.struct("seq", "source_id", "title", "url", "authority", "content")
    listed = sources.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    bare = F.transform(
        "_items",
        lambda r: F.struct(*[r[c].alias(c) for c in _SOURCE]),
    )
    filled = F.coalesce(bare, F.array().cast(bare_type(sources))).alias("sources")
    text = F.to_json(F.struct("destination", "traveller", filled), {"ignoreNullFields": "false"})
    built = requests.join(total, by).join(listed, by, "left").withColumn("_text", text)
    long_ = (F.coalesce("_length", F.lit(0)) > maximum) | (F.length("_text") > maximum)
    return built.select(
        *by,
        F.when(~long_, F.col("_text")).alias("packet"),
        F.when(long_, f"the packet is longer than {maximum} characters").alias("rejected"),
    )


EXCERPT_DEFAULTS = (LIMITS.excerpt_budget, LIMITS.excerpt_head, LIMITS.excerpt_window)
