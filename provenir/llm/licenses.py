"""License scan by ordered signature rules, in DataFrame functions alone.

A text becomes words joined by single spaces. Rules run only on texts that hold their keyword. A
detection is dropped when another one of at least its priority covers its place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.license_rules import BASE, RULES, Rule

_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOUND = "array<struct<start:int,end_down:int,priority_down:int,label:string>>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bounded(pattern: str) -> str:
    return f"(?i) (?:{pattern})(?= )"


def _rules(rules: list[Rule]) -> str:
    return "array(" + ", ".join(
        f"named_struct('label', {_quoted(r.label)}, 'priority', {r.priority}, 'keyword', {_quoted(r.keyword)}, "
        f"'pattern', {_quoted(_bounded(r.pattern))})"
        for r in rules
    ) + ")"


def _detections(rules: list[Rule]) -> str:
    """Places of all matches of the rules whose keyword is there, in the order of the sweep."""
    places = f"""
        aggregate(
            sequence(1, size(x.found)),
            named_struct('at', 0, 'out', cast(array() as {_FOUND})),
            (a, i) -> named_struct(
                'at', a.at + length(x.between[i - 1]) + length(x.found[i - 1]),
                'out', concat(a.out, array(named_struct(
                    'start', a.at + length(x.between[i - 1]),
                    'end_down', - a.at - length(x.between[i - 1]) - length(x.found[i - 1]),
                    'priority_down', - r.priority,
                    'label', r.label)))),
            a -> a.out)"""
    return f"""
        array_sort(flatten(transform(
            filter({_rules(rules)}, r -> array_contains(keywords, r.keyword)),
            r -> flatten(transform(
                filter(
                    array(named_struct('found', regexp_extract_all(line, r.pattern, 0), 'between', split(line, r.pattern))),
                    x -> size(x.found) > 0),
                x -> {places})))))"""


def _sweep(top: int) -> str:
    """Labels of the detections that none before them covers at their priority or above, and the best priority."""
    return f"""
        aggregate(
            detections,
            named_struct('reach', array_repeat(0, {top + 1}), 'labels', cast(array() as array<string>), 'best', 0),
            (a, x) -> if(
                exists(sequence(- x.priority_down, {top}), p -> a.reach[p] >= - x.end_down),
                a,
                named_struct(
                    'reach', transform(sequence(0, {top}), p -> if(p = - x.priority_down, - x.end_down, a.reach[p])),
                    'labels', array_union(a.labels, array(x.label)),
                    'best', greatest(a.best, - x.priority_down))))"""


def _count(phrase: str) -> Column:
    return F.regexp_count("line", F.lit(_bounded(phrase)))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _start(phrase: str, last: bool) -> Column:
    """The word at which the first or last place of a phrase starts; null without one."""
    before = F.regexp_extract("line", f"(?is)^(.*{'' if last else '?'}) (?:{phrase})(?= )", 1)
    return F.when(_count(phrase) > 0, _spaces(before).cast("long"))


def scan(
    docs: DataFrame,
    text_col: str = "text",
    rules: list[Rule] = RULES,
    base: list[tuple[str, str]] = BASE,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``base`` are phrases whose labels always stay: ``n_base`` counts their places, ``first_word`` and
    ``last_word`` are the smallest and largest start among them, else null. ``labels`` adds those of
    the rules' detections that are not suppressed. ``score`` is the best detection's priority over the
    greatest one, 1 with a base phrase, 0 without a detection.

    A null or empty text has no words and no labels (empty strings). Each row is judged on its own:
    repeated rows and null ids stay, an empty table stays empty. Other columns are kept, those with the
    names above are replaced.
    """
    own = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    kept = [c for c in docs.columns if c not in own]
    keywords = sorted({r.keyword for r in rules} | {p.split()[0] for _, p in base})
    top = max(r.priority for r in rules)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.split(F.trim(F.regexp_replace(text, _NOT_WORD, " ")), " ")
    row = F.struct(*kept).alias("row") if kept else F.struct(F.lit(1).alias("none")).alias("row")
    read = docs.select(row, words.alias("words"))
    gated = read.select(
        "row",
        F.when(F.col("words")[0] == "", 0).otherwise(F.size("words")).cast("long").alias("n_words"),
        F.array_intersect(F.array(*map(F.lit, keywords)), F.transform("words", F.lower)).alias("keywords"),
        F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("line"),
    )
    hit = F.size("keywords") > 0
    found = gated.withColumn("detections", F.when(hit, F.expr(_detections(rules)))).withColumn(
        "kept", F.when(hit, F.expr(_sweep(top)))
    )
    per_phrase = lambda make: [make(phrase) for _, phrase in base]
    counted = found.select(
        "row",
        "n_words",
        "kept",
        F.when(hit, reduce(lambda a, b: a + b, per_phrase(_count))).otherwise(0).cast("long").alias("n_base"),
        F.when(hit, F.array_min(F.array(*per_phrase(lambda p: _start(p, False))))).alias("first_word"),
        F.when(hit, F.array_max(F.array(*per_phrase(lambda p: _start(p, True))))).alias("last_word"),
        F.when(
            hit, F.array_compact(F.array(*(F.when(_count(phrase) > 0, F.lit(label)) for label, phrase in base)))
        ).otherwise(F.array().cast("array<string>")).alias("base"),
    )
    none = F.array().cast("array<string>")
    return counted.select(
        *(F.col("row")[c].alias(c) for c in kept),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("kept.labels", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0)
        .otherwise(F.coalesce(F.col("kept.best"), F.lit(0)) / F.lit(float(top)))
        .alias("score"),
    )
