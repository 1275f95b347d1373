"""Vocabularies: short ones as constants of the plan, tables of any size by an inverted index.

A ``Lexicon`` is code: a few hundred phrases that become literals, tested on every row without a join.
A ``Vocabulary`` is tables. Every phrase is posted under a rare pair of adjacent character n-grams, the
pairs in each row's texts whose n-grams are posted meet the postings in an equality join, and what was
met is verified in the row. The phrases never pass through the driver, and a row is handed only those it
contains, so the work follows the matches and not rows times phrases.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from provenir.functions import text as tx
from provenir.functions import urls
from provenir.functions.urls import let
from provenir.params import ROLES, Lexicon, Weights
from provenir.session import cut_lineage

#: Characters of an n-gram; a shorter phrase is its own.
GRAM = 4
#: Characters at a place of posted n-grams up to which texts are matched against them, not against any.
LISTED = 500
HELD = "_phrases"
_TERM = "p:string,w:double,plain:string,text:string,head:string"
_TERMS = f"array<struct<role:string,terms:array<struct<{_TERM}>>>>"
#: Lists whose tokens are compared as they stand.
EXACT = ["index_stem", "archive", "boilerplate"]


def matches_at_all_places(text: Column, pattern: str) -> Column:
    """What the pattern matches, overlapping matches too, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({pattern}))"), F.lit(1))


def grams(text: Column, size: int) -> Column:
    """The character n-grams of ``size``."""
    return matches_at_all_places(text, f".{{{size}}}")


def one_of(characters: list[str]) -> str:
    """A pattern of these characters, or of any if they are very many."""
    return "[" + "".join(rf"\x{{{ord(c):x}}}" for c in sorted(characters)) + "]" if len(characters) <= LISTED else "."


def post(phrases: DataFrame, size: int = GRAM) -> DataFrame:
    """Add ``gram`` to each row: of its phrase's n-grams the one that fewest phrases have.

    The planner takes exploded n-grams for as small as the phrases, and adaptive execution keeps a broadcast
    where giving it up costs a shuffle: counts are joined from the left, phrases by sorting.
    """
    once = phrases.select("phrase").distinct()
    by_size = F.lit(None).cast("array<string>")
    for m in range(1, size + 1):
        fits = F.length("phrase") == m if m < size else F.length("phrase") >= m
        by_size = F.when(fits, F.array_distinct(grams(F.col("phrase"), m))).otherwise(by_size)
    each = once.select("phrase", F.explode(by_size).alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("_n"))
    rarest = each.join(counts, "gram", "left").groupBy("phrase").agg(F.min_by("gram", F.struct("_n", "gram")).alias("gram"))
    return phrases.join(rarest.hint("merge"), "phrase")


def post_pairs(phrases: DataFrame, size: int = GRAM) -> DataFrame:
    """Add ``gram`` and ``tail`` to each row: of its phrase's pairs of adjacent n-grams the one of rare n-grams.

    A pair is as rare as the commoner of its n-grams; the number of n-grams is bounded by the alphabet, that of
    pairs grows with the vocabulary, so few phrases share one. A phrase too short for a pair has an empty tail.
    """
    once = phrases.select("phrase").distinct()
    phrase, size_of = F.col("phrase"), F.length("phrase")
    single = F.lit(None).cast("array<string>")
    for m in range(1, size + 1):
        single = F.when(size_of == m if m < size else size_of >= m, grams(phrase, m)).otherwise(single)
    each = once.select(F.explode(F.array_distinct(single)).alias("gram"))
    counts = cut_lineage(each.groupBy("gram").agg(F.count("*").alias("_n")))
    paired = size_of >= 2 * size
    placed = once.select("phrase", F.posexplode(F.when(paired, grams(phrase, 2 * size)).otherwise(single)).alias("_at", "_piece"))
    placed = placed.select("phrase", "_at", F.substring("_piece", 1, size).alias("gram"), F.substring("_piece", size + 1, size).alias("tail"))
    placed = placed.join(counts, "gram", "left").join(counts.select(F.col("gram").alias("tail"), F.col("_n").alias("_m")), "tail", "left")
    # Count and place in one number: combined by hashing before anything is shuffled or sorted.
    last = (1 << 24) - 1
    both = F.shiftleft(F.greatest("_n", "_m"), 24) + F.least("_at", F.lit(last))
    rarest = placed.groupBy("phrase").agg(F.min(both).alias("_first"))
    start = F.col("_first").bitwiseAND(F.lit(last)).cast("int") + 1
    rarest = rarest.select(
        "phrase", F.substring(phrase, start, F.lit(size)).alias("gram"),
        F.when(paired, F.substring(phrase, start + size, F.lit(size))).otherwise("").alias("tail"),
    )
    return phrases.join(rarest.hint("merge"), "phrase")


def met_with(pieces: DataFrame, listed: DataFrame, on: str, known: DataFrame | None = None) -> DataFrame:
    """The inner join of exploded pieces of rows with a list; ``known`` are the list's distinct pieces.

    The planner takes exploded pieces for as small as the rows they come from. Both joins have them on
    the left of a left join, which can't be broadcast; the first leaves only pieces that are listed.
    """
    known = listed.select(on).distinct() if known is None else known
    return pieces.join(known, on, "left_semi").join(listed, on, "left")


def meet(rows: DataFrame, keys: list[str], probes: list[Column], vocabulary: Vocabulary, name: str) -> DataFrame:
    """Add ``name``: the structs (``entry`` of the postings) whose phrase one of the row's probes contains, sorted.

    ``keys`` name a row and are not null.
    """
    size, patterns = vocabulary.gram, vocabulary.patterns
    probes = [F.coalesce(p, F.lit("")) for p in probes]
    listed = [matches_at_all_places(probe, pattern) for probe in probes for pattern in patterns.values()]
    every = F.array_distinct(F.concat(*listed)) if listed else F.array().cast("array<string>")
    pieces = rows.select(*keys, F.explode(every).alias("_piece")).select(
        *keys, F.substring("_piece", 1, size).alias("gram"), F.substring("_piece", size + 1, size).alias("tail")
    )
    # The n-grams alone are few beside the postings: they leave only pairs whose n-grams both are posted.
    pieces = pieces.withColumn("paired", F.col("tail") != "").join(vocabulary.posted, ["gram", "paired"], "left_semi")
    if 2 * size in patterns:
        pieces = pieces.join(vocabulary.tails, "tail", "left_semi")
    # As in ``met_with``: exploded pieces on the left of a left join are not broadcast.
    met = pieces.join(vocabulary.postings.select("gram", "tail", "entry"), ["gram", "tail"], "left")
    found = met.groupBy(*keys).agg(F.collect_list("entry").alias("_met"))
    inside = let(
        F.struct(F.col("_met").alias("met"), F.array(*probes).alias("texts")),
        lambda c: F.filter(c["met"], lambda e: F.exists(c["texts"], lambda t: F.contains(t, e["phrase"]))),
    )
    none = F.array().cast(found.schema["_met"].dataType)
    return rows.join(found, keys, "left").withColumn(name, F.coalesce(F.sort_array(inside), none)).drop("_met")


class Vocabulary:
    """A vocabulary in tables: ``terms`` and ``lists`` as in ``schemas``, of any number of rows.

    An empty or null phrase is none. Signals show points with at most four decimals.
    """

    def __init__(
        self, terms: DataFrame, lists: DataFrame, weights: Weights = Weights(), topic_word: str = "visa",
        roles: list[str] | None = None, mission_markers: list[str] | None = None, gram: int = GRAM,
    ):
        self.terms, self.lists, self.gram = terms, lists, gram
        self.weights, self.topic_word = weights, topic_word
        self.roles = list(ROLES) if roles is None else roles
        self.mission_markers = mission_markers or []

    @cached_property
    def postings(self) -> DataFrame:
        """(gram, tail, entry), written once."""
        w = self.weights
        shown = lambda x: F.regexp_replace(F.round(x, 4).cast("string"), r"\.0$", "")
        weight = F.col("weight").cast("double")
        terms = self.terms.select(
            F.lit("term").alias("list"), F.col("role_seq").cast("int").alias("place"), F.col("term_seq").cast("int").alias("seq"),
            F.lower("phrase").alias("phrase"), "role", weight.alias("w"),
            shown(weight).alias("plain"), shown(weight * w.link_text).alias("text"), shown(weight * w.heading).alias("head"),
        )
        phrase = F.when(F.col("list").isin(EXACT), F.col("token")).otherwise(F.lower("token"))
        lists = self.lists.select("list", F.lit(0).alias("place"), F.col("seq").cast("int").alias("seq"), phrase.alias("phrase"))
        every = terms.unionByName(lists, allowMissingColumns=True).filter("phrase <> ''")
        fields = ["list", "place", "seq", "phrase", "role", "w", "plain", "text", "head"]
        return cut_lineage(post_pairs(every, self.gram).select("gram", "tail", F.struct(*fields).alias("entry")), plain=True)

    @cached_property
    def posted(self) -> DataFrame:
        """The distinct n-grams, and whether another follows: few beside the postings, as a table whose size the planner knows."""
        return cut_lineage(self.postings.select("gram", (F.col("tail") != "").alias("paired")).distinct())

    @cached_property
    def tails(self) -> DataFrame:
        """The distinct n-grams that follow another, likewise."""
        return cut_lineage(self.postings.select("tail").distinct())

    @cached_property
    def patterns(self) -> dict[int, str]:
        """For each length of the posted n-grams and pairs a pattern of one: at each place the characters that stand there."""
        places = range(1, self.gram + 1)

        def at_places(rows: DataFrame, column: str, *by: Column) -> list[Row]:
            return rows.groupBy(*by).agg(*[F.collect_set(F.nullif(F.substring(column, i, F.lit(1)), F.lit(""))).alias(f"c{i}") for i in places]).collect()

        found = at_places(self.posted, "gram", F.length("gram").alias("n"), F.col("paired"))
        single = {r["n"]: "".join(one_of(r[f"c{i}"]) for i in places[: r["n"]]) for r in found if not r["paired"]}
        heads = ["".join(one_of(r[f"c{i}"]) for i in places) for r in found if r["paired"]]
        if not heads:
            return single
        after = at_places(self.tails, "tail")[0]
        tail = "".join(one_of(after[f"c{i}"]) for i in places)
        return single | {2 * self.gram: heads[0] + tail}


class Constant:
    """The phrases of a ``Lexicon``, as literals."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def tokens(self, name: str) -> Column:
        """A list as it stands."""
        lx = self.lexicon
        return tx.texts({"index_stem": lx.index_stems, "archive": lx.archive, "boilerplate": lx.boilerplate}[name])

    def phrases(self, name: str) -> Column:
        lx = self.lexicon
        return tx.texts([p.lower() for p in {"form": lx.form, "language": lx.language, "document_noun": lx.document_nouns}[name]])

    def _by_purpose(self, purpose: Column, listed) -> Column:
        """The list of the row's own purpose; of an unknown one what every purpose would leave."""
        lower = lambda name: tx.texts([p.lower() for p in listed(name)])
        out = lower("")
        for name in self.lexicon.purposes:
            out = F.when(purpose == name, lower(name)).otherwise(out)
        return out

    def own(self, purpose: Column) -> Column:
        return self._by_purpose(purpose, self.lexicon.own_terms)

    def off(self, purpose: Column) -> Column:
        return self._by_purpose(purpose, self.lexicon.off_scope_for)

    def hard_off(self, purpose: Column) -> Column:
        return self._by_purpose(purpose, self.lexicon.hard_off_scope_for)

    def terms(self, heaviest_first: bool = False) -> Column:
        """One entry per role with its terms, in listed order or the heaviest first."""
        w = self.lexicon.weights
        entries = []
        for role in self.lexicon.roles:
            terms = [(p.lower(), float(x)) for r, p, x in self.lexicon.terms if r == role]
            if heaviest_first:
                # The listed order decides among equals.
                terms.sort(key=lambda term: -term[1])
            rows = [
                {"p": p, "w": x, "plain": f"{x:g}", "text": f"{x * w.link_text:g}", "head": f"{x * w.heading:g}"}
                for p, x in terms
            ]
            entries.append({"role": role, "terms": rows})
        return tx.rows(entries, f"role:string,terms:array<struct<{_TERM}>>")


class Held:
    """The phrases that ``attach`` found in the row itself."""

    def _of(self, name: Column) -> Column:
        return F.filter(F.col(HELD), lambda e: e["list"] == name)

    def tokens(self, name: str) -> Column:
        return F.transform(self._of(F.lit(name)), lambda e: e["phrase"])

    phrases = tokens

    def own(self, purpose: Column) -> Column:
        return F.transform(self._of(F.concat(F.lit("purpose:"), purpose)), lambda e: e["phrase"])

    def _without_own(self, name: str, purpose: Column) -> Column:
        # A phrase that is also the purpose's own stands in the row's own ones, as it is in the same texts.
        return let(self.own(purpose), lambda own: F.filter(self.tokens(name), lambda p: ~F.array_contains(own, p)))

    def off(self, purpose: Column) -> Column:
        return self._without_own("off_scope", purpose)

    def hard_off(self, purpose: Column) -> Column:
        return self._without_own("hard_off_scope", purpose)

    def terms(self, heaviest_first: bool = False) -> Column:
        def term(e: Column) -> Column:
            return F.struct(e["phrase"].alias("p"), e["w"].alias("w"), e["plain"].alias("plain"), e["text"].alias("text"), e["head"].alias("head"))

        def of_role(role: Column, every: Column) -> Column:
            mine = F.filter(every, lambda e: e["role"] == role)
            if heaviest_first:
                weighed = F.transform(mine, lambda e: F.struct((-e["w"]).alias("less"), e["place"].alias("place"), e["seq"].alias("seq"), e.alias("e")))
                mine = F.transform(F.sort_array(weighed), lambda x: x["e"])
            return F.struct(role.alias("role"), F.transform(mine, term).alias("terms"))

        return let(
            self._of(F.lit("term")),
            lambda every: F.transform(F.array_distinct(F.transform(every, lambda e: e["role"])), lambda role: of_role(role, every)),
        ).cast(_TERMS)


def link_probes() -> list[Column]:
    """The texts of a link that phrases are looked for in."""
    url, text, heading = F.col("url"), F.col("text"), F.col("heading")
    label, head = F.lower(urls.strip(text)), F.lower(urls.strip(heading))
    return [
        F.lower(F.concat_ws(" ", text, heading, urls.searchable(url))),
        urls.strip(F.concat_ws(" ", label, head)),
        F.lower(urls.path(url)),
    ]


def attach(rows: DataFrame, keys: list[str], lexicon: Lexicon | Vocabulary, probes: list[Column]) -> tuple[DataFrame, Constant | Held]:
    """The rows, and where expressions over them find the phrases.

    ``probes`` are the texts that phrases are looked for in. ``keys`` name a row and are not null.
    """
    if isinstance(lexicon, Lexicon):
        return rows, Constant(lexicon)
    return meet(rows, keys, probes, lexicon, HELD), Held()
