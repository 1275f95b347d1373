from __future__ import annotations

import random

from pyspark.sql import functions as F

from provenir.operators import lexicon as lx, scoring as sc, vocabulary as vc
from provenir.params import ROLES, Lexicon
from provenir.schemas import LEXICON_LISTS, LEXICON_TERMS

WORDS = "visa entry fee form list guide tourist student spouse passport photo route apply time é ß-x a b".split()


def lexicon_of(seed, size):
    rng = random.Random(seed)
    phrase = lambda: " ".join(rng.choices(WORDS, k=rng.randint(1, 3)))
    some = lambda k: [phrase() for _ in range(k)]
    terms = [(rng.choice(ROLES), phrase().title(), float(rng.randint(1, 60)) / 2) for _ in range(size)]
    return Lexicon(
        terms=terms, purposes={"tourism": some(3), "study": some(3)}, off_scope=some(6) + ["tourist"], hard_off_scope=some(4),
        form=some(2), language=["é", "ß-x"], index_stems=["index", "list"], archive=["a"], boilerplate=["b"], document_nouns=WORDS[:9],
    )


def tables_of(table, lexicon, **more):
    """The lexicon's tables; its roles come in the order of ``ROLES``."""
    names = {"form": lexicon.form, "language": lexicon.language, "off_scope": lexicon.off_scope, "hard_off_scope": lexicon.hard_off_scope,
             "index_stem": lexicon.index_stems, "archive": lexicon.archive, "boilerplate": lexicon.boilerplate, "document_noun": lexicon.document_nouns}
    names |= {f"purpose:{k}": v for k, v in lexicon.purposes.items()}
    terms = [(r, ROLES.index(r), i, p, w) for i, (r, p, w) in enumerate(lexicon.terms)]
    lists = [(n, i, t) for n, tokens in names.items() for i, t in enumerate(tokens)] + [("form", 99, ""), ("form", 98, None)]
    return vc.Vocabulary(table(terms, LEXICON_TERMS), table(lists, LEXICON_LISTS), **more)


def scored(df):
    return sorted((r["id"], r["role"], round(r["score"], 6), tuple(r["signals"])) for r in df.collect())


LINK = "id int, url string, text string, heading string, depth int, purpose string, nationality string, describes_nationality boolean, affinity string, applying_from string"
BODY = "id int, url string, title string, content string, purpose string, nationality string, nationality_tokens array<string>"


def links_of(seed, n):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(WORDS + ["Visa", "TOURIST", "x"], k=rng.randint(0, k)))
    rows = []
    for i in range(n):
        path = "/".join("-".join(rng.choices(WORDS[:14], k=rng.randint(1, 2))) for _ in range(rng.randint(0, 4)))
        url = f"https://g.org/{path}" + rng.choice(["", "/index.html", ".pdf", "/list"])
        rows.append((i, url, text(4), text(2), rng.randint(0, 2), rng.choice(["tourism", "study", "other", None]), "IN", rng.random() < 0.3, rng.choice(["own", "other", None]), "GB"))
    return rows


def test_tables_score_as_constants(table):
    for seed in (1, 2):
        lexicon = lexicon_of(seed, 40)
        vocabulary = tables_of(table, lexicon, gram=3 + seed)
        rows = table(links_of(seed, 120), LINK)
        assert scored(sc.score_links(rows, ["id"], vocabulary)) == scored(sc.score_links(rows, ["id"], lexicon))
        countries = table([("CN", "China", 4, ["fee form"], ["entry"], [], [])], "code string, name string, seq int, synonyms array<string>, demonyms array<string>, host_labels array<string>, mission_labels array<string>")
        reasons = [
            {r["id"]: r["rejected"] for r in lx.reject_links(rows, ["id"], v, countries, ["nationality", "applying_from"]).collect()}
            for v in (lexicon, vocabulary)
        ]
        assert reasons[0] == reasons[1] and len(set(reasons[0].values())) > 2
        rng = random.Random(seed)
        bodies = [(i, f"https://g.org/{i}", rng.choice(WORDS), " ".join(rng.choices(WORDS, k=30)), rng.choice(["tourism", None]), "IN", ["india", "g.org/1"]) for i in range(60)]
        pages = table(bodies, BODY)
        assert scored(sc.score_bodies(pages, ["id"], vocabulary)) == scored(sc.score_bodies(pages, ["id"], lexicon))


def test_a_hundred_thousand_phrases(spark, table):
    vocabulary = vc.Vocabulary(
        spark.range(100_000).select(
            F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("id") % 6 + 1).cast("int")).alias("role"), (F.col("id") % 6).cast("int").alias("role_seq"),
            F.col("id").cast("int").alias("term_seq"), F.concat(F.lit("visa rule "), F.col("id").cast("string"), F.lit(" applies")).alias("phrase"), F.lit(10.0).alias("weight"),
        ),
        table([("form", 1, "paper form")], LEXICON_LISTS),
    )
    rows = table([(i, "https://g/x", "", f"we say visa rule {i * 997} applies, and visa rule {i} only", "tourism", "IN", ["india"]) for i in range(50)], BODY)
    got = sorted((r["id"], r["role"], r["score"]) for r in sc.score_bodies(rows, ["id"], vocabulary).collect())
    assert got == [(i, ROLES[i * 997 % 6], 10.0) for i in range(50)]
    plan = vocabulary.postings
    assert plan.filter(F.length("gram") > vc.GRAM).isEmpty() and plan.count() == 100_001
    # The rarest n-gram of a phrase holds digits: no posting list grows with the vocabulary.
    assert plan.groupBy("gram").count().agg(F.max("count")).first()[0] <= 200


def test_empty_vocabularies_and_rows(table):
    empty = vc.Vocabulary(table([], LEXICON_TERMS), table([], LEXICON_LISTS))
    rows = table(links_of(3, 5) + [(9, None, None, None, None, None, None, None, None, None)], LINK)
    plain = Lexicon(terms=[])
    assert scored(sc.score_links(rows, ["id"], empty)) == scored(sc.score_links(rows, ["id"], plain))
    assert scored(sc.score_links(rows.limit(0), ["id"], tables_of(table, lexicon_of(1, 9)))) == []


def test_long_country_names_are_joined(table):
    rows = table([(0, "from Papua New Guinea."), (1, "papua new guineas"), (2, "côte d'Ivoire (new)"), (3, None)], "id int, text string")
    countries = table(
        [("PG", "Papua New Guinea", 1, [], []), ("CI", "Côte d'Ivoire", 2, ["***"], []), ("GN", "Guinea", 3, [], [])],
        "code string, name string, seq int, synonyms array<string>, demonyms array<string>",
    )
    got = {(r["id"], r["code"]) for r in lx.country_mentions(rows, ["id"], countries, url=None).collect()}
    assert got == {(0, "PG"), (0, "GN"), (2, "CI")}


def test_few_phrases_are_met_where_many_share_each_n_gram(spark, table, monkeypatch):
    terms = spark.range(100_000, 150_000).select(
        F.lit(ROLES[0]).alias("role"), F.lit(0).alias("role_seq"), F.col("id").cast("int").alias("term_seq"),
        F.concat(F.lit("rule "), F.col("id").cast("string"), F.lit(" applies")).alias("phrase"), F.lit(10.0).alias("weight"),
    )
    vocabulary = vc.Vocabulary(terms, table([("form", 1, "fee"), ("form", 2, "ß[x"), ("form", 3, "list-👍 form")], LEXICON_LISTS))
    text = "rule 123456 applies, call 1234 or 3456; 👍 list-👍 form ß[x fee"
    met = vocabulary.postings.select("gram", "tail", F.concat("gram", "tail").alias("pair"), "entry.phrase")
    met = met.filter(F.contains(F.lit(text), F.col("pair")))
    assert met.count() <= 15 and met.filter(F.contains(F.lit(text), F.col("phrase"))).count() == 4
    for most in (500, 2):
        monkeypatch.setattr(vc, "LISTED", most)
        vocabulary.__dict__.pop("patterns", None)
        rows, held = vc.attach(table([(1, text), (2, None)], "id int, text string"), ["id"], vocabulary, [F.lower("text")])
        got = {r["id"]: sorted(x["phrase"] for x in r[vc.HELD]) for r in rows.collect()}
        assert got == {1: ["fee", "list-👍 form", "rule 123456 applies", "ß[x"], 2: []}
