"""Parameter tables of the catalog's queries, chosen so that the invented prose matches them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.functions import text as tx, urls
from provenir.operators.vocabulary import Vocabulary
from provenir.params import ROLES, Lexicon
from provenir.schemas import LEXICON_LISTS, LEXICON_TERMS
from provenir.session import cut_lineage, small_table

LANGS = ["de", "en", "es", "fr"]
DENIED = [
    ("cheap-pills.com", "commercial"),
    ("casino-win.org", "commercial"),
    ("free-bets.com", "commercial"),
    ("spam-farm.org", "commercial"),
    ("ads-track.org", "commercial"),
    ("adult-x.net", "media"),
]
OWN_TLDS = ["net"]
GOVERNMENT = r"(^|\.)th[a-z]+\.net$"
TLDS_OF = {"de": ["net"], "en": ["com", "net"], "es": ["org"], "fr": ["com"]}
REVIEWED = [
    ("en", "tiontion.com", "named by the ministry's own directory", 1),
    ("fr", "ththre.com", "listed in the official journal", 1),
]
TRUSTED = ["net", "thther.org", "tionble.com"]
WORDS = [
    "that", "with", "this", "from", "tion", "sich", "nicht", "eine", "und", "der", "pour", "dans",
    "que", "les", "avec", "para", "los", "las", "con", "una", "license", "the", "ing", "ist", "des",
]
PURPOSE_OF = {"en": "tourism", "de": "business", "fr": "tourism", "es": "study"}

LEXICON = Lexicon(
    terms=[
        ("visa_decision", "the", 25.0),
        ("visa_decision", "that", 22.0),
        ("visa_decision", "der", 25.0),
        ("document_checklist", "with", 25.0),
        ("document_checklist", "this", 20.0),
        ("document_checklist", "los", 18.0),
        ("application_route", "pour", 25.0),
        ("application_route", "dans", 18.0),
        ("application_route", "from", 12.0),
        ("fees", "sich", 20.0),
        ("fees", "tion", 5.0),
        ("processing_times", "license", 30.0),
        ("general_entry", "que", 10.0),
        ("general_entry", "und", 8.0),
    ],
    topic_word="th",
    purposes={"tourism": ["an", "ou"], "business": ["er"], "study": ["las", "os"]},
    off_scope=["er", "las", "ent", "ch"],
    hard_off_scope=["was", "los", "las", "çé"],
    form=["form", "ie"],
    language=["ß", "ñ"],
    index_stems=["in", "en", "index", "the"],
    archive=["old", "is"],
    boilerplate=["privacy", "de", "on"],
    mission_markers=["la", "mission"],
    document_nouns=["that", "with", "this", "from", "pour", "dans", "sich", "eine", "para"],
    roles=list(ROLES),
)


def vocabulary(spark: SparkSession, sf: str) -> Vocabulary:
    """``LEXICON`` as tables, among two filler phrases for every part, as a large vocabulary would be."""
    names = {
        "off_scope": LEXICON.off_scope, "hard_off_scope": LEXICON.hard_off_scope, "form": LEXICON.form,
        "language": LEXICON.language, "index_stem": LEXICON.index_stems, "archive": LEXICON.archive,
        "boilerplate": LEXICON.boilerplate, "document_noun": LEXICON.document_nouns,
    } | {f"purpose:{k}": v for k, v in LEXICON.purposes.items()}
    lists = [(name, i, token) for name, tokens in names.items() for i, token in enumerate(tokens)]
    terms = [(role, ROLES.index(role), i, phrase, weight) for i, (role, phrase, weight) in enumerate(LEXICON.terms)]
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("part number "), F.col("p_partkey").cast("string"), F.lit(" of the list")).alias("phrase"),
        (F.col("p_partkey") + len(terms)).cast("int").alias("seq"),
    )
    return Vocabulary(
        small_table(spark, terms, LEXICON_TERMS).unionByName(
            parts.select(F.lit("fees").alias("role"), F.lit(3).alias("role_seq"), F.col("seq").alias("term_seq"), "phrase", F.lit(50.0).alias("weight"))
        ),
        small_table(spark, lists, LEXICON_LISTS).unionByName(parts.select(F.lit("form").alias("list"), "seq", F.col("phrase").alias("token"))),
        topic_word=LEXICON.topic_word,
        mission_markers=LEXICON.mission_markers,
    )


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages on hosts whose registrable domain is the site itself."""
    rows = table(spark, sf, "pages")
    url = F.regexp_replace("url", r"\.example\.(com|net|org)", ".$1")
    return rows.select("page_id", url.alias("url"), "html")


def lang_of(url):
    return F.regexp_extract(url, r"^https?://[^/]*/([a-z]{2})/", 1)


def lang_seq(lang):
    return F.array_position(F.array(*[F.lit(x) for x in LANGS]), lang).cast("int")


def mapped(value, mapping: dict[str, str], default: str | None = None):
    out = F.lit(default)
    for key, text in mapping.items():
        out = F.when(value == key, text).otherwise(out)
    return out


def hits(spark: SparkSession, sf: str, decode=tx.decode_entities) -> DataFrame:
    """Search hits: the language is the query, the page number the rank; ``decode`` reads the references of titles."""
    from provenir.operators.pages import page_title

    rows = pages(spark, sf)
    lang = lang_of(F.col("url"))
    # Written once: hits are a narrow table that the page markup is read for a single time.
    return cut_lineage(
        rows.select(
            lang.alias("query"),
            lang_seq(lang).alias("query_seq"),
            F.col("page_id").alias("rank"),
            "url",
            page_title(F.col("html"), decode=decode).alias("title"),
        )
    )


def denylist(spark: SparkSession) -> DataFrame:
    return small_table(spark, DENIED, "domain string, category string")


def countries(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as countries; the word of their number is a name they go by."""
    words = F.array(*[F.lit(w) for w in WORDS])
    n = F.col("n_nationkey")
    word = F.get(words, n)
    return table(spark, sf, "nation").select(
        F.concat(F.lit("N"), n.cast("string")).alias("code"),
        F.col("n_name").alias("name"),
        n.cast("int").alias("seq"),
        F.array(word, F.concat(word, F.lit(" "), F.get(words, (n + 1) % len(WORDS)))).alias("synonyms"),
        F.array(F.concat(F.lit("src"), n.cast("string"))).alias("demonyms"),
        F.array(F.concat(word, F.lit("x"))).alias("host_labels"),
        F.array(F.concat(F.lit("c"), n.cast("string"))).alias("mission_labels"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as fetched pages: source is the domain, language the corridor."""
    d = table(spark, sf, "documents")
    url = F.concat(
        F.lit("https://www."), F.col("source"), F.lit(".org/"), F.col("lang"), F.lit("/"),
        F.col("doc_id").cast("string"),
    )
    title = F.concat_ws(" ", F.lit("Page"), F.col("lang"), F.substring_index("text", "\n", 1))
    return d.select(
        "doc_id",
        url.alias("url"),
        F.col("lang").alias("corridor"),
        F.concat(F.col("source"), F.lit(".org")).alias("domain"),
        title.alias("title"),
        F.col("text").alias("content"),
        "n_chars",
        mapped(F.col("lang"), PURPOSE_OF).alias("purpose"),
        F.upper("lang").alias("nationality"),
        F.array(F.concat(F.lit("/"), F.col("lang"), F.lit("/1")), F.concat(F.lit("org "), F.col("lang"), F.lit(" 2"))).alias(
            "nationality_tokens"
        ),
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of the pages, under their page's title as heading where the page gives none."""
    from provenir.operators.pages import links_of, page_title

    rows = pages(spark, sf)
    found = rows.select(
        "page_id",
        F.col("url").alias("src_page"),
        page_title(F.col("html")).alias("page_heading"),
        lang_of(F.col("url")).alias("lang"),
        F.inline(links_of(F.col("html"), F.col("url"))),
    )
    # Written once, as a crawl would: the joins below read narrow rows, never the markup again.
    return cut_lineage(found.withColumn("host", urls.host(F.col("url"))))
