"""The corpus pipeline: quality, language, near copies, benchmark passages, packing.

Every stage takes the documents that its predecessor kept, read back from a written table, and returns
those it keeps with the columns of ``documents``; the last one returns packed pieces. SQL cannot
express the trained stages, so there is no check SQL; the tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm import decontaminate, language, packing, quality, setjoin
from provenir.llm.common import stage, table
from provenir.llm.queries import ready, tokenizer_path

#: Share of the languages' scores that the best one needs; a text below it has no language.
LEAST_LANGUAGE = 0.4


def _apart(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its own columns of these names out of an operator's way, and how to get them back."""
    longest = max((len(c) for c in docs.columns), default=0)
    moved = {c: c + "_" * longest if c in names else c for c in docs.columns}
    return docs.withColumnsRenamed(moved), [F.col(f"`{new}`").alias(c) for c, new in moved.items()]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text is no outlier of their language.

    Rows are judged one by one, so repeated rows stay or go together. A null or empty text goes; a null
    language is one of its own. All columns stay as they are; an empty table stays empty.
    """
    ready(spark)
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    docs, columns = _apart(docs, ["perplexity", "threshold", "kept"])
    return quality.score(docs, trusted).filter("kept").select(*columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labelled ones teach.

    A null text and one without a letter go. Repeated rows stay or go together; null languages teach
    nothing. All columns stay as they are; an empty table stays empty.
    """
    ready(spark)
    docs, columns = _apart(docs, ["lang_pred", "score"])
    found = language.identify(docs, language.learn(docs))
    kept = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)
    return found.filter(kept).select(*columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id; repeated rows stay once.

    Documents without words have no near copies. Near copies share 0.8 of their five-word shingles. Of rows
    with a null id that of a known one stays, if there is one. All columns stay as they are; an empty
    table stays empty.
    """
    ready(spark)
    # A name that no column of the documents has.
    own = "_key" + "_" * max((len(c) for c in docs.columns), default=0)
    key = F.xxhash64("doc_id", F.col("text").cast("string"))
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), key.alias("key"))
    found = stage(setjoin.join(docs.select(name.alias("name"), "text"), id_col="name"))
    gone = stage(found.filter("name <> component_id").select(F.col("name.key").alias(own)).distinct())
    again = stage(
        found.filter("n_shingles > 0").groupBy(F.col("name.key").alias(own)).agg(F.count("*").alias("n")).filter("n > 1").select(own)
    )
    kept = docs.withColumn(own, key).join(gone, own, "left_anti")
    if not again.isEmpty():
        once = kept.join(again, own, "left_semi").dropDuplicates([own])
        kept = kept.join(again, own, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    A null or empty text holds none and stays. Repeated rows stay or go together; all columns stay as they
    are; an empty table stays empty.
    """
    ready(spark)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in token sequences.

    A null text counts as empty; repeated rows are packed as often as they stand there. Other columns of
    the documents are left out; an empty table gives no pieces.
    """
    ready(spark)
    return packing.pack(docs, tokenizer_path(), keep_ids=False)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_languages),
    ("near_copies", keep_one_of_near_copies),
    ("benchmark", remove_benchmark),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
