"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Bytes of a batch that goes to Python, or comes from it; a single larger row is a batch of its own.
ARROW_BYTES = 8 << 20


def tokenizer_path() -> str:
    """The public tokenizer's file; the vocabulary stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ready(spark: SparkSession) -> None:
    """Let executors import this repository where the cluster has not put it on their path.

    Batches between Spark and Python are kept to ``ARROW_BYTES``, also of long texts and large sets.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenir.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"
    )


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenir.llm import warc

    folder = warc.archive_folder(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder).select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to_id").cast("long").alias("refers_to"),
    )


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenir.llm.licenses import scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


@query
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenir.llm.html_text import extract

    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenir.llm.forest import neighbours

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours(vectors, vectors.filter(F.col("vec_id") % 50 == 0)).select(
        "query_id", "rank", "vec_id", "score"
    )


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenir.llm.language import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    model = learn(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenir.llm.quality import score, trusted_ids

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = score(docs, trusted_ids(table(spark, sf_dir, "labels")))
    return found.select("doc_id", "lang", "perplexity", "threshold", "kept")


@query
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenir.llm.setjoin import join

    return join(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenir.llm.decontaminate import matches

    found = matches(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select("doc_id", "item_id", "in_order", "answer", "cosine")


@query
def op1_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model is counted on conversations whose id has another remainder than 1; all are formatted."""
    from provenir.llm.transcripts import as_logs, format_turns, learn

    logs = as_logs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    model = learn(logs.filter(F.col("conv_id") % 3 != 1))
    return format_turns(logs.select("conv_id", "turn", "text"), model)


@query
def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenir.llm.kd_search import top_k

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenir.llm.spelling import group

    return group(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenir.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
