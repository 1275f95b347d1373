"""Readers: search responses, parameter tables, cached documents, snapshots, query templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenir import schemas
from provenir.functions import keys
from provenir.functions.urls import strip
from provenir.operators.freshness import newest
from provenir.session import cut_lineage

_RESPONSE = "web struct<results:array<string>>"


def read_search_responses(responses: DataFrame, by: list[str] = ()) -> DataFrame:
    """Hits of search responses (``query``, ``query_seq``, ``body`` as JSON text).

    ``rank`` is the place in the answer before entries without a URL are dropped.
    """
    entries = F.from_json("body", _RESPONSE)["web"]["results"]
    rows = responses.select(*by, "query", "query_seq", F.posexplode(entries).alias("rank", "entry"))
    # Entries stay text until here, so that a URL that is not a string counts as missing.
    entry = F.try_parse_json("entry")
    is_text = F.schema_of_variant(F.try_variant_get(entry, "$.url", "variant")) == "STRING"
    return (
        rows.withColumn("url", F.when(is_text, F.get_json_object("entry", "$.url")))
        .filter(F.coalesce("url", F.lit("")) != "")
        .select(
            *by,
            "query",
            "query_seq",
            "rank",
            "url",
            F.coalesce(F.get_json_object("entry", "$.title"), F.lit("")).alias("title"),
            F.coalesce(F.get_json_object("entry", "$.description"), F.lit("")).alias("snippet"),
        )
    )


def assert_schema(df: DataFrame, schema: str) -> DataFrame:
    """Refuse a table whose columns are not exactly the declared ones."""
    declared = StructType.fromDDL(schema).fieldNames()
    expected, found = set(declared), set(df.columns)
    if expected != found:
        raise ValueError(f"unexpected columns {sorted(found - expected)}, missing {sorted(expected - found)}")
    return df.select(*declared)


def read_json_table(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """A parameter table from JSON: declared schema, no unreadable rows, unique key."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    rows = cut_lineage(rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record"))
    if key is not None:
        twice = rows.groupBy(key).count().filter("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"{key} must be unique: {[r[key] for r in twice]}")
    return rows


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    return read_json_table(spark, path, schemas.COUNTRIES, "code")


def read_denylist(spark: SparkSession, path: str) -> DataFrame:
    return read_json_table(spark, path, schemas.DENYLIST, "domain")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return read_json_table(spark, path, schemas.AUTHORITY_REGISTRY, "code")


def read_documents(spark: SparkSession, path: str, schema: str, key: str, version: int = 1) -> DataFrame:
    """Stored JSON documents, newest per key. Unreadable or old-schema rows are misses."""
    open_ = f"{schema}, schema_version int, _corrupt_record string"
    rows = spark.read.schema(open_).option("mode", "PERMISSIVE").json(path)
    good = rows.filter(F.col("_corrupt_record").isNull() & (F.col("schema_version") == version))
    good = good.drop("_corrupt_record", "schema_version").filter(F.col(key).isNotNull())
    stamp = next(c for c in ("fetched_at", "resolved_at", "recorded_at") if c in good.columns)
    # Of equal stamps the whole row decides, so that a key's answer never depends on the files' order.
    rest = [F.col(c) for c in good.columns if c not in (key, stamp)]
    return newest(good.filter(F.col(stamp).isNotNull()), [key], [F.col(stamp), *rest])


def read_page_cache(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, schemas.PAGE_CACHE, "url")


def read_corridors(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, schemas.RESOLVED_CORRIDORS, "corridor_key")


def lookup_pages(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached entry of each wanted URL, or nulls when there is none."""
    return wanted.join(cache, "url", "left")


def read_snapshot(
    manifest: DataFrame, files: DataFrame, maximum: int, captured_at: Column
) -> tuple[DataFrame, DataFrame]:
    """(sources, problems) of a manifest (source_id, …) and its texts (source_id, content).

    Both must hold the same ids, and every text must be non-blank and within the limit.
    """
    both = manifest.withColumn("_m", F.lit(True)).join(
        files.withColumn("_f", F.lit(True)), "source_id", "full"
    )
    problem = (
        F.when(F.col("_f").isNull(), "declared but has no text")
        .when(F.col("_m").isNull(), "has a text but is not declared")
        .when(strip(F.col("content")) == "", "the text is empty")
        .when(F.length(strip(F.col("content"))) > maximum, "the text is too long")
    )
    judged = both.withColumn("problem", problem).drop("_m", "_f")
    sources = (
        judged.filter(F.col("problem").isNull())
        .drop("problem")
        .withColumn("content", strip(F.col("content")))
        .withColumn("content_hash", keys.content_hash(F.col("content")))
        .withColumn("retrieved_at", captured_at)
    )
    return sources, judged.filter(F.col("problem").isNotNull()).select("source_id", "problem")


def read_snapshot_files(spark: SparkSession, folder: str) -> DataFrame:
    """Text files of a folder as (source_id, content)."""
    rows = spark.read.option("wholetext", True).text(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1)
    return rows.select(name.alias("source_id"), F.col("value").alias("content"))


# The wording of the search queries.
BOOTSTRAP_TEMPLATES = [
    "%s visa official government",
    "%s embassy visa application",
    "%s immigration authority official",
    "%s ministry of foreign affairs visa",
]


def bootstrap_queries(countries: DataFrame, name: str = "name") -> DataFrame:
    """Overlapping queries per country: a domain must appear in more than one."""
    texts = F.array(*[F.format_string(t, F.col(name)) for t in BOOTSTRAP_TEMPLATES])
    return countries.select("*", F.posexplode(texts).alias("query_seq", "query"))


def corridor_queries(corridors: DataFrame, by: list[str]) -> DataFrame:
    """Three queries per trusted domain, in domain order.

    ``corridors``: by, name, nationality, residence, purpose, trusted (array).
    """
    exploded = corridors.select(
        *dict.fromkeys([*by, "name", "nationality", "residence", "purpose"]),
        F.posexplode("trusted").alias("_d", "domain"),
    )
    texts = F.array(
        F.format_string("site:%s %s visa requirements %s", "domain", "name", "nationality"),
        F.format_string("site:%s %s visa documents required", "domain", "purpose"),
        F.format_string("site:%s visa application %s", "domain", "residence"),
    )
    return exploded.select(
        *by, "domain", "_d", F.posexplode(texts).alias("_t", "query")
    ).select(*by, "domain", (F.col("_d") * 3 + F.col("_t")).alias("query_seq"), "query")
