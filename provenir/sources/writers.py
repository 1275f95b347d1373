"""Sinks: newest row per key, registry, recall records, and their streaming form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenir import schemas
from provenir.operators.freshness import newest

REGISTRY_ROWS = 10_000


def merge_newest(current: DataFrame | None, fresh: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the newest of what is stored and what arrives."""
    both = fresh if current is None else current.unionByName(fresh)
    return newest(both, keys, order)


def write_page_cache(current: DataFrame | None, fresh: DataFrame, path: str) -> None:
    """Write a whole cache as JSON documents to a new path, as an export. Updates go to a ``keyed_store``."""
    merged = merge_newest(current, fresh, ["url"], [F.col("fetched_at"), F.col("content_hash")])
    merged.withColumn("schema_version", F.lit(1)).write.mode("errorifexists").json(path)


def write_corridors(current: DataFrame | None, fresh: DataFrame, path: str) -> None:
    order = [F.col("resolved_at"), F.col("pages_fetched")]
    merged = merge_newest(current, fresh, ["corridor_key"], order)
    merged.withColumn("schema_version", F.lit(1)).write.mode("errorifexists").json(path)


def write_recall_records(records: DataFrame, path: str) -> None:
    """Candidates of the newest run per corridor, long, refused runs included.

    Runs of one stamp are told apart by ``run_id``, where the records carry one; the largest stays.
    """
    run = ["recorded_at", *(["run_id"] if "run_id" in records.columns else [])]
    newest_run = records.groupBy("corridor_key").agg(F.max(F.struct(*run)).alias("_run")).select("corridor_key", "_run.*")
    kept = records.join(newest_run, ["corridor_key", *run], "left_semi")
    kept.write.mode("errorifexists").parquet(path)


def write_registry(registry: DataFrame, path: str) -> None:
    """Rows sorted by code in one file, trust order kept, so that reruns diff clean.

    A registry has one row per country; the count is checked before it goes into one file.
    """
    if registry.limit(REGISTRY_ROWS + 1).count() > REGISTRY_ROWS:
        raise ValueError(f"a registry holds at most {REGISTRY_ROWS} rows")
    columns = StructType.fromDDL(schemas.AUTHORITY_REGISTRY).fieldNames()
    registry.select(*columns).orderBy("code").coalesce(1).write.mode("errorifexists").json(path)


def append_newest(batch: DataFrame, epoch: int, folder: str, keys: list[str], order: list[Column]) -> None:
    """``foreachBatch`` sink of keyed state: each micro-batch leaves its newest row per key.

    A repeated micro-batch replaces its own folder, so the sink is idempotent; ``read_newest``
    settles the batches.
    """
    newest(batch, keys, order).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def read_newest(
    spark: SparkSession, folder: str, schema: str, keys: list[str], order: list[Column]
) -> DataFrame:
    rows = spark.read.schema(schema).option("basePath", folder).parquet(folder).select(*StructType.fromDDL(schema).fieldNames())
    return newest(rows, keys, order)
