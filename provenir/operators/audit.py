"""Audit records: what a run considered, and why a page was missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.operators.large_groups import number_rows
from provenir.operators.vocabulary import grams, post
from provenir.session import cut_lineage


def considered(
    candidates: DataFrame,
    shortlisted: DataFrame,
    fetched: DataFrame,
    by: list[str],
) -> DataFrame:
    """Every candidate with its position (best down, URL) and how far it came.

    ``candidates``: by, url, best.
    """
    keys = [*by, "url"]
    mark = lambda rows, name: rows.select(*keys).distinct().withColumn(name, F.lit(True))
    flagged = candidates.join(mark(shortlisted, "shortlisted"), keys, "left").join(
        mark(fetched, "fetched"), keys, "left"
    )
    flagged = flagged.withColumn("shortlisted", F.coalesce("shortlisted", F.lit(False))).withColumn(
        "fetched", F.coalesce("fetched", F.lit(False))
    )
    return number_rows(flagged, by, [-F.col("best"), F.col("url")], "position")


def classify_misses(asks: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """Per (by, fragment): never seen, ranked out, shortlisted but not read, or fetched.

    The furthest stage of the records whose URL holds the fragment counts. Fragments are posted under
    their rarest character n-gram, the n-grams of the URLs meet the postings of their own corridor, and
    what was met is verified: the work follows the URLs and the matches, not asks times records. An
    empty fragment is in every URL; asks repeated stay repeated.
    """
    stage = F.when(F.col("fetched"), 3).when(F.col("shortlisted"), 2).otherwise(1)
    staged = records.select(*by, "url", stage.alias("_at"))
    furthest = [F.max("_at").alias("_stage"), F.count("*").alias("matches")]
    wanted = asks.select(*by, "fragment").distinct()
    postings = cut_lineage(post(wanted.filter("fragment <> ''").withColumnRenamed("fragment", "phrase")))
    sizes = sorted(r[0] for r in postings.select(F.length("gram")).distinct().collect())
    every = F.array_distinct(F.concat(F.array().cast("array<string>"), *[grams(F.col("url"), m) for m in sizes]))
    met = staged.select("*", F.explode(every).alias("gram")).join(postings, [*by, "gram"])
    found = met.filter(F.contains("url", F.col("phrase"))).groupBy(*by, F.col("phrase").alias("fragment")).agg(*furthest)
    anywhere = staged.filter("url is not null").groupBy(*by).agg(*furthest).join(wanted.filter("fragment = ''"), by)
    found = found.unionByName(anywhere.select(*found.columns))
    label = (
        F.when(F.col("_stage") == 3, "fetched")
        .when(F.col("_stage") == 2, "shortlisted, not read")
        .when(F.col("_stage") == 1, "ranked out")
        .otherwise("never seen")
    )
    return (
        asks.join(found, [*by, "fragment"], "left")
        .withColumn("verdict", label)
        .withColumn("matches", F.coalesce("matches", F.lit(0)))
        .drop("_stage")
    )


def run_outcome(finished: Column, sources: Column, unresolved: Column, last_note: Column) -> Column:
    """One label for a run: raised, refused with its last note, resolved with gaps, resolved."""
    gaps = F.concat(F.lit("resolved, with no "), F.array_join(unresolved, ", "))
    return (
        F.when(~finished, "the run raised before it finished")
        .when(sources == 0, F.coalesce(last_note, F.lit("refused")))
        .when(F.size(unresolved) > 0, gaps)
        .otherwise("resolved")
    )
