"""Physical plans: no cross join, no Python row functions, top-k before the shuffle, pruned scans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from provenir.operators import ranking as rk, trust, vocabulary as vc

FOLDER = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["canonical_urls", "country_mentions", "role_rank", "merge_candidates", "ledger", "cache_lookup", "plan_status", "missing_sources"])
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(contract.queries()[name](spark, FOLDER))
    assert not [word for word in FORBIDDEN if word in plan]


def test_top_k_is_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = plan_of(rk.top(rows, ["g"], [F.col("id")], 5))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_trust_flag_does_not_shuffle_the_rows(spark, table):
    rows = spark.range(1000).select("id", F.concat(F.lit("h"), (F.col("id") % 7).cast("string"), F.lit(".gov")).alias("host"))
    plan = plan_of(trust.flag_within(rows, "host", table([("h1.gov",)], "domain string"), "ok"))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_scan_reads_only_what_is_needed(spark):
    plan = plan_of(contract.queries()["newest_runs"](spark, FOLDER))
    assert "props" not in plan and "value" not in plan.split("ReadSchema")[-1]


def test_exploded_pieces_are_not_broadcast(spark, table):
    pieces = spark.range(10).select("id", F.explode(F.array(*[F.lit(f"g{i}") for i in range(50)])).alias("gram"))
    listed = spark.range(100_000).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("gram"), F.repeat(F.lit("x"), 900).alias("entry"))
    plan = plan_of(vc.met_with(pieces, listed, "gram"))
    assert "BuildLeft" not in plan and vc.met_with(pieces, listed, "gram").count() == 500
    phrases = table([(f"phrase {i}",) for i in range(30)], "phrase string")
    plan = plan_of(vc.post(phrases))
    assert "BuildLeft" not in plan and plan.count("SortMergeJoin [phrase") == 1
