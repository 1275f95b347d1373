"""Order-dependent work over groups of any size.

A window over one group runs in one task. Where a group can hold a large share of the rows, the
operators here sort by range instead: Spark's range partitioner splits a large group over many
partitions, each partition is numbered on its own, and a table with one row per (partition, group)
carries the running counts across. Groups of all sizes take this one path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.session import cut_lineage

#: Rows that a task sorts or groups at once, and tasks from which rows are dealt.
IN_TASK, LEAST_TASKS = 250_000, 8


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal ``df`` over tasks by ``keys``, in as many as ``rows`` rows need.

    The number of shuffle partitions is fixed, and small ones are put together by their packed bytes, so
    without this a task's share grows with the table. What is grouped by the keys, or joined on all of them
    with a frame dealt so, is dealt alike. Tables of few ``rows`` are left to Spark.
    """
    tasks = -(-rows // IN_TASK)
    if tasks <= LEAST_TASKS:
        return df
    return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def ranged(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Sort by range over (group, order) and tag rows with their partition, fixed on disk."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(name) for name in group] + list(order)
    return cut_lineage(
        df.repartitionByRange(parts, *keys).withColumn("_slice", F.spark_partition_id())
    )


def carry_last(df: DataFrame, group: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``name``: the last non-null ``value`` of the group up to the row itself, in groups of any size.

    ``order`` ascends; group columns are not null. Slices hold equal numbers of rows wherever the range
    partitioner finds bounds, so a busy group is spread over as many tasks as its share of the rows.
    """
    sliced = ranged(df, group, order)
    held = sliced.filter(F.col(value).isNotNull())
    ends = held.groupBy(*group, "_slice").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    # One row per (group, slice): at most the groups and the partitions together.
    slices = sliced.select(*group, "_slice").distinct().join(ends, [*group, "_slice"], "left")
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier)).filter("_carry is not null")
    inner = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sliced.withColumn("_here", F.last(value, ignorenulls=True).over(inner))
        .join(carried.select(*group, "_slice", "_carry"), [*group, "_slice"], "left")
        .withColumn(name, F.coalesce("_here", "_carry"))
        .drop("_slice", "_here", "_carry")
    )


def number_rows(df: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``row_number`` over groups of any size. ``order`` ascends and must end in a unique key."""
    sliced = ranged(df, group, order)
    counts = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inner = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_in", F.row_number().over(inner))
        .join(offsets.drop("_n"), [*group, "_slice"])
        .withColumn(name, (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_slice", "_in", "_before")
    )
