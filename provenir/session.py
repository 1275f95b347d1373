"""Session settings and the one place lineage is cut."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cpus: int = 8, memory: str = "8g", app: str = "provenir") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one the cluster names.

    Only a session in one process may do without a name, as in tests; it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stage_folder(spark: SparkSession) -> str:
    """Where this application's stage tables are."""
    return f"{shared_folder(spark)}/stages-{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Delete this application's stage tables. Frames that still read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, plain: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Lost executors then cost no recompute of what came before, and later reads take only the
    columns they need. The planner knows the written table's real size: it is broadcast while that
    is under ``spark.sql.autoBroadcastJoinThreshold``, and joined by shuffling beyond it, so no
    join in the library carries an unchecked broadcast hint. ``plain`` writes values as they are, for
    tables whose rows repeat so much that the size of their packed files says little of the rows'.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{uuid4().hex}"
    packing = {"compression": "uncompressed", "parquet.enable.dictionary": "false"} if plain else {}
    df.write.options(**packing).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A parameter table as a local relation, so that its size is known to the planner."""
    fields = StructType.fromDDL(schema)
    names = fields.fieldNames()
    data = pa.Table.from_pylist(
        [dict(zip(names, row, strict=True)) for row in rows], schema=to_arrow_schema(fields)
    )
    return spark.createDataFrame(data, fields)
