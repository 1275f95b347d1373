"""A keyed table that is updated by generations: the current row of every key.

Rows lie in buckets by the hash of their key. A write merges what arrives with the buckets it touches,
writes those anew beside the old ones, and commits by a manifest that names each bucket's folder: the
others are taken over as they are. A read opens the newest committed manifest, or an older one, and only
the buckets of the keys it is asked for. A write that fails leaves no manifest and so no trace for
readers; of two writers of one generation the second is refused.

The manifest has one row per bucket; ``buckets`` bounds what passes the driver. Rows of one key are
ordered by ``order`` and then by the whole row, so that the result never depends on how rows arrived.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenir import schemas
from provenir.operators.freshness import newest

_MANIFEST = "bucket int, folder string, buckets int, version int"


class KeyedStore:
    def __init__(
        self, spark: SparkSession, root: str, schema: str, key: str, order: list[str], buckets: int = 256, version: int = 1
    ):
        """``version``: of the rows' schema; a store written under another one holds nothing."""
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.key, self.order, self.buckets, self.version = key, order, buckets, version
        self.columns = StructType.fromDDL(schema).fieldNames()

    def generations(self) -> list[int]:
        """The committed generations, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/generations")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [s.getPath() for s in files.listStatus(path)]
        done = [p for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def manifest(self, generation: int | None = None) -> dict[int, str]:
        """Folder of each bucket that holds rows, in the newest or the named generation."""
        known = self.generations()
        if not known:
            return {}
        at = known[-1] if generation is None else generation
        if at not in known:
            raise ValueError(f"no generation {at}")
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/generations/{at}").collect()
        if any(r["buckets"] != self.buckets for r in rows):
            raise ValueError("the store has another number of buckets")
        return {r["bucket"]: r["folder"] for r in rows if r["version"] == self.version}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders.values()])

    def merge(self, fresh: DataFrame) -> int:
        """Make ``fresh`` part of the store; the number of the new generation. Rows without a key are left out."""
        fresh = fresh.select(*self.columns).filter(F.col(self.key).isNotNull())
        known = self.generations()
        number = known[-1] + 1 if known else 1
        now = self.manifest()
        touched = self._touched(fresh)
        both = fresh.unionByName(self._rows({b: now[b] for b in touched if b in now}))
        rest = [c for c in self.columns if c != self.key and c not in self.order]
        kept = newest(both, [self.key], [F.col(c) for c in self.order + rest]).select(*self.columns)
        data = f"data/{uuid4().hex}"
        kept.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{data}")
        entries = now | {b: f"{data}/bucket={b}" for b in touched}
        rows = [(b, f, self.buckets, self.version) for b, f in sorted(entries.items())]
        manifest = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        manifest.write.mode("errorifexists").parquet(f"{self.root}/generations/{number}")
        return number

    def read(self, generation: int | None = None) -> DataFrame:
        """All current rows."""
        return self._rows(self.manifest(generation))

    def lookup(self, wanted: DataFrame, generation: int | None = None) -> DataFrame:
        """``wanted`` (with the key column) with the stored row of each key, nulls where there is none.

        Only the buckets of the wanted keys are opened.
        """
        now = self.manifest(generation)
        asked = self._touched(wanted.filter(F.col(self.key).isNotNull()))
        return wanted.join(self._rows({b: now[b] for b in asked if b in now}), self.key, "left")


def page_store(spark: SparkSession, root: str, buckets: int = 256) -> KeyedStore:
    """Fetched pages: one current row per URL."""
    return KeyedStore(spark, root, schemas.PAGE_CACHE, "url", ["fetched_at"], buckets)


def corridor_store(spark: SparkSession, root: str, buckets: int = 64) -> KeyedStore:
    """Resolved corridors: the newest resolution of each."""
    return KeyedStore(spark, root, schemas.RESOLVED_CORRIDORS, "corridor_key", ["resolved_at"], buckets)
