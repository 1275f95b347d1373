"""The cache fold as a stream in event time.

What the cache makes of an observation depends on all earlier ones of its URL, so an observation waits in
the URL's state until the watermark has passed it. Then everything that can still arrive is later, and the
waiting ones are folded in order: the results are those of the batch fold, in whatever order observations
came within the allowed lateness. Event-time timers wake a URL when its earliest waiting observation is due.

State per URL is the waiting observations, bounded by the lateness, and one row: when the page was last
confirmed and the hash it then had. That row expires ``forget_hours`` after it was last moved. An
observation that comes later than the lateness is dropped by the watermark; ``unanswered`` finds these
for the batch fold.

URLs are kept by buckets of their hash: state is read and written, and timers are set, once a bucket and
not once a URL, and the URLs of a bucket are folded together. ``buckets`` is fixed when a stream begins, as
the number of state partitions is; a bucket should have some ten thousand observations within the lateness.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from provenir.operators.freshness import HOUR
from provenir.params import LIMITS
from provenir.session import STATE_STORE, shared_folder

INPUT = "event_id long, url string, at long, seq long, attempt string, content_hash string"
OUTPUT = "event_id long, url string, attempt string, result string, served_at long, served_hash string"
#: An observation that only moves the watermark on.
TICK = "tick"
FORGET_HOURS = 4 * LIMITS.stale_hours
_WAITING = pa.schema([("url", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("event_id", pa.int64()), ("attempt", pa.string()), ("hash", pa.string())])
_HELD = pa.schema([("url", pa.string()), ("at", pa.int64()), ("hash", pa.string())])
#: Buckets of a stream, and observations that a replay puts into a bucket.
BUCKETS, IN_BUCKET = 512, 20_000


def _nexts(group: np.ndarray, at: np.ndarray, asked_group: np.ndarray, asked_at: np.ndarray) -> np.ndarray:
    """How many of the entries (group, at), which are in order, come before each asked one."""
    groups, times = np.concatenate([group, asked_group]), np.concatenate([at, asked_at])
    entry = np.arange(len(groups)) < len(group)
    order = np.lexsort([entry, times, groups])
    before = np.cumsum(entry[order])
    out = np.empty(len(groups), np.int64)
    out[order] = before
    return out[len(group) :]


def fold_groups(
    group: np.ndarray, at: np.ndarray, tried: np.ndarray, hashes: np.ndarray, known: np.ndarray, held_at: np.ndarray, held_hash: np.ndarray, ttl: int, ceiling: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(result, moved at, hash, moved) of rows that stand in order of their group, number 0 and up, and of time.

    ``known``, ``held_at`` and ``held_hash`` say what each group held before. All groups follow their chains
    of refreshes together, a step at a time.
    """
    stored, row = tried == "stored", np.arange(len(group))
    success = np.flatnonzero(stored | (tried == "not_modified"))
    of, when = group[success], at[success]
    after = np.maximum(_nexts(of, when, of, when + ttl), np.arange(len(success)) + 1)
    # A group that holds nothing begins with its first stored page, another with the first success past its time.
    holding = np.flatnonzero(known)
    first = _nexts(of, when, holding, held_at[holding] + ttl)
    first = first[(first < len(success)) & (of[np.minimum(first, max(len(success) - 1, 0))] == holding)] if len(success) else first[:0]
    fresh = np.flatnonzero(stored[success] & ~known[of])
    fresh = fresh[np.unique(of[fresh], return_index=True)[1]]
    place = np.concatenate([first, fresh])
    moved = np.zeros(len(group), bool)
    while len(place):
        moved[success[place]] = True
        ahead = after[place]
        inside = ahead < len(success)
        place, ahead = place[inside], ahead[inside]
        place = ahead[of[ahead] == of[place]]
    start = np.searchsorted(group, group)
    last = np.maximum.accumulate(np.where(moved, row, -1))
    own = last >= start
    moved_at = np.where(own, at[last], held_at[group])
    last = np.maximum.accumulate(np.where(moved & stored, row, -1))
    digest = np.where(last >= start, hashes[last], held_hash[group])
    age, held = at - moved_at, own | known[group]
    result = np.where(
        moved,
        np.where(stored, "fetched", "revalidated"),
        np.where(held & (age < ttl), "hit", np.where(held & (tried != "untrusted") & (age <= ceiling), "stale", "failure")),
    )
    return result, moved_at, digest, held


def fold_in_order(rows: pd.DataFrame, held: tuple[int, str | None] | None, ttl: int, ceiling: int) -> tuple[pd.DataFrame, tuple[int, str | None] | None]:
    """What becomes of ``rows`` (one URL's, in order) after ``held`` (at, hash), and what is held then."""
    tried = rows["attempt"].to_numpy(object)
    before = np.array([held is not None]), np.array([held[0] if held else 0], np.int64), np.array([held[1] if held else None], object)
    result, moved_at, digest, known = fold_groups(
        np.zeros(len(rows), np.int64), rows["at"].to_numpy(np.int64), tried, rows["hash"].to_numpy(object), *before, ttl, ceiling
    )
    served = result != "failure"
    out = pd.DataFrame(
        {
            "event_id": rows["event_id"].to_numpy(),
            "attempt": tried,
            "result": result,
            "served_at": pd.array(np.where(served, moved_at, 0), dtype="Int64"),
            "served_hash": np.where(served, digest, None),
        }
    )
    out.loc[~served, "served_at"] = pd.NA
    return out, (int(moved_at[-1]), digest[-1]) if known[-1] else None


def _packed(table: pa.Table) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(value) -> pa.Table:
    return pa.ipc.open_stream(bytes(value[0])).read_all()


class CacheFold(StatefulProcessor):
    """Folds the URLs of one bucket; rows are kept in state as Arrow tables, so no call is made for a row or a URL."""

    def __init__(self, ttl_hours: float, ceiling_hours: float, forget_hours: float):
        self.ttl, self.ceiling = int(ttl_hours * HOUR), int(ceiling_hours * HOUR)
        self.forget = int(forget_hours * HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.due = handle.getValueState("due", "at long")

    def _wake(self, at: int) -> None:
        """Ask to be called when the watermark has passed the microsecond ``at``."""
        self.due.update((at,))
        self.handle.registerTimer(-(-at // 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            frame = frame[frame["attempt"] != TICK]
            if len(frame):
                arrived = pa.Table.from_pandas(frame.rename(columns={"content_hash": "hash"})[_WAITING.names], _WAITING, preserve_index=False)
                self.waiting.appendValue(_packed(arrived.replace_schema_metadata()))
                first = int(frame["at"].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None and (not self.due.exists() or earliest < self.due.get()[0]):
            self._wake(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if not self.due.exists() or self.due.get()[0] > passed:
            return
        held = _unpacked(self.held.get()) if self.held.exists() else _HELD.empty_table()
        waiting = [_unpacked(x) for x in self.waiting.get()] if self.waiting.exists() else []
        rows = pa.concat_tables([_WAITING.empty_table(), *waiting])
        due = pc.less_equal(rows["at"], passed)
        ready, later = rows.filter(due), rows.filter(pc.invert(due))
        if len(ready):
            out, held = self._fold(ready.sort_by([(c, "ascending") for c in ("url", "at", "seq", "event_id")]), held)
            if len(later):
                self.waiting.put([_packed(later)])
            else:
                self.waiting.clear()
        forgotten = pc.less_equal(pc.add(held["at"], self.forget), passed)
        keep = held.filter(pc.invert(pc.and_(forgotten, pc.invert(pc.is_in(held["url"], value_set=later["url"])))))
        if len(keep):
            self.held.update(_packed(keep))
        else:
            self.held.clear()
        # A page past its time that still has rows waiting is looked at again with them.
        expiry = pc.add(held.filter(pc.invert(forgotten))["at"], self.forget)
        wakes = [x for x in (pc.min(later["at"]).as_py(), pc.min(expiry).as_py()) if x is not None]
        if wakes:
            self._wake(min(wakes))
        else:
            self.due.clear()
        if len(ready):
            yield out

    def _fold(self, ready: pa.Table, held: pa.Table) -> tuple[pd.DataFrame, pa.Table]:
        """The results of ``ready``, which is in order, and what all URLs hold then."""
        named = pc.run_end_encode(ready["url"].combine_chunks()) if len(ready) else None
        urls, ends = named.values, named.run_ends.to_numpy()
        group = np.repeat(np.arange(len(urls)), np.diff(ends, prepend=0))
        at, tried = ready["at"].to_numpy(), ready["attempt"].to_numpy().astype(object)
        place = pc.index_in(urls, value_set=held["url"].combine_chunks())
        known, place = place.is_valid().to_numpy(zero_copy_only=False), place.fill_null(0).to_numpy()
        held_at, held_hash = np.zeros(len(urls), np.int64), np.full(len(urls), None, object)
        held_at[known] = held["at"].to_numpy()[place[known]]
        held_hash[known] = held["hash"].to_numpy().astype(object)[place[known]]
        hashes = ready["hash"].to_numpy().astype(object)
        result, moved_at, digest, holds = fold_groups(group, at, tried, hashes, known, held_at, held_hash, self.ttl, self.ceiling)
        served = result != "failure"
        out = pa.table(
            {
                "event_id": ready["event_id"], "url": ready["url"], "attempt": ready["attempt"], "result": pa.array(result, pa.string()),
                "served_at": pa.array(moved_at, mask=~served), "served_hash": pa.array(np.where(served, digest, None), pa.string()),
            }
        ).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        last = ends - 1
        last = last[holds[last]]
        now = pa.table([ready["url"].take(pa.array(last)), pa.array(moved_at[last]), pa.array(digest[last], pa.string())], schema=_HELD)
        others = held.filter(pc.invert(pc.is_in(held["url"], value_set=urls)))
        return out, pa.concat_tables([others, now]).combine_chunks()

    def close(self) -> None:
        pass


def fold_stream(
    observations: DataFrame,
    ttl_hours: float = LIMITS.fresh_hours,
    ceiling_hours: float = LIMITS.stale_hours,
    lateness_hours: float = LIMITS.fresh_hours,
    forget_hours: float = FORGET_HOURS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming DataFrame of observations → streaming DataFrame of results, each once, when it is settled.

    A page not confirmed for ``forget_hours`` is forgotten; it must be at least ``ceiling_hours``, beyond
    which a copy serves no more. A ``not_modified`` after that finds nothing to confirm.
    """
    if forget_hours < ceiling_hours:
        raise ValueError("a copy can't be forgotten before its ceiling")
    return (
        observations.select("event_id", "url", "at", "seq", "attempt", "content_hash", F.timestamp_micros("at").alias("ts"), F.pmod(F.xxhash64("url"), F.lit(buckets)).alias("bucket"))
        .withWatermark("ts", f"{int(timedelta(hours=lateness_hours).total_seconds())} seconds")
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=CacheFold(ttl_hours, ceiling_hours, forget_hours),
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def unanswered(observations: DataFrame, results: DataFrame) -> DataFrame:
    """The observations that came too late for the stream, or still wait."""
    return observations.join(results.select("event_id"), "event_id", "left_anti")


def write_results(results: DataFrame, folder: str, epoch: int) -> None:
    """Idempotent sink: a repeated micro-batch replaces its own output."""
    results.write.mode("overwrite").parquet(f"{folder}/batch={epoch}")


def run_available(spark: SparkSession, source: str, target: str, state: str, **options: float) -> None:
    """Fold everything new under ``source`` and stop; state and progress stay under ``state``. ``options`` are those of ``fold_stream``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    arriving = spark.readStream.schema(INPUT).parquet(source)
    query = (
        fold_stream(arriving, **options)
        .writeStream.outputMode("append")
        .option("checkpointLocation", state)
        .foreachBatch(lambda df, epoch: write_results(df, target, epoch))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def replay(spark: SparkSession, observations: DataFrame, slices: int = 3, lateness_hours: float = LIMITS.fresh_hours, **hours: float) -> DataFrame:
    """Feed stored observations to the stream out of order, each late by less than the lateness, and read what it wrote."""
    base = f"{shared_folder(spark)}/replay-{uuid4().hex}"
    lateness = int(lateness_hours * HOUR)
    late = F.pmod(F.xxhash64("event_id"), F.lit(max(lateness, 1)))
    rows = observations.select(
        "event_id", "url", "at", F.col("seq").cast("long").alias("seq"), "attempt", "content_hash", (F.col("at") + late).alias("arrival")
    )
    bounds = rows.agg(F.min("arrival").alias("lo"), F.max("arrival").alias("hi"), F.count("*").alias("n")).first()
    if bounds["lo"] is None:
        return spark.createDataFrame([], OUTPUT)
    buckets = max(16, -(-bounds["n"] // IN_BUCKET))
    width = max((bounds["hi"] - bounds["lo"]) // slices + 1, 1)
    end = spark.range(1).select(
        F.lit(None).cast("long").alias("event_id"), F.lit(TICK).alias("url"), F.lit(bounds["hi"] + lateness + HOUR).alias("at"),
        F.lit(0).cast("long").alias("seq"), F.lit(TICK).alias("attempt"), F.lit(None).cast("string").alias("content_hash"),
    )
    for number in range(slices + 1):
        start = bounds["lo"] + number * width
        arriving = end if number == slices else rows.filter((F.col("arrival") >= start) & (F.col("arrival") < start + width)).drop("arrival")
        arriving.write.mode("append").parquet(f"{base}/in")
        run_available(spark, f"{base}/in", f"{base}/out", f"{base}/state", lateness_hours=lateness_hours, buckets=buckets, **hours)
    return spark.read.schema(OUTPUT).option("recursiveFileLookup", True).parquet(f"{base}/out")
