"""What the operators share: stage tables, text as raw bytes, word hashes, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.session import cut_lineage

stage = cut_lineage

#: UTF-8 bytes handled at once by the array code, so that its scratch arrays stay small.
SLICE_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a single longer row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last
    # What the slices took goes back, as workers are kept for other stages.
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def word_spans(data: np.ndarray, separator: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each word of ``data``; ``ends`` are text ends, which also end words.

    Words are the runs of bytes outside ``separator``.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = ends[(ends > 0) & (ends < len(data))]
    begin[heads] = inside[heads]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[heads - 1] = inside[heads - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: a polynomial of its bytes, mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=total[1:])
    inverse = np.full(len(data), np.uint64(_inverse(int(_BASE))), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    value = (total[stops] - total[starts]) * inverse[starts]
    return mix(value + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, separator: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of ``data``: a function of the word's bytes alone."""
    starts, stops = word_spans(data, separator, ends)
    return span_hashes(data, starts, stops), starts


def space_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words between ASCII white space, A-Z lower-cased."""
    return word_hashes(_LOWER[data], _SPACE, ends)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for nodes with a link.

    Every round takes the least label around each node and then the label of that label. Rounds are
    written to the shared folder, hubs are combined before the shuffle, nothing goes to the driver
    but the number of changed labels.
    """
    both = stage(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        merged = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", "label", F.least("label", F.coalesce("near", "label")).alias("next")
        )
        merged = stage(merged)
        up = merged.select(F.col("node").alias("next"), F.col("next").alias("top"))
        after = stage(
            merged.join(up, "next", "left").select(
                "node", F.coalesce("top", "next").alias("label"), (F.coalesce("top", "next") != F.col("label")).alias("moved")
            )
        )
        labels = after.select("node", "label")
        if after.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
