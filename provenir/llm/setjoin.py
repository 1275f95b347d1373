"""Jaccard join of documents' word n-gram sets: an exact metric-space join.

Jaccard distance is a metric, and two documents link within ``e = 1 - threshold``. Only one document of
each distinct set takes part. Space is cut twice:

* At the top a pivot is a single n-gram. A document is at distance 1 from all pivots but its own n-grams,
  so the triangle inequality on set differences gives its window: under any one order of all n-grams,
  two linked documents share one of their first ``n - ceil(threshold * n) + 1``. Each document goes to
  the regions of those, n-grams that few documents have first, large regions further cut by set size.
* Within a region documents are pivots. They are compared with all of the region; every other document
  belongs to its nearest pivot's Voronoi cell and is replicated into each cell within ``2 * e`` of that
  distance. Cells are regions of the next round, without the pivots. A region whose cells would hold
  more than twice its rows stays whole, and only loses its pivots. Rounds take more pivots each, until
  every region has one document or one component left.

Pivots are the documents that have fewest n-grams ahead of the region's: such ones are closest to what a
group of near copies has in common. Documents of one component need no comparison, so a region of near
copies around such a centre ends after one pivot, whatever its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import components, mix, slices, space_words, stage, utf8

#: Counters of how many documents have an n-gram; they only order n-grams.
COUNTERS, CHUNKS = 1 << 20, 64
#: Bits of the filter over documents whose sets are needed.
BITS = 1 << 23
#: Rows from which a region is cut by set size, and pivots of the rounds.
BANDED, PIVOTS = 16, (1, 16, 256, 4096)
#: Rows for each pivot from which a region is split into cells.
WIDE = 256
#: Bytes of a set's parity bits.
PARITY = 256


def shingle_sets(offsets: np.ndarray, data: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a shorter text's whole sequence is its one n-gram."""
    ends = offsets[1:] - offsets[0]
    hashes, starts = space_words(data[offsets[0] : offsets[-1]], ends)
    doc = np.searchsorted(ends, starts, side="right")
    n = np.bincount(doc, minlength=len(ends))
    first = np.concatenate([[0], np.cumsum(n)])
    gram = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(gram)])
    out = []
    for i in range(len(ends)):
        if n[i] >= words:
            own = np.sort(gram[first[i] : first[i + 1] - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n[i]:
            whole = np.zeros(1, np.uint64)
            for h in hashes[first[i] : first[i + 1]]:
                whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + h)
            out.append(whole + np.uint64(n[i]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def nodes_of(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set, all at once; that of an empty set means nothing."""
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sets), np.int64)
    if len(full):
        begin = (np.cumsum(sizes) - sizes)[full]
        h = mix(np.concatenate(sets) * np.uint64(0xC2B2AE3D27D4EB4F) + np.repeat(sizes, sizes).astype(np.uint64))
        out[full] = mix(np.add.reduceat(h, begin) ^ mix(np.bitwise_xor.reduceat(h, begin))).view(np.int64)
    return out


def _each(batches: Iterator[pa.RecordBatch], words: int):
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        for first, last in slices(offsets):
            yield batch.column(0).slice(first, last - first), shingle_sets(offsets[first : last + 1], data, words)


def _summary(words: int):
    """(id, n, node) of each document; and the task's counters in pieces, as rows of n -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(COUNTERS, np.uint32)
        kind = pa.int64()
        for ids, sets in _each(batches, words):
            kind = ids.type
            every = np.concatenate(sets) & np.uint64(COUNTERS - 1)
            seen += np.bincount(every.astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.array(nodes_of(sets), mask=sizes == 0), pa.nulls(len(sets), pa.binary())],
                ["id", "n", "node", "counters"],
            )
        if seen.any():
            pieces = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(seen, CHUNKS)]
            names = np.arange(CHUNKS) + CHUNKS * part
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(CHUNKS, kind), pa.array([-1] * CHUNKS, pa.int64()), pa.array(names, pa.int64()), pa.array(pieces, pa.binary())],
                ["id", "n", "node", "counters"],
            )

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(COUNTERS // CHUNKS, np.uint64)
    for x in rows["counters"]:
        total += np.frombuffer(zlib.decompress(x), "<u4")
    total = np.minimum(total, 0xFFFFFFFF).astype("<u4")
    return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "counters": [zlib.compress(total.tobytes(), 1)]})


def _counters(summary: DataFrame) -> np.ndarray:
    """How many documents have an n-gram of each counter; tasks are added up in two steps."""
    rows = summary.filter("n < 0").select((F.col("node") % CHUNKS).alias("chunk"), F.floor(F.col("node") / CHUNKS).alias("part"), "counters")
    some = rows.withColumn("some", F.col("part") % 64).groupBy("chunk", "some").applyInPandas(_added, "chunk long, counters binary")
    total = some.groupBy("chunk").applyInPandas(_added, "chunk long, counters binary").collect()
    out = np.zeros(COUNTERS, np.uint32)
    for r in total:
        width = COUNTERS // CHUNKS
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(zlib.decompress(bytes(r["counters"])), "<u4")
    return out


def _windows(words: int, num: int, den: int, counters):
    """(node, n, first n-grams): the regions of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counters.value
        for _, sets in _each(batches, words):
            nodes, sizes, firsts = [], [], []
            for s, node in zip(sets, nodes_of(sets).tolist()):
                if not len(s):
                    continue
                count = np.minimum(seen[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
                keep = len(s) - -(-num * len(s) // den) + 1
                order = np.argsort((count << np.uint64(40)) | (s >> np.uint64(24)), kind="stable")[:keep]
                nodes.append(node)
                sizes.append(len(s))
                firsts.append(s[order].view(np.int64))
            edges = np.concatenate([[0], np.cumsum([len(f) for f in firsts])])
            values = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists], ["node", "n", "grams"])

    return run


def _place(names: np.ndarray) -> np.ndarray:
    """The filter's bit of a document that stands for its set."""
    return (mix(names.astype(np.int64).view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)


def parity(grams: np.ndarray) -> bytes:
    """Bits that tell whether an odd number of n-grams fall on them; two sets differ in at least as many as their bits do."""
    return np.packbits(np.bincount((grams >> np.uint64(20)).astype(np.int64) & (8 * PARITY - 1), minlength=8 * PARITY) & 1).tobytes()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = _place(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32())], ["place"])


def _wanted(words: int, bits):
    """(node, set) of the documents that the filter lets through, each set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = bits.value, set()
        for batch in batches:
            # Only these are read; others have no part in a comparison.
            batch = batch.filter(pa.array(known[_place(batch.column(2).to_numpy())]))
            offsets, data = utf8(batch.column(1))
            for first, last in slices(offsets):
                nodes, values, sizes, bits_of = [], [], [], []
                sets = shingle_sets(offsets[first : last + 1], data, words)
                for s, node in zip(sets, nodes_of(sets).tolist()):
                    if len(s) and node not in done:
                        done.add(node)
                        nodes.append(node)
                        values.append(s.tobytes())
                        sizes.append(len(s))
                        bits_of.append(parity(s))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(values, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits_of, pa.binary())],
                    ["node", "grams", "n", "parity"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("grams_a"), batch.column("grams_b")
        both, one, other = [], [], []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            s = np.sort(np.concatenate([x, y]), kind="stable")
            both.append(int(np.count_nonzero(s[1:] == s[:-1])))
            one.append(len(x))
            other.append(len(y))
        union = np.array(one, np.int64) + np.array(other, np.int64) - np.array(both, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "both", "either"])


def _possible(num: int, den: int):
    """Pairs whose parity bits leave it open that they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 10_000):
                part = batch.slice(first, 10_000)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(-1, PARITY // 8) for c in ("parity_a", "parity_b"))
                apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
                both = part.column("n_a").to_numpy() + part.column("n_b").to_numpy()
                keep = pa.array(apart <= both - 2 * -(-num * both // (num + den)))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])

    return run


def _sifted(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that may link, told from a few bytes of each set."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(_possible(num, den), "a long, b long")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, either) of each pair: sizes of intersection and union."""
    # Each set is moved once for each pair it is second in, and only sets that are in a pair.
    asked = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    sets = sets.select("node", "grams").join(asked, "node", "left_semi")
    held = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a"
    )
    return held.select("a", "b", "grams_a", "grams_b").mapInArrow(_shared, "a long, b long, both long, either long")


def _ordered(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _regions(postings: DataFrame, num: int, den: int) -> DataFrame:
    """(region, node, n, pos) of the documents that share an n-gram of their windows with one they could link to.

    The smaller of two linked documents shares one of its first ``n - ceil(2 * num * n / (num + den)) + 1``
    with the window of the larger. Large regions are cut into bands of size, each band with the next.
    """
    early = F.col("pos") <= F.col("n") - F.ceil(2 * num * F.col("n") / (num + den))
    by_size = Window.partitionBy("gram").orderBy("n")
    before = F.max(F.when(early, F.col("n"))).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    rows = postings.select("gram", "node", "n", "pos", early.alias("early"), before.alias("smaller"), F.lead("n").over(by_size).alias("larger"))
    near = (den * F.col("smaller") >= num * F.col("n")) | F.col("early") & (den * F.col("n") >= num * F.col("larger"))
    rows = rows.filter(near).select("gram", "node", "n", "pos", F.count("*").over(Window.partitionBy("gram")).alias("rows"))
    band = F.floor(F.log("n") / (float(np.log(den / num)) * 1.0001)).cast("long")
    bands = F.when(F.col("rows") > BANDED, F.array(band, band - 1)).otherwise(F.array(F.lit(-2).cast("long")))
    rows = rows.select("gram", "node", "n", "pos", F.explode(bands).alias("band"))
    return rows.select(F.xxhash64("gram", "band").alias("region"), "node", "n", "pos")


def _linked(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """All links of the nodes in ``rows`` (region, node, n, pos) as far as they matter for components.

    In the region of the first n-gram that two linked documents share, both have it among their first
    ``n - overlap + 1``, overlap being what their sizes need to link. Pairs are compared in such regions alone.
    """
    error = 1 - num / den
    links = None
    for turn in range(64):
        pivots = PIVOTS[min(turn, len(PIVOTS) - 1)]
        if links is None:
            labelled = rows.withColumn("label", F.col("node"))
        else:
            labels = components(links)
            labelled = rows.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        # A region's commonest component comes last among its pivots, and what is far from its centre after what
        # is near; regions of one component are done.
        share = labelled.groupBy("region", "label").agg(F.count("*").alias("m"))
        common = share.groupBy("region").agg(F.max_by("label", F.struct("m", "label")).alias("common"), F.count("*").alias("kinds"))
        order = Window.partitionBy("region").orderBy(F.col("label") == F.col("common"), "pos", F.xxhash64("node", F.lit(turn)))
        live = stage(
            labelled.join(common.filter("kinds > 1"), "region")
            .withColumn("rank", F.row_number().over(order))
            .withColumn("rows", F.count("*").over(Window.partitionBy("region")))
            .select("region", "node", "n", "pos", "label", "rank", "rows")
        )
        if live.isEmpty():
            return links
        split = (F.col("rows") > WIDE * pivots) & F.lit(pivots > 1)
        pivot = live.filter(F.col("rank") <= pivots).select("region", F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("pos").alias("ppos"), F.col("label").alias("plabel"), F.col("rank").alias("prank"))
        met = live.join(pivot, "region").filter((F.col("rank") > F.col("prank")))
        overlap = F.ceil(num * (F.col("n") + F.col("pn")) / (num + den))
        near = (F.col("pos") <= F.col("n") - overlap) & (F.col("ppos") <= F.col("pn") - overlap)
        # Sets of one size that share all are one set.
        near = near & (F.col("label") != F.col("plabel")) & ~((F.col("n") == F.col("pn")) & (overlap == F.col("n")))
        met = stage(met.filter(split | near).select("region", "node", "pivot", "rank", "rows"))
        pairs = stage(met.select(*_ordered("node", "pivot")).distinct())
        left = live.filter(F.col("rank") > pivots)
        # Cells need all distances of their regions.
        whole = pivots == 1 or left.filter(split).isEmpty()
        known = stage(_compare(stage(_sifted(pairs, sets, num, den)) if whole else pairs, sets))
        new = known.filter(den * F.col("both") >= num * F.col("either")).select("a", "b")
        links = new if links is None else links.union(new)
        wide = left.filter(split)
        if whole:
            rows = left.select("region", "node", "n", "pos")
            continue
        far = met.filter(split & (F.col("rank") > pivots)).withColumn("a", F.least("node", "pivot")).withColumn("b", F.greatest("node", "pivot"))
        far = far.join(known, ["a", "b"]).withColumn("d", 1 - F.col("both") / F.col("either"))
        far = far.withColumn("nearest", F.min("d").over(Window.partitionBy("region", "node")))
        cells = far.filter(F.col("d") <= F.col("nearest") + 2 * error + 1e-9).select("region", "node", "pivot")
        held = cells.groupBy("region").agg(F.count("*").alias("held"))
        use = wide.groupBy("region").agg(F.first("rows").alias("all")).join(held, "region").filter(F.col("held") <= 2 * F.col("all")).select("region")
        use = stage(use)
        n = left.select("region", "node", "n", "pos")
        inside = cells.join(use, "region", "left_semi").join(n, ["region", "node"]).select(F.xxhash64("region", "pivot").alias("region"), "node", "n", "pos")
        rows = stage(inside.union(n.join(use, "region", "left_anti")))
    raise RuntimeError("regions did not end")


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 8, den: int = 10
) -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id``.

    Words stand between ASCII white space, with A-Z lower-cased; a document's set has its distinct
    n-grams of ``words`` words. Documents link when ``den * |intersection| >= num * |union|``, counted on
    64-bit hashes of the n-grams. ``component_id`` is the smallest id reachable over links, the
    document's own included.

    A null or empty text, or one of white space, has an empty set, links with nothing and keeps its own
    id. Repeated rows stay repeated; rows of equal sets are linked whatever their ids; a null id is never
    the smallest unless all ids of the component are null. An empty table gives no rows. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    summary = stage(texts.mapInArrow(_summary(words), f"id {kind}, n long, node long, counters binary"))
    members = summary.filter("n >= 0").select("id", "n", "node")
    counters = spark.sparkContext.broadcast(_counters(summary))
    windows = texts.mapInArrow(_windows(words, num, den, counters), "node long, n long, grams array<bigint>")
    once = windows.groupBy("node").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    rows = stage(_regions(once.select("node", "n", F.posexplode("grams").alias("pos", "gram")), num, den))
    # The document with the smallest hashed id stands for its set. The filter's size is fixed.
    name = F.xxhash64("id")
    alone = members.filter("n > 0").groupBy("node").agg(F.min(name).alias("name"))
    alone = stage(alone.join(rows.select("node").distinct(), "node", "left_semi"))
    known = np.zeros(BITS, bool)
    for part in alone.select("name").mapInArrow(_places, "place int").distinct().toArrow().to_batches():
        known[part.column(0).to_numpy()] = True
    bits = spark.sparkContext.broadcast(known)
    sets = stage(texts.withColumn("name", name).mapInArrow(_wanted(words, bits), "node long, grams binary, n long, parity binary"))
    again = stage(sets.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node"))
    if not again.isEmpty():
        once = sets.join(again, "node", "left_semi").dropDuplicates(["node"])
        sets = stage(sets.join(again, "node", "left_anti").unionByName(once))
    links = _linked(rows, sets, num, den)
    smallest = members.groupBy("node").agg(F.min("id").alias("least"))
    if links is None:
        named = smallest.select("node", "least")
    else:
        of = smallest.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        of = stage(of)
        best = of.groupBy("component").agg(F.min("least").alias("best"))
        named = of.join(best, "component").select("node", F.col("best").alias("least"))
    # Only the distinct sets' names are joined back; a set of very many copies is split by the adaptive join.
    return members.join(stage(named), "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id")
    )
