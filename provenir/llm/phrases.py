"""Phrase collocations by dynamic itemset counting.

The texts are dealt into shards, which are scanned in turn, round and round. One scan counts phrases of
all lengths that are active at that moment. Words are active from the start. A longer phrase becomes
active after the scan in which the last of its two subphrases, without its last and without its first
word, has reached the threshold, and stays so for one full cycle of shards: each shard is counted once,
whichever came first, so its count is exact. Scanning ends when nothing is active.

Pairs have one more precondition: a table of counters over hashed pairs, counted during the first
cycle, must have reached the threshold in the pair's place. A counter is never below the pair's own
count, so no frequent pair is lost, and the many rare pairs of frequent words need no rows.

Tasks ask fixed-size bitsets of hashed phrases whether subphrases have reached the threshold. They may let
too much through, never too little; joins with the exact table of phrases decide. Phrases are named by
their words' 64-bit hashes side by side; two words with one hash, should that occur, are seen when
words are counted, and all is counted again with other hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import count
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import mix, slices, span_hashes, stage, utf8, word_spans
from provenir.session import stage_folder

#: Shards of the texts, words of a phrase at most, occurrences it needs.
SHARDS, LONGEST, LEAST = 3, 5, 100
#: Bits of a filter; counters of hashed pairs, of one byte; bytes of a piece in which either moves.
BITS, COUNTERS, PIECE = 1 << 26, 1 << 24, 1 << 16
#: A counter's place that has not reached the threshold.
NEVER = 255
#: Rows that a task keeps before it combines them.
KEPT = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[[0x20, 0x09]] = True

RAW = "lang string, key binary, word string, n long, place int, piece binary"
_KINDS = pa.schema([("lang", pa.string()), ("key", pa.binary()), ("word", pa.string()), ("n", pa.int64()), ("place", pa.int32()), ("piece", pa.binary())])


def _chain(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its beginning and its last word's."""
    return mix(h * np.uint64(0xD6E8FEB86659FD93) + word)


def _tie(lang: str) -> int:
    """A language's part in hashes."""
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _bit(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _pieces(table: np.ndarray) -> tuple[list[int], list[bytes]]:
    parts = table.reshape(-1, PIECE)
    some = np.flatnonzero(parts.any(axis=1))
    return some.tolist(), [zlib.compress(parts[i].tobytes(), 1) for i in some]


def _combined(rows: DataFrame, add: bool) -> np.ndarray:
    """The byte table whose pieces (place, piece) were made by many tasks: added up to 255, or bits united."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                new = np.frombuffer(zlib.decompress(piece.as_py()), np.uint8)
                old = held.get(place)
                if old is not None:
                    new = np.minimum(old.astype(np.uint16) + new, 255).astype(np.uint8) if add else old | new
                held[place] = new
        if held:
            out = [zlib.compress(x.tobytes(), 1) for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(out, pa.binary())], ["place", "piece"])

    found = rows.select("place", "piece").repartition("place").mapInArrow(run, "place int, piece binary").toArrow()
    table = np.zeros(COUNTERS if add else BITS // 4, np.uint8)
    for place, piece in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        table[place * PIECE : (place + 1) * PIECE] = np.frombuffer(zlib.decompress(piece), np.uint8)
    return table


def _texts(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The spans of ``data`` as strings."""
    sizes = stops - starts
    edges = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(edges[-1]) + np.repeat(starts - edges[:-1], sizes)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data[at])])


class _Tally:
    """Rows of counts, combined whenever there are many."""

    def __init__(self):
        self.parts: list[pa.Table] = []
        self.rows = 0

    def add(self, langs: list[str], codes: np.ndarray, key: pa.Array, word: pa.Array, n: pa.Array, place: pa.Array) -> None:
        if len(codes):
            lang = pa.array(langs, pa.string()).take(pa.array(codes))
            self.parts.append(pa.table([lang, key, word, n, place], names=["lang", "key", "word", "n", "place"]))
            self.rows += len(codes)

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.rows > KEPT:
            self._combine()
            if self.rows > KEPT // 2:
                yield from self.rest()

    def _combine(self) -> None:
        every = pa.concat_tables(self.parts).group_by(["lang", "key", "word"]).aggregate([("n", "sum"), ("place", "min")])
        self.parts = [every.rename_columns({"n_sum": "n", "place_min": "place"})]
        self.rows = every.num_rows

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._combine()
            every = self.parts[0].append_column("piece", pa.nulls(self.rows, pa.binary())).select(_KINDS.names)
            yield from every.cast(_KINDS).combine_chunks().to_batches()
        self.parts, self.rows = [], 0


def _keys(h: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    """The words' hashes side by side, of the phrases of ``k`` words that begin ``at``."""
    flat = np.ascontiguousarray(np.stack([h[at + j] for j in range(k)], axis=1) if len(at) else np.zeros((0, k), np.uint64))
    edges = np.arange(len(at) + 1, dtype=np.int32) * (8 * k)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(flat.astype("<u8").tobytes())])


def _scan(step: int, shards: int, seed: int, filters):
    """Counts of one shard: words and pair counters in the first cycle, longer phrases that may be active."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, when = filters.value
        known, recent = bits[: BITS // 8], bits[BITS // 8 :]
        first_cycle = step < shards
        tally, seen = _Tally(), np.zeros(COUNTERS if first_cycle else 0, np.uint8)
        for batch in batches:
            named = batch.column(0).dictionary_encode()
            langs, codes = named.dictionary.to_pylist(), named.indices.to_numpy()
            ties = np.array([_tie(x) for x in langs], np.uint64)
            offsets, data = utf8(batch.column(1))
            for first, last in slices(offsets):
                part = _LOWER[data[offsets[first] : offsets[last]]]
                ends = offsets[first + 1 : last + 1] - offsets[first]
                starts, stops = word_spans(part, _SEPARATOR, ends)
                if not len(starts):
                    continue
                h = mix(span_hashes(part, starts, stops) + np.uint64(seed))
                row = np.searchsorted(ends, starts, side="right")
                lang = codes[first + row]
                tie = ties[lang]
                if first_cycle:
                    every = pa.table([pa.array(lang), _texts(part, starts, stops), pa.array(h)], names=["lang", "word", "h"])
                    once = every.group_by(["lang", "word"]).aggregate([("h", "min"), ("h", "count")])
                    hashes = once["h_min"].to_numpy()
                    tally.add(
                        langs, once["lang"].to_numpy(), _keys(hashes, np.arange(len(hashes)), 1), once["word"].combine_chunks(),
                        once["h_count"].combine_chunks(), pa.nulls(len(hashes), pa.int32()),
                    )
                breaks = np.cumsum(_BREAK[part])[starts]
                alive = np.zeros(len(h), bool)
                alive[:-1] = (breaks[1:] == breaks[:-1]) & (row[1:] == row[:-1])
                at, chained = np.flatnonzero(alive), h
                if first_cycle:
                    pair = _chain(h[at], h[at + 1]) ^ tie[at]
                    which, n = np.unique((pair & np.uint64(COUNTERS - 1)).astype(np.int64), return_counts=True)
                    seen[which] = np.minimum(seen[which] + n, 255)
                place = _bit(h ^ tie)
                alive, late = _set(known, place), _set(recent, place)
                for k in range(2, LONGEST + 1):
                    at = at[alive[at] & alive[at + 1]] if k == 2 else np.flatnonzero(alive[:-1] & alive[1:])
                    if not len(at):
                        break
                    value = _chain(chained[at], h[at + k - 1])
                    active = late[at] | late[at + 1]
                    met = np.full(len(at), -1, np.int32)
                    if k == 2:
                        met = when[((value ^ tie[at]) & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.int32)
                        active = (met < NEVER) & (active | (met >= step - shards))
                    some = at[active]
                    tally.add(
                        langs, lang[some], _keys(h, some, k), pa.nulls(len(some), pa.string()), pa.array(np.ones(len(some), np.int64)), pa.array(met[active])
                    )
                    place = _bit(value ^ tie[at])
                    alive, late, chained = np.zeros(len(h), bool), np.zeros(len(h), bool), np.zeros(len(h), np.uint64)
                    alive[at], late[at], chained[at] = _set(known, place), _set(recent, place), value
                yield from tally.full()
        yield from tally.rest()
        places, pieces = _pieces(seen) if first_cycle else ([], [])
        if places:
            none = lambda kind: pa.nulls(len(places), kind)
            yield pa.RecordBatch.from_arrays(
                [none(pa.string()), none(pa.binary()), none(pa.string()), pa.array([-1] * len(places), pa.int64()), pa.array(places, pa.int32()), pa.array(pieces, pa.binary())],
                schema=_KINDS,
            )

    return run


def _marks(since: int):
    """Bits of the phrases that have reached the threshold; in the second half those that did so at ``since`` or later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, any_row = np.zeros(2 * BITS // 8, np.uint8), False
        ties: dict[str, int] = {}
        for batch in batches:
            langs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            reached = batch.column(2).to_numpy()
            lengths = np.array([len(x) // 8 for x in keys], np.int64)
            for k in np.unique(lengths):
                rows = np.flatnonzero(lengths == k)
                words = np.frombuffer(b"".join(keys[i] for i in rows), "<u8").reshape(-1, k)
                h = words[:, 0].copy()
                for j in range(1, k):
                    h = _chain(h, words[:, j])
                tie = np.array([ties.setdefault(langs[i], _tie(langs[i])) for i in rows], np.uint64)
                at = _bit(h ^ tie)
                for base, some in ((0, at), (BITS // 8, at[reached[rows] >= since])):
                    np.bitwise_or.at(bits, base + (some >> 3), (1 << (some & 7)).astype(np.uint8))
                any_row = True
        if any_row:
            places, pieces = _pieces(bits)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(pieces, pa.binary())], ["place", "piece"])

    return run


def count_phrases(docs: DataFrame, least: int = LEAST, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The phrases of one to five words that occur ``least`` times, and the word counts of each language.

    The first has (lang, key, word, n): the words' hashes side by side, the words, the occurrences. The
    second has (lang, n).
    """
    spark = docs.sparkSession
    path = f"{stage_folder(spark)}/{uuid4().hex}"
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        # Rows are dealt in turn, so that copies and hot sources are spread.
        F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"),
    )
    texts.write.partitionBy("shard").parquet(path)
    texts = spark.read.schema(texts.schema).parquet(path)
    for seed in count():
        found = _cycles(texts, least, shards, int(mix(np.array([seed], np.uint64))[0]))
        if found is not None:
            return found


def _cycles(texts: DataFrame, least: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame] | None:
    """All scans with one set of word hashes; None when two words have the same."""
    spark = texts.sparkSession
    length = F.length("key") / 8
    held, totals = None, None
    bits, counters = np.zeros(2 * BITS // 8, np.uint8), np.zeros(COUNTERS, np.uint8)
    when = np.full(COUNTERS, NEVER, np.uint8)
    step = 0
    while step < 2 * shards or bits[BITS // 8 :].any():
        filters = spark.sparkContext.broadcast((bits, when))
        raw = stage(texts.filter(F.col("shard") == step % shards).select("lang", "text").mapInArrow(_scan(step, shards, seed, filters), RAW))
        now = raw.filter("n > 0").groupBy("lang", "key").agg(
            F.sum("n").alias("n"), F.max("word").alias("word"), (F.min("word") != F.max("word")).alias("clash"), F.min("place").alias("place")
        )
        none = F.lit(None).cast("int")
        new = now.filter(length == 1).select("lang", "key", "n", "word", F.lit(0).alias("start"), none.alias("reached"), "clash")
        if held is not None:
            had = held.filter("reached is not null").select("lang", F.col("key").alias("part"), F.col("word").alias("says"), F.col("reached").alias("at"))
            parts = now.filter(length > 1).withColumn("begin", F.expr("substring(key, 1, length(key) - 8)")).withColumn("end", F.expr("substring(key, 9)"))
            longer = parts.join(had.select("lang", F.col("part").alias("begin"), F.col("says").alias("first"), F.col("at").alias("one")), ["lang", "begin"])
            longer = longer.join(had.select("lang", F.col("part").alias("end"), F.col("says").alias("second"), F.col("at").alias("other")), ["lang", "end"])
            longer = longer.withColumn("start", F.greatest("one", "other", F.coalesce("place", F.lit(-1))) + 1)
            longer = longer.filter((F.col("start") <= step) & (F.col("start") + shards > step))
            text = F.concat("first", F.lit(" "), F.substring_index("second", " ", -1))
            new = held.unionByName(new).unionByName(longer.select("lang", "key", "n", text.alias("word"), "start", none.alias("reached"), F.lit(False).alias("clash")))
        every = new.groupBy("lang", "key").agg(
            F.sum("n").alias("n"),
            F.max("word").alias("word"),
            F.max("start").alias("start"),
            F.coalesce(F.max("reached"), F.when(F.sum("n") >= least, F.lit(step))).alias("reached"),
            (F.max("clash") | (F.min("word") != F.max("word"))).alias("clash"),
        )
        held = stage(every)
        if step == shards - 1:
            if not held.filter("clash").isEmpty():
                return None
            totals = held.filter(length == 1).groupBy("lang").agg(F.sum("n").alias("n"))
        held = held.filter(F.col("reached").isNotNull() | (F.col("start") + shards - 1 > step))
        if step < shards:
            more = _combined(raw.filter("n < 0"), add=True)
            counters = np.minimum(counters.astype(np.uint16) + more, 255).astype(np.uint8)
            when[(when == NEVER) & (counters >= min(least, 255))] = step
        step += 1
        marked = held.filter(F.col("reached").isNotNull() & (length < LONGEST)).select("lang", "key", "reached")
        bits = _combined(marked.mapInArrow(_marks(step - shards), "place int, piece binary"), add=False)
        filters.destroy()
    return held.select("lang", "key", "word", "n"), totals


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = 2_000, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Texts are split at ``.,;:!?`` and line ends, words at spaces and tabs, A-Z lower-cased. Candidates are
    phrases of two to five words with at least ``least`` occurrences ``a``. Of the cuts in two, that with
    the lowest ``floor(1000 * a * n / (l * r))`` counts, the shortest first part on ties; ``n`` are the
    language's words, ``l`` and ``r`` the occurrences of the parts. A candidate within a longer one that
    occurs as often is dropped: every occurrence of the longer one is one of the shorter, so that one
    more word tells. Ranks go by score and ``a``, both descending, then by the phrase.

    A null language is ``und``, also together with texts so labelled. Null, empty and blank texts have no
    words; repeated rows count as often as they stand there. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    phrases, totals = count_phrases(docs, least, shards, lang_col, text_col)
    words = (F.length("key") / 8).cast("int")
    found = phrases.filter(words > 1)
    inner = found.select("lang", F.explode(F.array(F.expr("substring(key, 1, length(key) - 8)"), F.expr("substring(key, 9)"))).alias("key"), "n")
    kept = found.join(inner.filter(F.length("key") > 8).distinct(), ["lang", "key", "n"], "left_anti")
    cuts = kept.select("lang", "key", F.col("word").alias("phrase"), F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), words - 1)).alias("k"))
    cuts = cuts.withColumn("begin", F.expr("substring(key, 1, 8 * k)")).withColumn("end", F.expr("substring(key, 8 * k + 1)"))
    part = lambda key, n: phrases.select("lang", F.col("key").alias(key), F.col("n").alias(n))
    cuts = cuts.join(part("begin", "l"), ["lang", "begin"]).join(part("end", "r"), ["lang", "end"]).join(totals, "lang")
    exact = "(cast(a as decimal(19,0)) * 1000 * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    cuts = cuts.withColumn("score", F.expr(exact))
    best = cuts.groupBy("lang", "key").agg(
        F.first("phrase").alias("phrase"), F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return rows.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
