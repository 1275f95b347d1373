"""Benchmark decontamination by word occupancy and longest common subsequences.

A document holds an item if, around one of its passages, the longest common subsequence of its words and
the item's covers enough of the item and of the item's answer, so an edited copy is found and a text of
the same words in another order is not. No such subsequence is longer than the number of the item's words
that occur at all, so that number is counted first: texts are cut into overlapping segments, each of them
as long as two windows, and a matrix of words by items is summed over a segment's distinct words. Only
segments that reach the share of the item are compared in order. The bound is exact: it knows no weights,
no frequencies and no rank, so what is found depends on the text and the item alone.

Texts are read once for each block of the benchmark, in the task that has them; nothing is shuffled but matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import slices, stage, utf8, word_hashes

#: Words of half a passage; passages overlap by half.
HALF = 32
#: A benchmark item longer than this is cut into passages of it, overlapping by half.
ITEM_WORDS = 96
#: The benchmark is taken in blocks of at most so many passages and words: what is broadcast is bounded, and a word's
#: number has two bytes.
BLOCK_PASSAGES, BLOCK_WORDS = 2_048, 65_535
#: Least shares of the item and of its answer in order.
ORDERED, ANSWERED = 0.6, 0.5
#: Items of fewer words have to be there whole.
SHORT = 8
#: Items up to these numbers of words are looked for in segments of one length.
SIZES = (16, 32, 64, ITEM_WORDS)
#: Bytes gathered at once from the matrix of words by items.
_GATHERED = 16_000_000

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class Block(NamedTuple):
    """Passages of the benchmark: their word numbers (from 1), of what item, and how many words are the answer's."""

    terms: np.ndarray  # sorted hashes; number i + 1
    words: list[np.ndarray]
    items: list
    answers: list[int]


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows, with the hashes of their words and the row each one is in."""
    offsets, data = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    for first, last in slices(offsets):
        ends = offsets[first + 1 : last + 1] - offsets[first]
        hashes, starts = word_hashes(data[offsets[first] : offsets[last]], _SEPARATOR, ends)
        yield first, last, hashes, np.searchsorted(ends, starts, side="right")


def _answer(text: str) -> str:
    """What stands after the last line end, or else the last sentence end, before the text's own end."""
    body = text.rstrip().rstrip(".!?")
    cut = max(body.rfind("\n"), -1)
    if cut < 0:
        cut = max(body.rfind(mark) for mark in ".!?")
    return body[cut + 1 :]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark's passages in blocks; items are read one by one."""
    found: list[tuple[object, np.ndarray, int]] = []
    held = 0
    for row in benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).orderBy("item", "text").toLocalIterator():
        text = row["text"] or ""
        sides = [h for _, _, h, _ in words_of(pa.array([text]))]
        own = np.concatenate(sides) if sides else np.zeros(0, np.uint64)
        tail = sum(len(h) for _, _, h, _ in words_of(pa.array([_answer(text)])))
        starts = range(0, max(len(own) - ITEM_WORDS // 2, 1), ITEM_WORDS // 2) if len(own) > ITEM_WORDS else [0]
        for at in starts:
            piece = own[at : at + ITEM_WORDS]
            if not len(piece):
                continue
            if found and (len(found) >= BLOCK_PASSAGES or held + len(piece) > BLOCK_WORDS):
                yield _block(found)
                found, held = [], 0
            # Only the passage at the end of an item has the answer.
            found.append((row["item"], piece, min(tail, len(piece)) if at + ITEM_WORDS >= len(own) else 0))
            held += len(piece)
    if found:
        yield _block(found)


def _block(found: list[tuple[object, np.ndarray, int]]) -> Block:
    terms = np.unique(np.concatenate([w for _, w, _ in found]))
    return Block(terms, [(np.searchsorted(terms, w) + 1).astype(np.uint16) for _, w, _ in found], [i for i, _, _ in found], [a for _, _, a in found])


class Kind(NamedTuple):
    """Items of about one length: half the segments' length, the items, the words each needs, words by items."""

    half: int
    which: np.ndarray
    need: np.ndarray
    count: np.ndarray


def _kinds(block: Block) -> list[Kind]:
    size = np.array([len(w) for w in block.words])
    out = []
    for low, high in zip((0, *SIZES), SIZES):
        which = np.flatnonzero((size > low) & (size <= high))
        if len(which):
            count = np.zeros((len(block.terms) + 1, len(which)), np.uint8)
            for k, i in enumerate(which):
                np.add.at(count[:, k], block.words[i], 1)
            out.append(Kind(2 * HALF + 2 * high, which, np.array([_need(int(m)) for m in size[which]], np.uint8), count))
    return out


def _need(words: int) -> int:
    return words if words < SHORT else math.ceil(ORDERED * words)


def _segments(number: np.ndarray, edge: np.ndarray, kinds: list[Kind]) -> Iterator[tuple[int, int, int, int]]:
    """(row, first word, end, item) of the segments that have enough of the item's words, in any order.

    Segments of two halves start at every half, so every window of at most a half lies in one of them.
    """
    at = np.flatnonzero(number)
    if not len(at):
        return
    word = number[at]
    row = np.searchsorted(edge, at, side="right") - 1
    place = at - edge[row]
    # Where the word stood last in the same document; -1 if nowhere.
    order = np.lexsort((at, word, row))
    same = (word[order][1:] == word[order][:-1]) & (row[order][1:] == row[order][:-1])
    before = np.full(len(at), -1)
    before[order[1:][same]] = place[order[:-1][same]]
    for kind in kinds:
        for shift in (0, kind.half):
            start = (place - shift) // (2 * kind.half) * (2 * kind.half) + shift
            new = np.flatnonzero((before < start) & (place >= shift))
            if not len(new):
                continue
            first = np.flatnonzero(np.concatenate([[True], (start[new][1:] != start[new][:-1]) | (row[new][1:] != row[new][:-1])]))
            ends = np.append(first[1:], len(new))
            most = max(_GATHERED // len(kind.which), 1)
            k = 0
            while k < len(first):
                last = max(int(np.searchsorted(ends, first[k] + most, side="right")), k + 1)
                part = new[first[k] : ends[last - 1]]
                total = np.add.reduceat(kind.count[word[part]], first[k:last] - first[k], axis=0, dtype=np.uint8)
                for i, j in zip(*np.nonzero(total >= kind.need)):
                    one = new[first[k + i]]
                    yield int(row[one]), int(start[one]), int(start[one]) + 2 * kind.half, int(kind.which[j])
                k = last


def _places(item: np.ndarray) -> dict[int, int]:
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    return places


def ordered(text: np.ndarray, item: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of ``item``."""
    return _ordered(text.tolist(), _places(item), len(item))


def _ordered(text: list[int], places: dict[int, int], size: int) -> int:
    full = (1 << size) - 1
    row = full
    for w in text:
        here = places.get(w)
        if here:
            met = row & here
            row = ((row + met) | (row - met)) & full
    return size - row.bit_count()


def cosine(passage: np.ndarray, item: np.ndarray) -> float:
    """Of the numbers of words; words that the benchmark lacks (0) count as different ones."""
    known, n = np.unique(passage[passage > 0], return_counts=True)
    own, m = np.unique(item, return_counts=True)
    _, a, b = np.intersect1d(known, own, assume_unique=True, return_indices=True)
    square = int((n**2).sum()) + int((passage == 0).sum())
    return float((n[a] * m[b]).sum() / np.sqrt(float(square) * float((m**2).sum()))) if square else 0.0


def _matches(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        kinds = _kinds(own)
        places = [_places(w) for w in own.words]
        tails = [_places(w[len(w) - tail :]) for w, tail in zip(own.words, own.answers)]
        schema = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        for batch in batches:
            for first, last, hashes, row in words_of(batch.column(2)):
                at = np.minimum(np.searchsorted(own.terms, hashes), len(own.terms) - 1)
                number = np.where(own.terms[at] == hashes, at + 1, 0).astype(np.uint16)
                edge = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=last - first))])
                best: dict[tuple[int, int], tuple] = {}
                for doc, begin, end, which in _segments(number, edge, kinds):
                    words = own.words[which]
                    m, need = len(words), _need(len(words))
                    text = number[edge[doc] : edge[doc + 1]]
                    if _ordered(text[begin:end].tolist(), places[which], m) < need:
                        continue
                    for start in range(-(-begin // HALF) * HALF, min(end, len(text)), HALF):
                        low, high = max(0, start - m), min(len(text), start + 2 * HALF + m)
                        if low < begin or high > end:
                            continue
                        here = text[low:high].tolist()
                        found = _ordered(here, places[which], m)
                        if found < need:
                            continue
                        tail = own.answers[which]
                        answer = _ordered(here, tails[which], tail) / tail if tail else 1.0
                        if answer < ANSWERED:
                            continue
                        near = cosine(text[start : start + 2 * HALF], words)
                        rank = (found / m, near, -start)
                        if rank > best.get((doc, which), ((-1.0,),))[0]:
                            best[doc, which] = (rank, (first + doc, which, low, high, near, found / m, answer))
                rows = [x for _, x in best.values()]
                if rows:
                    at, *rest = zip(*rows)
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, t) for c, t in zip(rest, schema[1:]))],
                        ["id", "key", "passage", "first_word", "end_word", "cosine", "in_order", "answer"],
                    )

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("key"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def _search(docs: DataFrame, block: Block, kind: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)
    return docs.mapInArrow(
        _matches(sent),
        f"id {kind}, key long, passage int, first_word long, end_word long, cosine double, in_order double, answer double",
    )


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for block in blocks_of(benchmark, item_col, item_text_col):
        names = spark.createDataFrame([(i, x) for i, x in enumerate(block.items)], f"passage int, item {item_kind}")
        new = stage(_search(_keyed(docs, id_col, text_col), block, kind).join(names, "passage").drop("passage"))
        out = new if out is None else out.union(new)
    if out is None:
        return spark.createDataFrame([], f"id {kind}, key long, first_word long, end_word long, cosine double, in_order double, answer double, item {item_kind}")
    return out


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The benchmark items found in each document.

    Columns: the document's id and the item's, ``first_word`` and ``end_word`` (where it was looked for),
    ``cosine``, ``in_order`` and ``answer`` (shares of the item and of its answer that stand there in
    order); the best place of each pair. Words are runs of letters and digits, lower-cased.

    A null or empty text holds nothing, and an item without words is in nothing. Repeated documents give
    one row, items of equal texts are all reported. Either table may be empty. Other columns are ignored.
    """
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col)
    best = F.max_by(F.struct("first_word", "end_word", "cosine", "in_order", "answer"), F.struct("in_order", "cosine", -F.col("first_word")))
    # Passages of one long item are one match; repeated documents have one row.
    found = found.groupBy("id", "key", "item").agg(best.alias("b")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.*")
    return found


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents in which an item was found; see ``matches``."""
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col)
    keys = stage(found.select(F.col("key").alias("_key")).distinct())
    key = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    return docs.join(keys, key == keys["_key"], "left_anti")
