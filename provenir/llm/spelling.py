"""Spelling variants: words one edit apart, by a bit-sliced position index over the vocabulary.

For each position and letter the index holds a bitset over the words of a block: those with that letter
there. A word is followed letter by letter against all words of the block at once, 64 to a machine word.
Three sets move along: words that agree so far; words with one letter replaced so far; words with one
letter more so far, whose positions are shifted by one. Words with a letter less need no set of their
own: they find the longer word and the pair counts for both.

Blocks are made from regions, so that the work does not grow with the square of the vocabulary. One edit
lies in the left or in the right half of a word, and leaves the other half as it is: words are dealt to
the regions of either half, for their own length and the one below. Regions of more than ``REGION``
words are halved again around the edit until they are small or one letter is left free, so a region is
bounded by the alphabet and not by the table. A pair is reported in the one region that holds its first
difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a word at least, and a text's letters.
LEAST = 7
LETTERS = "[A-Za-zÀ-ÿ]"
#: Words from which a region is halved, words of an index block, words followed at once.
REGION, BLOCK, TOGETHER = 4_096, 2_048, 2_048
#: Letters of a block, which ends blocks of very long words.
BYTES = 1_000_000


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 31) -> DataFrame:
    """(word, n): the words of at least ``LEAST`` letters that occur at least twice.

    Words are runs of letters of the whole texts, A-Z lower-cased. Where ``every`` divides the crc32 of
    ``<id>:<word>``, the letter at that crc32 modulo the length is left out. A null id counts as empty.
    """
    text = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(f"({LETTERS}{{{LEAST},}})"), 1)).alias("run"),
    )
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")


class Index:
    """The bitsets of a block of words, made position by position."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        """``codes``: letters by word and position, 0 beyond a word's end."""
        self.letters, compact = np.unique(codes, return_inverse=True)
        self.compact = compact.reshape(codes.shape)
        self.lengths = lengths
        self.width = -(-len(codes) // 64)

    def bits(self, mask: np.ndarray) -> np.ndarray:
        """Boolean rows over the words as rows of 64-bit machine words."""
        out = np.zeros((len(mask), 8 * self.width), np.uint8)
        packed = np.packbits(mask, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def position(self, p: int) -> np.ndarray:
        """The bitsets of all letters at position ``p``."""
        return self.bits(self.compact[:, p] == np.arange(len(self.letters))[:, None])

    def near(self, asked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) places of words of ``length`` or one more, exactly one edit from rows of the block.

        ``asked`` are places of words of ``length`` in the block.
        """
        shape = (len(asked), self.width)
        same = np.full(shape, ~np.uint64(0))
        replaced, added = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        here = self.position(0)
        for p in range(length):
            after = self.position(p + 1)
            code = self.compact[asked, p]
            match, shifted = here[code], after[code]
            added |= same
            added &= shifted
            replaced &= match
            replaced |= same & ~match
            same &= match
            here = after
        lengths = self.bits(np.stack([self.lengths == length, self.lengths == length + 1]))
        found = replaced & lengths[0] | (added | same) & lengths[1]
        row, place = np.nonzero(found)
        bits = np.unpackbits(found[row, place].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(bits)
        return row[which], place[which] * 64 + bit


def _pairs(words: list[bytes], groups: np.ndarray, length: int, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of near words of one group whose first difference lies behind ``left`` and before ``right`` letters."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.zeros((len(words), length + 1), np.uint8)
    flat = np.frombuffer(b"".join(words), np.uint8)
    codes[np.arange(length + 1) < lengths[:, None]] = flat
    asked = np.flatnonzero(lengths == length)
    one, other = [], []
    for at in range(0, len(words), BLOCK):
        index = Index(codes[at : at + BLOCK], lengths[at : at + BLOCK])
        for first in range(0, len(asked), TOGETHER):
            some = asked[first : first + TOGETHER]
            if at == 0 and len(words) <= BLOCK:
                row, place = index.near(some, length)
            else:
                # Words of other blocks come as further words of the block, and answers among them are dropped.
                both = Index(np.vstack([codes[at : at + BLOCK], codes[some]]), np.concatenate([lengths[at : at + BLOCK], np.zeros(len(some), np.int64)]))
                row, place = both.near(np.arange(len(some)) + len(index.lengths), length)
            a, b = some[row], place + at
            keep = (groups[a] == groups[b]) & ((lengths[b] > length) | (a < b))
            one.append(a[keep])
            other.append(b[keep])
    a, b = np.concatenate(one or [np.zeros(0, np.int64)]), np.concatenate(other or [np.zeros(0, np.int64)])
    differs = codes[a] != codes[b]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    keep = (first >= left) & ((first < length - right) | (right == 0))
    return a[keep], b[keep]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, n): rows come by (length, left, right, key); whole regions go into blocks."""
    shape, keys, words, ns = None, [], [], []

    def flush():
        if len(words) > 1:
            raw = [w.encode("latin-1") for w in words]
            _, groups = np.unique(np.array(keys, object), return_inverse=True)
            a, b = _pairs(raw, groups, *shape)
            text, n = pa.array(words, pa.string()), pa.array(ns, pa.int64())
            a, b = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
            yield pa.RecordBatch.from_arrays([text.take(a), text.take(b), n.take(b)], ["word", "near", "n"])
        for x in (keys, words, ns):
            x.clear()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("length", "left", "right", "key", "word", "n")]
        for *now, key, word, n in zip(*columns):
            full = len(words) >= BLOCK or len(words) * now[0] >= BYTES
            if now != shape or full and key != keys[-1]:
                yield from flush()
                shape = now
            keys.append(key)
            words.append(word)
            ns.append(n)
    yield from flush()


def _halves(rows: DataFrame) -> DataFrame:
    """Every region's words again, by the left and by the right half of its free letters."""
    free = F.col("length") - F.col("left") - F.col("right")
    half = (free / 2).cast("int")
    kinds = F.array(
        F.struct((F.col("left") + half).alias("left"), F.col("right").alias("right")),
        F.struct(F.col("left").alias("left"), (F.col("right") + free - half).alias("right")),
    )
    rows = rows.select("word", "n", "length", F.explode(kinds).alias("zone")).select("word", "n", "length", "zone.left", "zone.right")
    end = F.length("word") - F.col("right") + 1
    key: Column = F.concat(F.substring("word", F.lit(1), F.col("left")), F.lit(" "), F.substring("word", end, F.col("right")))
    return rows.withColumn("key", key)


def near_words(words: DataFrame, least: int = 2) -> DataFrame:
    """(word, near, n): all pairs of ``words`` (word, n) exactly one edit apart, both ways, ``n`` of the near one.

    No word has fewer than ``least`` letters.
    """
    size = F.length("word")
    lengths = F.explode(F.filter(F.array(size, size - 1), lambda x: x >= least)).alias("length")
    open_rows = _halves(words.select("word", "n", lengths).select("*", F.lit(0).alias("left"), F.lit(0).alias("right")))
    region = ["length", "left", "right", "key"]
    done = None
    while True:
        open_rows = stage(open_rows)
        many = F.col("length") - F.col("left") - F.col("right") > 1
        large = stage(open_rows.groupBy(*region).agg(F.count("*").alias("m")).filter((F.col("m") > REGION) & many).select(*region))
        ready = open_rows.join(large, region, "left_anti") if not large.isEmpty() else open_rows
        done = ready if done is None else done.unionByName(ready)
        if large.isEmpty():
            break
        open_rows = _halves(open_rows.join(large, region, "left_semi"))
    sorted_rows = done.select(*region, "word", "n").repartition(*region).sortWithinPartitions(*region)
    return sorted_rows.mapInArrow(_found, "word string, near string, n long")


def variants(words: DataFrame, times: int = 10, least: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point. ``form`` is the near word
    with the largest n (ties: the first in code-point order) if that is at least ``times`` the word's n;
    ``root`` is where forms lead, the word itself if it has none. Words are distinct, not null and of at
    least ``least`` letters up to U+00FF; an empty table gives no rows.
    """
    near = near_words(words, least).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("near"))).alias("best")
    )
    most = -F.col("best.less")
    formed = F.coalesce(most >= times * F.col("n"), F.lit(False))
    out = stage(
        words.join(near, "word", "left").select(
            "word",
            F.when(formed, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, most).alias("form_n"),
        )
    )
    # n grows at least ``times``-fold with each form, so chains are short; each round doubles what is followed.
    roots = stage(out.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = stage(roots.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        roots = after.select("word", "root")
        if after.filter("moved").isEmpty():
            break
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the ``vocabulary`` of ``docs``.

    Null and empty texts have no words. Repeated rows are counted as often as they stand there. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    return variants(stage(vocabulary(docs, id_col, text_col)), least=LEAST)
