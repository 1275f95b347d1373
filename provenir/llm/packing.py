"""Packing of token sequences: best-fit decreasing over a histogram of piece lengths.

A document's ids are cut into full windows and one remainder. Best-fit decreasing only looks at
lengths, and there are at most ``capacity`` of them, so the whole corpus is packed from the counts of
its lengths: a segment tree over remaining capacities finds the tightest open windows, and equal
windows are filled together as ranges. Each piece then finds its window by its rank among the pieces
of its length. Neither texts nor ids are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import slices, stage, utf8

CAPACITY = 1024
#: Distinct words whose ids one Python worker remembers; beyond that it keeps the half used most often.
REMEMBERED = 300_000
#: Bytes of text tokenized at once; new words are learned once each time.
_AT_ONCE = 2_000_000
_JOINED = 20_000


class _Entries(dict):
    """Numbers of words; one that is looked up first gets the next number, which both kinds of words share."""

    peer: _Entries

    def __init__(self, first: int):
        self.next, self.new = first, []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = self.next
        self.next = self.peer.next = number + 1
        self.new.append((word, number))
        return number


def _is_odd(word: bytes) -> bool:
    """Whether a word is empty, or begins or ends with white space, so that its text is tokenized whole."""
    if word and 0x20 < word[0] < 0x7F and 0x20 < word[-1] < 0x7F:
        return False
    t = word.decode()
    return not t or t[0].isspace() or t[-1].isspace()


class WordIds:
    """Ids of whole texts, each distinct word tokenized once.

    The tokenizer's pre-tokens never reach over white space that follows a word, so a text may be cut
    before any single space and around any single newline. Texts with adjacent white space, and words
    that begin or end with other white space, are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        added = {i: x.content for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.width = np.array(
            [len(added[i].encode()) if i in added else len(self.tokenizer.id_to_token(i)) for i in range(size)]
        )
        self.clear()

    def clear(self) -> None:
        # Entry 0 is a newline.
        newline = self._plain("\n")
        self.spaced, self.bare = _Entries(1), _Entries(1)
        self.spaced.peer, self.bare.peer = self.bare, self.spaced
        self.start, self.length, self.pool = np.array([0]), np.array([len(newline)]), newline
        self.odd, self.used = np.zeros(1, bool), np.zeros(1, np.int64)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def forget(self) -> None:
        """Keep the words used most often, half of those remembered at most."""
        every = np.argsort(-self.used[1:], kind="stable")[: REMEMBERED // 2] + 1
        keep = np.sort(every[self.used[every] > 1])
        place = np.zeros(len(self.used), np.int64)
        place[keep] = np.arange(1, len(keep) + 1)
        for known in (self.spaced, self.bare):
            words = [(w, n) for w, k in known.items() if (n := int(place[k]))]
            known.clear()
            known.update(words)
        self.spaced.next = self.bare.next = len(keep) + 1
        keep = np.concatenate([[0], keep])
        start, length = self.start[keep], self.length[keep]
        ends = np.cumsum(length)
        self.pool = self.pool[np.repeat(start - ends + length, length) + np.arange(ends[-1])]
        self.start, self.length, self.odd, self.used = ends - length, length, self.odd[keep], self.used[keep] // 2

    def _learn(self, known: _Entries, spaced: bool) -> None:
        """Ids of the words that ``known`` met since, each under its number."""
        new, known.new = known.new, []
        odd = [_is_odd(w) for w, _ in new]
        places = np.array([k for _, k in new], np.int64)
        self.odd[places] = odd
        plain = [x for x, o in zip(new, odd) if not o]
        for k in range(0, len(plain), _JOINED):
            part = [w for w, _ in plain[k : k + _JOINED]]
            place = np.array([n for _, n in plain[k : k + _JOINED]])
            text = b" " + b" ".join(part) if spaced else b"\n".join(part)
            ids = self._plain(text.decode())
            ends = np.cumsum(self.width[ids])
            sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
            last = np.cumsum(sizes) - (0 if spaced else 1)
            first = last - sizes + (0 if spaced else 1)
            a, b = np.searchsorted(ends - self.width[ids], first), np.searchsorted(ends, last) + 1
            self.start[place] = a + len(self.pool)
            self.length[place] = b - a
            self.pool = np.concatenate([self.pool, ids])

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.spaced) + len(self.bare) > REMEMBERED:
            self.forget()
        # A look-up numbers a word that is not known.
        after, head = self.spaced.__getitem__, self.bare.__getitem__
        entries, counts = [], []
        for t in texts:
            own: list[int] = []
            for line in t.split(b"\n"):
                words = line.split(b" ")
                own.append(head(words[0]))
                own.extend(map(after, words[1:]))
                own.append(0)
            own.pop()
            entries.append(np.array(own, np.int64))
            counts.append(len(own))
        more = self.spaced.next - len(self.start)
        zeros = np.zeros(more, np.int64)
        self.start, self.length = np.concatenate([self.start, zeros]), np.concatenate([self.length, zeros])
        self.odd, self.used = np.concatenate([self.odd, zeros.astype(bool)]), np.concatenate([self.used, zeros])
        self._learn(self.spaced, True)
        self._learn(self.bare, False)
        entry = np.concatenate(entries) if entries else np.zeros(0, np.int64)
        self.used += np.bincount(entry, minlength=len(self.used))
        length = self.length[entry]
        ends = np.cumsum(length)
        flat = self.pool[np.repeat(self.start[entry] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        at = np.concatenate([[0], ends])[edges]
        whole = np.add.reduceat(self.odd[entry], edges[:-1], dtype=np.int64) > 0 if len(counts) else []
        return [
            (self._plain(t.decode()) if t and whole[k] else flat[at[k] : at[k + 1]]) for k, t in enumerate(texts)
        ]


class CapacityTree:
    """Segment tree over remaining capacities: which is the smallest one of at least a size that is open."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, at: int, windows: int) -> None:
        at += self.leaves
        while at:
            self.open[at] += windows
            at //= 2

    def tightest(self, size: int) -> int | None:
        """Go up until a right sibling has open windows, then down to its leftmost one."""
        at = size + self.leaves
        if not self.open[at]:
            while at > 1 and (at % 2 or not self.open[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], list[tuple[int, int, int]]]:
    """Best-fit decreasing of ``counts`` pieces by length.

    Returns runs (length, first rank, pieces, first window, pieces a window, offset): the piece of rank
    ``first rank + i`` of that length goes to window ``first window + i // a``, at
    ``offset + i % a * length``; and (first window, windows, tokens in each). Taking the tightest
    window, a piece leaves it the tightest for the next of the same length as long as that fits, so
    windows are filled one after the other and windows with equal contents form one range.
    """
    tree, groups = CapacityTree(capacity), {}
    runs, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            groups.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room, first = capacity, opened
                n = -(-left // (capacity // size))
                opened += n
            else:
                first, n = groups[room].pop()
                tree.add(room, -n)
            each = room // size
            full = min(n, left // each)
            for windows, a in ((full, each), (1, left - full * each if full < n else 0)):
                if windows and a:
                    runs.append((size, rank, windows * a, first, a, capacity - room))
                    put(room - a * size, first, windows)
                    first, n, rank, left = first + windows, n - windows, rank + windows * a, left - windows * a
            put(room, first, n)
    return runs, sorted((first, n, capacity - room) for room, own in groups.items() for first, n in own)


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    """Cuts documents; ``nth`` counts the pieces of equal length within a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _remembered(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for first, last in slices(offsets, _AT_ONCE):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)]
                rows, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
                for row, own in enumerate(words.ids(texts)):
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(own), capacity):
                        piece = own[at : at + capacity]
                        rows.append(first + row)
                        starts.append(at)
                        lengths.append(len(piece))
                        crcs.append(zlib.crc32(piece.tobytes()))
                        totals.append(len(own))
                        if keep_ids:
                            ids.append(piece.astype(np.int64))
                length = np.array(lengths)
                order = np.argsort(length, kind="stable")
                by = length[order]
                nth = np.empty(len(by), np.int64)
                nth[order] = np.arange(len(by)) - np.searchsorted(by, by) + seen[by]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [batch.column(0).take(pa.array(rows)), starts, lengths, crcs, totals, np.full(len(rows), part), nth]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns],
                    ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", *["ids"] * keep_ids],
                )

    return cut


_WORDS: dict[str, WordIds] = {}


def _remembered(path: str) -> WordIds:
    return _WORDS.setdefault(path, None) or _WORDS.__setitem__(path, WordIds(path)) or _WORDS[path]


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    keep_ids: bool = True,
) -> DataFrame:
    """Cut and pack ``docs``: one row per piece.

    Columns: the id, ``start``, ``length``, ``ids_crc32`` (of the piece's little-endian ids),
    ``doc_tokens``, ``sequence_id``, ``offset``, ``padded_length`` (the sequence's own length if that
    is a power of two, else ``capacity``), and ``ids`` unless ``keep_ids`` is false. ``tokenizer`` is
    the path of a tokenizer file, the same on every executor.

    A null or empty text is a document of one id, ``end_id``. Repeated rows and repeated or null ids
    are packed as they stand, each row on its own. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long"
    pieces = stage(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            _pieces(tokenizer, capacity, end_id, keep_ids), schema + ", ids array<bigint>" * keep_ids
        )
    )
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    # At most ``capacity`` rows.
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, fills = best_fit(total, capacity)
    run, fill = np.array(sorted(runs), np.int64).reshape(-1, 6), np.array(fills, np.int64).reshape(-1, 3)
    # Bounded by the number of lengths, not by the corpus.
    sent = docs.sparkSession.sparkContext.broadcast((run, fill))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, fill = sent.value
        big = int(run[:, 1].max(initial=0)) + 1
        keys = run[:, 0].astype(np.float64) * big + run[:, 1] if big < 1 << 40 else None
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("base").to_numpy()
            if keys is not None:
                which = np.searchsorted(keys, length.astype(np.float64) * big + np.minimum(rank, big - 1), side="right") - 1
            else:
                first, last = np.searchsorted(run[:, 0], length), np.searchsorted(run[:, 0], length, side="right")
                which = np.array([a + np.searchsorted(run[a:b, 1], r, side="right") - 1 for a, b, r in zip(first, last, rank)], np.int64)
            size, start, _, window, each, offset = run[which].T
            step = rank - start
            window = window + step // each
            used = fill[np.searchsorted(fill[:, 0], window, side="right") - 1, 2]
            padded = np.where(used & (used - 1), capacity, used)
            names = [x for x in batch.schema.names if x not in ("part", "nth", "base")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in names), *(pa.array(x, pa.int64()) for x in (window, offset + step % each * size, padded))],
                [*names, "sequence_id", "offset", "padded_length"],
            )

    joined = pieces.join(counts.select("part", "length", "base"), ["part", "length"]).select(*pieces.columns, "base")
    out = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<bigint>" * keep_ids
    return joined.mapInArrow(place, f"{out}, sequence_id long, offset long, padded_length long").withColumnRenamed("id", id_col)
