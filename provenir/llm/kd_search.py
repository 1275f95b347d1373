"""Exact top-k by integer inner product: KD-trees per shard, searched best-first.

Rows are dealt into shards of a fixed expected size, and each shard's task builds a KD-tree: median splits
of the widest component, every node with the tight bounding box of its rows. What a box can score with a
query at most is the sum, over components, of the better of its two ends; a query opens its best open
node next and stops when that can't reach its kth score any more.

The kth score travels: each query first searches one shard, its home, and takes the kth score found
there along to all others, where whatever lies under it is never opened. Queries meet the shards in
blocks of fixed expected size, so that a task holds one shard's tree and streams queries past it,
however many there are of either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import stage

#: Rows of a shard, queries that meet a shard in one task, rows of a leaf, queries that go down together.
SHARD, BLOCK, LEAF, TOGETHER = 8_192, 65_536, 64, 1_024
#: Marks what is not open; smaller than any score.
CLOSED = -(1 << 63)
NO_ID = (1 << 63) - 1


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, whole numbers held in doubles, exactly.

    Sums beyond the range of a long count as its ends.
    """
    most = lambda x: float(np.abs(x).max()) if x.size else 0.0
    if most(a) * most(b) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    out = np.empty((len(a), len(b)), np.int64)
    other = whole(b)
    for i, row in enumerate(whole(a)):
        for j, against in enumerate(other):
            out[i, j] = min(max(int(np.dot(row, against)), CLOSED + 1), NO_ID)
    return out


class Tree:
    """A KD-tree over the rows of ``rows``, whose ids are ``ids``."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(rows))
        low, high, begin, end, left = [], [], [], [], []
        todo = [(0, len(rows), -1)]
        while todo:
            first, last, parent = todo.pop()
            node, part = len(begin), rows[order[first:last]]
            if parent >= 0:
                left[parent].append(node)
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            begin.append(first)
            end.append(last)
            left.append([])
            wide = high[-1] - low[-1]
            if last - first <= leaf or not wide.max(initial=0) > 0:
                continue
            middle = (last - first) // 2
            split = np.argpartition(part[:, int(np.argmax(wide))], middle)
            order[first:last] = order[first:last][split]
            todo += [(first + middle, last, node), (first, first + middle, node)]
        self.low, self.high = np.array(low), np.array(high)
        self.begin, self.end = np.array(begin), np.array(end)
        self.children = np.array([c or [-1, -1] for c in left])
        self.rows, self.ids = rows[order], ids[order]

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """What the rows of each node can score with each query at most."""
        both = np.hstack([np.maximum(asked, 0), np.minimum(asked, 0)])
        return product(both, np.hstack([self.high, self.low]))

    def search(self, asked: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), each of shape (queries, k), of the best rows that reach ``floor``, best first.

        Rows whose id is the query's own are passed over. Unused places score ``CLOSED``.
        """
        n = len(asked)
        scores, ids = np.full((n, k), CLOSED, np.int64), np.full((n, k), NO_ID, np.int64)
        kth = floor.copy()
        bounds = self.bounds(asked)
        queue = np.full(bounds.shape, CLOSED, np.int64)
        queue[:, 0] = bounds[:, 0]
        active = np.arange(n)
        while len(active):
            node = queue[active].argmax(axis=1)
            reach = queue[active, node]
            going = (reach > CLOSED) & (reach >= kth[active])
            active, node = active[going], node[going]
            queue[active, node] = CLOSED
            inner = self.children[node, 0] >= 0
            for side in (0, 1):
                child = self.children[node[inner], side]
                queue[active[inner], child] = bounds[active[inner], child]
            leaves, of_leaf = active[~inner], node[~inner]
            order = np.argsort(of_leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(of_leaf[order])) + 1
            for group in np.split(order, cuts) if len(order) else ():
                self._open(of_leaf[group[0]], leaves[group], asked, own, scores, ids, kth, k)
        return scores, ids

    def _open(self, node, queries, asked, own, scores, ids, kth, k) -> None:
        for first in range(self.begin[node], self.end[node], 4 * LEAF):
            part = slice(first, min(first + 4 * LEAF, self.end[node]))
            found = product(asked[queries], self.rows[part])
            names = self.ids[part]
            found[own[queries][:, None] == names[None, :]] = CLOSED
            better = (found >= np.maximum(kth[queries], CLOSED + 1)[:, None]).any(axis=1)
            if not better.any():
                continue
            who = queries[better]
            every = np.hstack([scores[who], found[better]])
            every_id = np.hstack([ids[who], np.broadcast_to(names, (len(who), len(names)))])
            # ~x is -x - 1: larger scores first, without overflow.
            best = np.lexsort((every_id, ~every), axis=1)[:, :k]
            scores[who] = np.take_along_axis(every, best, axis=1)
            ids[who] = np.take_along_axis(every_id, best, axis=1)
            kth[who] = np.maximum(kth[who], scores[who, -1])


def _scaled(scale: int):
    """(id, dim, vec) of the rows that take part, ``vec`` the little-endian bytes of floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            keep = pc.and_(pc.is_valid(ids), pc.is_valid(lists))
            ids, lists = ids.filter(keep), lists.filter(keep)
            dims = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            first = np.concatenate([[0], np.cumsum(dims)])
            whole = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            fine = np.flatnonzero(whole[first[1:]] == whole[first[:-1]])
            out = []
            for i in fine:
                vec = values[first[i] : first[i + 1]]
                small = not len(vec) or np.abs(vec).max() < 2**15
                out.append(vec.astype("<i2" if small else "<f8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(fine)), pa.array(dims[fine], pa.int32()), pa.array(out, pa.binary())], ["id", "dim", "vec"]
            )

    return run


def _rows(vecs: list[bytes], dim: int) -> np.ndarray:
    """The vectors as doubles; those with small components come in two bytes each."""
    out = np.empty((len(vecs), dim))
    for i, vec in enumerate(vecs):
        out[i] = np.frombuffer(vec, "<i2" if len(vec) == 2 * dim else "<f8")
    return out


def _searched(k: int):
    """Rows come by cell, the shard's own (no ``floor``) ahead of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = tree = None
        vecs, names = [], []
        for batch in batches:
            cells = batch.column("cell").to_pylist()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            edges = [0, *(i for i in range(1, len(cells)) if cells[i] != cells[i - 1] or asks[i] != asks[i - 1]), len(cells)]
            for first, last in zip(edges, edges[1:]) if cells else ():
                part = batch.slice(first, last - first)
                if cells[first] != cell:
                    cell, tree, vecs, names = cells[first], None, [], []
                dim = part.column("dim")[0].as_py()
                if not asks[first]:
                    vecs += part.column("vec").to_pylist()
                    names += part.column("id").to_pylist()
                    continue
                if tree is None and vecs:
                    tree, vecs = Tree(_rows(vecs, dim), np.array(names, np.int64)), []
                if tree is None:
                    continue
                for at in range(0, part.num_rows, TOGETHER):
                    some = part.slice(at, TOGETHER)
                    own = some.column("id").to_numpy()
                    floor = some.column("floor").to_numpy()
                    scores, ids = tree.search(_rows(some.column("vec").to_pylist(), dim), own, floor, k)
                    row, place = np.nonzero(scores > CLOSED)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("id").take(pa.array(row)), some.column("vec").take(pa.array(row)), pa.array(ids[row, place]), pa.array(scores[row, place])],
                        ["query_id", "query", "found", "score"],
                    )

    return run


def _cell(shard: Column, block: Column) -> Column:
    return F.concat_ws("/", "dim", shard, block)


def _met(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """All cells' results; ``rows`` and ``asked`` carry (cell, asks, id, dim, vec, floor)."""
    every = rows.unionByName(asked).repartition("cell").sortWithinPartitions("cell", "asks")
    return every.mapInArrow(_searched(k), "query_id long, query binary, found long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner product, exactly.

    Components are taken as floor(scale * x) in double precision; equal scores rank by the smaller id.
    A query meets every row of its own length but those with its id; if there are fewer than ``k``, all.

    Rows with a null id, a null vector or a null or non-finite component take no part. A repeated row
    counts once; an id with several vectors is several rows, and as a query gets one list for each. Scores
    beyond a long count as its ends. A vector without components scores 0 with its like. Empty tables give
    no rows. Other columns are ignored.
    """

    def taken(df: DataFrame) -> DataFrame:
        columns = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")]
        return stage(df.select(*columns).mapInArrow(_scaled(scale), "id long, dim int, vec binary").dropDuplicates())

    rows, asked = taken(vectors), taken(queries)
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"))
    asked_sizes = asked.groupBy("dim").agg(F.count("*").alias("m"))
    # Two small tables with a row for each length that occurs.
    parts = stage(
        sizes.join(asked_sizes, "dim").select(
            "dim", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")
        )
    )
    shard = F.pmod(F.xxhash64("id", "vec"), F.col("shards")).cast("int")
    rows = rows.join(parts, "dim").withColumn("shard", shard).withColumn("asks", F.lit(False)).withColumn("floor", F.lit(CLOSED))
    asked = asked.join(parts, "dim").withColumn("home", shard).withColumn("asks", F.lit(True))
    columns = ["cell", "asks", "id", "dim", "vec", "floor"]

    home = F.lit("home")
    first = _met(
        rows.withColumn("cell", _cell(F.col("shard"), home)).select(*columns),
        asked.withColumn("floor", F.lit(CLOSED)).withColumn("cell", _cell(F.col("home"), home)).select(*columns),
        k,
    )
    first = stage(first)
    kth = _best(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("query").alias("vec"), F.col("score").alias("floor"))
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: s != F.col("home")))
    block = F.pmod(F.xxhash64("vec", "id"), F.col("blocks")).cast("int")
    rest = _met(
        rows.filter("shards > 1").withColumn("block", blocks).withColumn("cell", _cell(F.col("shard"), F.col("block"))).select(*columns),
        asked.join(kth, ["id", "vec"], "left")
        .withColumn("floor", F.coalesce("floor", F.lit(CLOSED)))
        .withColumn("shard", others)
        .withColumn("cell", _cell(F.col("shard"), block))
        .select(*columns),
        k,
    )
    return _best(first.unionByName(rest), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("vec_id"), "score"
    )
