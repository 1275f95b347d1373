"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

The trees are fitted on a bounded sample and every row is indexed in all of them. A query goes down all
trees through one shared priority queue, taking next whichever open branch is nearest to it, until the
leaves it has opened hold a given share of the rows. Equal vectors are one entry with its smallest ids,
so copies neither fill leaves nor hide other neighbours. Candidates of the leaves are ranked by their
exact cosine in double precision. Rows and queries meet in cells, a part of the rows with a block of the
queries: a row brings its leaves, a query those it opened, and a cell returns k rows for each query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import stage

TREES = 8
#: Rows of a leaf, as far as the sample can tell.
LEAF = 256
#: The fit's sample: at most so many rows and so many bytes of float32.
SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 33_554_432
#: Share of the rows, counted once for each tree they are met in, that a query opens; and rows at least.
SHARE, LEAST = 0.6, 4_096
#: Rows of a cell, and its queries, about; smaller tables make cells of ``LEAST`` rows, to keep all cores busy.
CELL, BLOCK = 65_536, 4_096
#: Queries of a cell that are scored at once.
AT_ONCE = 64

Tree = dict[str, np.ndarray]


def plant(sample: np.ndarray, leaf: float, seed: int) -> Tree:
    """A tree over the rows of ``sample``: at each node the difference of two random rows, cut at the median.

    Arrays by node: ``normal``, ``cut``, ``low`` and ``high`` (children; a leaf has none, -1), ``share``
    (of the sample below it).
    """
    rng = np.random.default_rng(seed)
    normal, cut, low, high, share = [], [], [], [], []
    todo = [(np.arange(len(sample)), -1, False)]
    while todo:
        rows, parent, right = todo.pop()
        node = len(cut)
        if parent >= 0:
            (high if right else low)[parent] = node
        share.append(len(rows) / max(len(sample), 1))
        low.append(-1)
        high.append(-1)
        cut.append(0.0)
        normal.append(np.zeros(sample.shape[1], np.float32))
        if len(rows) <= max(leaf, 1):
            continue
        a, b = rng.choice(rows, 2, replace=False)
        direction = sample[a] - sample[b]
        size = np.linalg.norm(direction)
        if size < 1e-6:
            direction = rng.standard_normal(sample.shape[1]).astype(np.float32)
            size = np.linalg.norm(direction)
        place = sample[rows] @ (direction / size)
        middle = float(np.median(place))
        left = place <= middle
        if left.all():
            left = place < middle
        if not left.any() or left.all():
            continue
        normal[node], cut[node] = direction / size, middle
        todo += [(rows[left], node, False), (rows[~left], node, True)]
    return {
        "normal": np.array(normal), "cut": np.array(cut, np.float32), "low": np.array(low),
        "high": np.array(high), "share": np.array(share),
    }


def leaves(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(rows), np.int64)
    while True:
        inner = np.flatnonzero(tree["low"][at] >= 0)
        if not len(inner):
            return at
        node = at[inner]
        right = np.einsum("ij,ij->i", rows[inner], tree["normal"][node]) > tree["cut"][node]
        at[inner] = np.where(right, tree["high"][node], tree["low"][node])


def search(forest: list[Tree], row: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """(tree, leaf) opened for ``row``, nearest branches first, until they hold ``wanted`` of the sample."""
    side = [(tree["normal"] @ row - tree["cut"]).tolist() for tree in forest]
    queue = [(0.0, t, 0) for t in range(len(forest))]
    out, held = [], 0.0
    while queue and held < wanted:
        far, t, node = heapq.heappop(queue)
        tree = forest[t]
        while tree["low"][node] >= 0:
            d = side[t][node]
            near, other = (tree["high"][node], tree["low"][node]) if d > 0 else (tree["low"][node], tree["high"][node])
            heapq.heappush(queue, (max(far, abs(d)), t, int(other)))
            node = int(near)
        out.append((t, node))
        held += tree["share"][node]
    return out


def _flat(column: pa.Array) -> np.ndarray:
    """The items of all lists of a column in a row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def _unit(vectors: pa.Array, dimension: int) -> np.ndarray:
    rows = _flat(vectors).reshape(-1, dimension)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def candidates(opened: pa.Array, leaf: np.ndarray, slots: int) -> np.ndarray:
    """Which rows (first axis; ``leaf`` has theirs, one in each tree) lie in a leaf that a query opened."""
    here = np.zeros((slots, len(opened)), bool)
    here[_flat(opened), np.repeat(np.arange(len(opened)), opened.value_lengths().to_numpy())] = True
    met = here[leaf[:, 0]]
    for tree in range(1, leaf.shape[1]):
        met |= here[leaf[:, tree]]
    return met


def nearest(rough: np.ndarray, x: np.ndarray, query_id, v: np.ndarray, ids: list[list], k: int) -> list[tuple]:
    """(-cosine, id) of the ``k`` best ids among rows ``v``; ``rough`` is -inf for rows that are no candidates."""
    length, there = np.sqrt((x * x).sum()), int((rough > -np.inf).sum())
    near = 2 * k + 1
    while True:
        # Rounding differs by cell, so the rough order only has to hold the true one with room to spare.
        floor = np.partition(rough, -near)[-near] if near < there else -np.inf
        picked = np.flatnonzero((rough > -np.inf) & (rough >= floor - 1e-9 * length))
        score = (v[picked] * x).sum(axis=1) / (length * np.sqrt((v[picked] * v[picked]).sum(axis=1)))
        best: dict = {}
        for s, j in zip(score.tolist(), picked.tolist()):
            for a in [a for a in ids[j] if a != query_id][:k]:
                best[a] = max(s, best.get(a, s))
        if len(best) >= k or near >= there:
            return sorted((-s, a) for a, s in best.items())[:k]
        near *= 2


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct (id, vector) rows with an id and a finite vector that isn't zero, of the commonest length."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(
        F.col("id").isNotNull()
        & F.exists("vector", lambda x: x != 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    rows = stage(rows.distinct())
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"))
    first = lengths.orderBy(F.desc("rows"), "n").first()
    return rows.filter(F.size("vector") == (first["n"] if first else 0))


def neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    leaf: int = LEAF,
    share: float = SHARE,
) -> DataFrame:
    """The ``k`` nearest rows found for each row of ``queries`` among ``vectors``, rows of the query's own id left out.

    Returns ``query_id``, ``rank`` (from 1), the id, ``score``: cosine, nearest first, ties to the
    smaller id. Rows with a null id, and vectors that are null, empty, zero, of another length than the
    commonest one, or hold null or non-finite components, take no part on either side. Repeated rows
    count once. With fewer than ``k`` candidates all are returned; an empty table gives no rows. Other
    columns are ignored.

    The trees are fitted on at most ``SAMPLE_ROWS`` distinct vectors, those with the smallest hashes.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col)
    asked = _usable(queries, id_col, vector_col)
    # A result needs at most k rows of a vector besides the query's own.
    smallest = Window.partitionBy("vector").orderBy("id")
    # Both windows share one shuffle, which an aggregate on vectors would not.
    first = rows.withColumn("nth", F.row_number().over(smallest)).filter(F.col("nth") <= k + 1)
    gathered = first.withColumn("ids", F.collect_list("id").over(smallest.rowsBetween(0, k)))
    entries = stage(gathered.filter(F.col("nth") == 1).select("vector", "ids"))
    n = entries.count()
    if not n:
        schema = f"query_id {rows.schema['id'].dataType.simpleString()}, rank int, {id_col} {rows.schema['id'].dataType.simpleString()}, score double"
        return spark.createDataFrame([], schema)
    dimension = len(entries.first()["vector"])
    most = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * dimension)))
    place = F.xxhash64("vector")
    chosen = entries
    if n > most:
        # Of a large table a tenth more than wanted is sorted.
        within = place < int(2**64 * 1.1 * most / n) - 2**63 if n > 2 * most else F.lit(True)
        chosen = entries.filter(within).orderBy(place).limit(most)
    unit = F.transform("vector", lambda x: x.cast("float"))
    sample = chosen.select(unit.alias("vector")).toArrow().column(0).combine_chunks()
    sample = sample.values.to_numpy(zero_copy_only=False).reshape(-1, dimension)
    sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-30)
    in_sample = leaf * len(sample) / n
    # Bounded by the sample, as is the forest.
    taught = spark.sparkContext.broadcast(sample)
    least = max(in_sample, 8 if n > most else 1)
    forest = spark.sparkContext.parallelize(range(trees), trees).map(lambda seed: plant(taught.value, least, seed)).collect()
    taught.destroy()
    sent = spark.sparkContext.broadcast(forest)
    wanted = min(float(trees), max(share, LEAST / n) if n > LEAST else float(trees))
    # Leaves of all trees in a row: a tree's own begin at its offset.
    offsets = np.cumsum([0] + [len(tree["cut"]) for tree in forest])
    slots = int(offsets[-1])
    tasks = 2 * spark.sparkContext.defaultParallelism
    cells = max(-(-n // CELL), min(tasks, -(-n // LEAST)))
    blocks = max(-(-asked.count() // BLOCK), 1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit_rows = _unit(batch.column("vector"), dimension)
            leaf = np.stack([leaves(tree, unit_rows) + first for tree, first in zip(sent.value, offsets)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids"), batch.column("vector"), _lists(leaf.ravel(), np.full(batch.num_rows, trees))], ["ids", "vector", "leaf"]
            )

    def open_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = [tree | {c: tree[c].tolist() for c in ("low", "high", "share")} for tree in sent.value]
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = [search(plain, x, wanted) for x in _unit(part.column("vector"), dimension)]
                opened = np.array([offsets[t] + node for one in found for t, node in one])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("vector"), _lists(opened, np.array([len(one) for one in found]))], ["query_id", "vector", "opened"]
                )

    kind = rows.schema["id"].dataType.simpleString()
    posted = entries.select("ids", "vector").mapInArrow(index, f"ids array<{kind}>, vector array<double>, leaf array<int>")
    posted = posted.withColumn("cell", F.pmod(place, F.lit(cells)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    probes = asked.repartition(tasks).mapInArrow(open_leaves, f"query_id {kind}, vector array<double>, opened array<int>")
    probes = probes.withColumn("query", F.monotonically_increasing_id()).withColumn("block", F.pmod(place, F.lit(blocks)).cast("int"))
    probes = probes.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))

    def score(probed: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if held.num_rows:
            v, leaf, ids = _flat(held["vector"]).reshape(-1, dimension), _flat(held["leaf"]).reshape(-1, trees), held["ids"].to_pylist()
            size = np.linalg.norm(v, axis=1, keepdims=True)
            for first in range(0, probed.num_rows, AT_ONCE):
                part = probed.slice(first, AT_ONCE).combine_chunks()
                q = _flat(part["vector"]).reshape(-1, dimension)
                met = candidates(part["opened"].combine_chunks(), leaf, slots)
                rough = np.ascontiguousarray(np.where(met, (v @ q.T) / size, -np.inf).T)
                for line, x, query, query_id in zip(rough, q, part["query"].to_pylist(), part["query_id"].to_pylist()):
                    out += [(query, query_id, a, -s) for s, a in nearest(line, x, query_id, v, ids, k)]
        columns = list(zip(*out)) or [()] * 4
        types = [pa.int64(), probed.schema.field("query_id").type, probed.schema.field("query_id").type, pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["query", "query_id", "id", "score"])

    keys = ["cell", "block"]
    found = (
        probes.groupBy(*keys).cogroup(posted.groupBy(*keys))
        .applyInArrow(score, f"query long, query_id {kind}, id {kind}, score double")
    )
    found = found.groupBy("query", "query_id", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
