"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

A transcript is a run of pieces of text. Each line is seen as a symbol: the kind of speaker marker it
starts with and what it looks like. States are a role's first or further line; a model counted from
labelled transcripts is decoded by Viterbi. Best paths compose like matrix products over (max, +), so a
transcript is cut into segments by its pieces' positions: every segment gives the matrix of its best
paths, matrices are multiplied in levels of ``FAN``, the states at the cuts are told down the levels
again, and every segment is then decoded between those. No group has more than ``SEGMENT`` pieces or
``FAN`` matrices, whatever the ids and numbers of the pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import stage
from provenir.operators.large_groups import number_rows

ROLES = ("system", "user", "assistant")
#: A role's first line, a role's further lines; the last state stands before the first line.
STATES = 2 * len(ROLES) + 1
START = STATES - 1
#: Pieces of a segment.
SEGMENT = 64
#: Segments, or groups of them, that are taken together at each level.
FAN = 64

_NAMES = {
    "system": "system|instructions?|context|note",
    "user": "user|human|customer|question|q|prompt|me",
    "assistant": "assistant|ai|bot|agent|answer|a|model|response",
}
_MARKERS = [
    re.compile(rf"[\s#>*\[<|_]{{0,8}}(?:{names})[\s*\]>|_]{{0,6}}(?::[\s*]{{0,4}}|(?<=[\]>|])\s*|$)", re.IGNORECASE)
    for names in _NAMES.values()
]
_SPEAKER = re.compile(r"[\s#>*\[<|_]{0,8}[A-Z][\w.' -]{0,24}[\s*\]>|_]{0,6}:\s")
SYMBOLS = 5 * 8


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """The lines of a piece that aren't blank: symbol, and the line without its role marker.

    Markers 0 none, 1 to 3 a role's, 4 another speaker's; then whether a blank line stands before, the
    line asks something, and it is short.
    """
    out, blank = [], False
    for line in (text or "").split("\n"):
        if not line.strip():
            blank = True
            continue
        found = next(((i + 1, m.end()) for i, pattern in enumerate(_MARKERS) if (m := pattern.match(line))), None)
        kind, rest = found or (4 if _SPEAKER.match(line) else 0, 0)
        body = line[rest:].strip()
        symbol = 8 * kind + blank + 2 * body.endswith(("?", "？")) + 4 * (len(body) < 80)
        out.append((symbol, body))
        blank = False
    return out


class Model(NamedTuple):
    step: np.ndarray  # log probability of state to state
    shows: np.ndarray  # log probability of state to symbol


def model_of(steps: np.ndarray, shows: np.ndarray) -> Model:
    """From counts, each raised by one half; what can't follow has no probability."""
    may = np.ones((STATES, STATES), bool)
    may[:, START] = False
    for r in range(len(ROLES)):
        may[:, 2 * r + 1] = False
        may[[2 * r, 2 * r + 1], 2 * r + 1] = True
    with np.errstate(divide="ignore"):
        step = np.where(may, steps + 0.5, 0.0)
        step = np.log(step / step.sum(axis=1, keepdims=True))
        show = shows + 0.5
        show[START] = 0
        show = np.log(show / np.maximum(show.sum(axis=1, keepdims=True), 1e-300))
    return Model(step, show)


def best_paths(model: Model, symbols: list[int]) -> np.ndarray:
    """Best log probability from each state before the symbols to each state at the last one."""
    out = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
    for s in symbols:
        out = (out[:, :, None] + model.step[None]).max(axis=1) + model.shows[None, :, s]
    return out


def decode(model: Model, symbols: list[int], enter: int, leave: int | None = None) -> list[int]:
    """The best states, from state ``enter`` before the first line to ``leave`` at the last one; ties to the smaller state."""
    if not symbols:
        return []
    best = np.full(STATES, -np.inf)
    best[enter] = 0.0
    back = []
    for s in symbols:
        ways = best[:, None] + model.step
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + model.shows[:, s]
    state = int(best.argmax()) if leave is None else leave
    out = [state]
    for b in reversed(back[1:]):
        state = int(b[state])
        out.append(state)
    return out[::-1]


def _in_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: str) -> DataFrame:
    """``fn(key, rows)`` for each group of ``keys`` in ``order``; a task streams through its groups."""
    names = df.columns

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns)) if batch.num_rows else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [names.index(k) for k in keys]
        out = []
        for key, group in groupby(rows(batches), key=lambda r: tuple(r[i] for i in at)):
            out += fn(key, [dict(zip(names, r)) for r in group])
            if len(out) >= 2_000:
                yield _batch(out, arrow)
                out = []
        yield _batch(out, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _coded(pieces: DataFrame, conv: str, piece: str, text: str, role: str | None = None) -> DataFrame:
    kinds = [pieces.schema[c].dataType.simpleString() for c in (conv, piece)]
    names = ["conv", "piece", *["role"] * (role is not None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines_of(x) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array([[s for s, _ in x] for x in found], pa.list_(pa.int32())), pa.array([[t for _, t in x] for x in found], pa.list_(pa.string()))],
                [*names, "symbols", "lines"],
            )

    columns = [F.col(conv).alias("conv"), F.col(piece).alias("piece")]
    columns += [F.col(role).cast("string").alias("role")] if role is not None else []
    schema = f"conv {kinds[0]}, piece {kinds[1]}{', role string' if role is not None else ''}, symbols array<int>, lines array<string>"
    return pieces.select(*columns, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def learn(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Counts over labelled transcripts whose pieces are turns numbered one by one.

    Turns of other roles than ``ROLES``, of null ids or numbers, and without lines are not counted. Repeated
    rows count once for what follows what.
    """
    coded = _coded(turns.filter(F.col(conv).isNotNull() & F.col(turn).isNotNull()), conv, turn, text, role)
    known = {r: i for i, r in enumerate(ROLES)}
    number = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    coded = stage(coded.withColumn("of", number[F.col("role")]).filter(F.col("of").isNotNull() & (F.size("symbols") > 0)))
    shown = coded.select("of", F.posexplode("symbols").alias("nth", "symbol"))
    shown = shown.groupBy((2 * F.col("of") + (F.col("nth") > 0).cast("int")).alias("state"), "symbol").agg(F.count("*").alias("n"))
    shows = np.zeros((STATES, SYMBOLS))
    for r in shown.collect():
        shows[r["state"], r["symbol"]] = r["n"]
    steps = np.zeros((STATES, STATES))
    size = coded.select("conv", "piece", "of", F.size("symbols").alias("n"))
    inside = size.groupBy("of").agg(F.sum((F.col("n") > 1).cast("long")).alias("second"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("further"))
    for r in inside.collect():
        steps[2 * r["of"], 2 * r["of"] + 1] = r["second"]
        steps[2 * r["of"] + 1, 2 * r["of"] + 1] = r["further"]
    before = size.select("conv", (F.col("piece") + 1).alias("piece"), (2 * F.col("of") + (F.col("n") > 1).cast("int")).alias("last"))
    # A turn that stands there several times is followed, and follows, once: nothing grows with repeated rows.
    each = size.select("conv", "piece", "of").distinct()
    follows = each.join(before.distinct(), ["conv", "piece"], "left").groupBy(F.coalesce("last", F.lit(START)).alias("last"), "of").agg(F.count("*").alias("n"))
    for r in follows.collect():
        steps[r["last"], 2 * r["of"]] = r["n"]
    return model_of(steps, shows)


_NAME = ["unnamed", "named"]


def _parent() -> Column:
    return F.floor(F.col("segment") / FAN).cast("long")


def _last_before(cut: DataFrame) -> DataFrame:
    """``cut`` (transcript, segment, began) with ``before``, the last ``began`` of an earlier segment."""
    cut = stage(cut)
    if (cut.agg(F.max("segment")).first()[0] or 0) < FAN:
        earlier = Window.partitionBy(*_NAME).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
        return cut.withColumn("before", F.last("began", True).over(earlier))
    order = F.when(F.col("began").isNotNull(), F.col("segment"))
    above = _last_before(cut.groupBy(*_NAME, _parent().alias("segment")).agg(F.max_by("began", order).alias("began")))
    above = above.select(*_NAME, F.col("segment").alias("parent"), F.col("before").alias("above"))
    earlier = Window.partitionBy(*_NAME, "parent").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("parent", _parent()).withColumn("before", F.last("began", True).over(earlier))
    return own.join(above, [*_NAME, "parent"]).withColumn("before", F.coalesce("before", "above")).drop("parent", "above")


def format_turns(
    pieces: DataFrame, model: Model, conv: str = "conv_id", piece: str = "turn", text: str = "text"
) -> DataFrame:
    """The turns of each transcript: one row per turn.

    ``pieces`` are parts of transcripts, in the order of their numbers; they need not be turns. Columns:
    the transcript's id, ``start_piece`` and ``start_line`` (where the turn begins, lines from 0 among
    those that aren't blank), ``role``, ``n_lines``, ``text`` (lines without role markers) and
    ``rendered``, the turn in canonical form.

    A null or blank piece has no lines; a transcript without lines has no turns. Pieces of a null id are
    one transcript, a null number comes first, pieces of equal numbers follow in the order of their
    lines, repeated ones repeat their lines. An empty table gives no rows. Other columns are ignored.
    """
    sent = pieces.sparkSession.sparkContext.broadcast(model)
    kinds = [pieces.schema[c].dataType.simpleString() for c in (conv, piece)]
    coded = _coded(pieces, conv, piece, text).filter(F.size("symbols") > 0)
    coded = stage(
        coded.withColumns({"unnamed": F.col("conv").isNull(), "named": F.coalesce(F.col("conv").cast("string"), F.lit("")), "row": F.monotonically_increasing_id()})
    )
    coded = number_rows(coded, _NAME, [F.col("piece"), F.col("lines"), F.col("row")])
    coded = stage(coded.withColumn("segment", F.floor((F.col("position") - 1) / SEGMENT).cast("long")))
    name = "unnamed boolean, named string, segment long"

    def matrix(key, rows):
        return [(*key, best_paths(sent.value, [s for r in rows for s in r["symbols"]]).ravel().tolist())]

    def product(key, rows):
        out = np.array(rows[0]["paths"]).reshape(STATES, STATES)
        for r in rows[1:]:
            out = (out[:, :, None] + np.array(r["paths"]).reshape(STATES, STATES)[None]).max(axis=1)
        return [(*key, out.ravel().tolist())]

    def bounds(key, rows):
        here = np.full(STATES, -np.inf)
        here[rows[0]["enter"]] = 0.0
        ways = []
        for r in rows:
            way = here[:, None] + np.array(r["paths"], float).reshape(STATES, STATES)
            ways.append(way.argmax(axis=0))
            here = way.max(axis=0)
        state, out = int(here.argmax()) if rows[0]["leave"] is None else rows[0]["leave"], []
        for r, way in zip(reversed(rows), reversed(ways)):
            out.append((*key[:-1], r["segment"], int(way[state]), state))
            state = int(way[state])
        return out

    own = [*_NAME, "segment"]
    levels = [stage(_in_groups(coded.select(*own, "position", "symbols"), own, ["position"], matrix, f"{name}, paths array<double>"))]
    while (levels[-1].agg(F.max("segment")).first()[0] or 0) >= FAN:
        below = levels[-1].select(*_NAME, _parent().alias("parent"), "segment", "paths")
        levels.append(stage(_in_groups(below, [*_NAME, "parent"], ["segment"], product, f"{name}, paths array<double>")))
    cuts = None
    for level in reversed(levels):
        level = level.withColumn("parent", _parent())
        if cuts is None:
            level = level.withColumns({"enter": F.lit(START), "leave": F.lit(None).cast("int")})
        else:
            level = level.join(cuts.withColumnRenamed("segment", "parent"), [*_NAME, "parent"])
        level = level.select(*_NAME, "parent", "segment", "paths", "enter", "leave")
        cuts = stage(_in_groups(level, [*_NAME, "parent"], ["segment"], bounds, f"{name}, enter int, leave int"))
    held = coded.drop("row").join(cuts, own)

    def parts(key, rows):
        where = [(r["piece"], i, line) for r in rows for i, line in enumerate(r["lines"])]
        states = decode(sent.value, [s for r in rows for s in r["symbols"]], rows[0]["enter"], rows[0]["leave"])
        out = []
        for state, (at, i, line) in zip(states, where):
            if state % 2 == 0 or not out:
                first = state % 2 == 0
                out.append([*key, rows[0]["conv"], len(out), first, at if first else None, i if first else None, ROLES[state // 2], []])
            # A marker may stand alone on its line.
            out[-1][-1] += [line] if line else []
        return [(*x[:-1], "\n".join(x[-1]), len(x[-1])) for x in out]

    schema = f"{name}, conv {kinds[0]}, part int, begins boolean, start_piece {kinds[1]}, start_line int, role string, text string, n_lines int"
    found = stage(_in_groups(held, own, ["position"], parts, schema))
    # A turn that goes on in a segment began in the last segment before it that has a beginning.
    place = F.struct("start_piece", "start_line", F.col("segment").alias("of"), "part")
    cut = found.groupBy(*own).agg(F.max_by(F.when(F.col("begins"), place), F.when(F.col("begins"), F.col("part"))).alias("began"))
    cut = stage(_last_before(cut).select(*own, "before"))
    turns = found.join(cut, own).withColumn("turn", F.when(F.col("begins"), place).otherwise(F.col("before")))
    piece_of = F.struct("segment", "part", "text")
    turns = turns.groupBy("conv", "turn", "role").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n_lines") > 0, piece_of))), lambda x: x["text"]), "\n").alias("text"),
        F.sum("n_lines").alias("n_lines"),
    )
    return turns.select(
        F.col("conv").alias(conv), F.col("turn.start_piece"), F.col("turn.start_line"), "role", "n_lines", "text",
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n")).alias("rendered"),
    )


def as_logs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Labelled turns as the pieces of a raw log: each transcript in one house style, some turns without a marker.

    A third of the transcripts have a blank line before such turns only.

    Columns are those of ``turns``; only the text changes. The style follows from the transcript's id,
    and which turns lack a marker from the turn's.
    """
    crc = lambda *parts: F.crc32(F.encode(F.concat_ws("/", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)), "UTF-8"))
    name = F.coalesce(F.col(role).cast("string"), F.lit("note"))
    short = F.when(name == "user", "Q").when(name == "assistant", "A").otherwise("Note")
    other = F.when(name == "user", "Human").when(name == "assistant", "AI").otherwise("System")
    style = crc(conv) % 5
    marker = (
        F.when(style == 0, F.concat(F.initcap(name), F.lit(": ")))
        .when(style == 1, F.concat(F.lit("### "), other, F.lit(":\n")))
        .when(style == 2, F.concat(F.lit("["), name, F.lit("] ")))
        .when(style == 3, F.concat(F.lit("**"), short, F.lit(":** ")))
        .otherwise(F.concat(F.lit("<|"), name, F.lit("|>")))
    )
    plain = crc(conv, turn) % 4 == 0
    marker = F.when(plain, F.lit("\n")).when(crc(conv) % 3 == 0, marker).otherwise(F.concat(F.lit("\n"), marker))
    return turns.withColumn(text, F.concat(marker, F.coalesce(F.col(text).cast("string"), F.lit(""))))
