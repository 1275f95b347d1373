"""Language identification by string kernels.

A text is a set of n-grams of its lower-cased letters: the blended spectrum of one to four letters,
presence only. The kernel of two texts is the number of n-grams they share over the geometric mean of
their numbers. A bounded sample is projected by Nyström landmarks, and one kernel ridge regression per
language separates it from the rest. Texts are scored in blocks of letters against all landmarks at once
by a matrix product; a text's score is the mean over its blocks, so whole texts count alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import stage

#: The fit's sample: blocks of text of each language, and characters of a block. Any block of a text may be taken.
SAMPLE_BLOCKS, SAMPLE_CHARACTERS = 300, 4_096
#: Landmarks of each language, at least and at most, and of all together as far as the least allows.
FEWEST, LANDMARKS, ALL_LANDMARKS = 4, 32, 2_048
ORDERS = (1, 2, 3, 4)
#: Places of the hashed n-gram table of each order.
PLACES = (512, 2_048, 4_096, 8_192)
BLOCK = 4_096
RIDGE = 1e-2
#: Blocks multiplied at once.
AT_ONCE = 64

_OFFSETS = np.concatenate([[0], np.cumsum(PLACES)])
_WIDTH = int(_OFFSETS[-1])


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray  # n-grams by landmark
    sizes: np.ndarray
    weights: np.ndarray  # landmark by language


@cache
def _is_letter() -> np.ndarray:
    """Of each code point."""
    return np.array([chr(p).isalpha() for p in range(0x110000)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return points
    alpha = _is_letter()[points]
    points = np.where(alpha, points, 32)
    first = np.ones(len(points), bool)
    first[1:] = alpha[1:] | alpha[:-1]
    return points[first]


def _presence(points: np.ndarray, out: np.ndarray) -> None:
    """Marks the n-grams of ``points`` in a row of the table."""
    code = np.zeros(len(points), np.uint64)
    wide = points.astype(np.uint64) + np.uint64(1)
    for n, places, offset in zip(ORDERS, PLACES, _OFFSETS):
        if n > len(points):
            return
        code = code[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + wide[n - 1 :]
        mixed = code ^ (code >> np.uint64(29))
        mixed = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
        out[int(offset) + (mixed % np.uint64(places)).astype(np.int64)] = 1


def spectra(blocks: list[np.ndarray]) -> np.ndarray:
    table = np.zeros((len(blocks), _WIDTH), np.float32)
    for row, points in zip(table, blocks):
        _presence(points, row)
    return table


def kernel(table: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    own = np.maximum(table.sum(axis=1, keepdims=True), 1)
    return (table @ landmarks) / np.sqrt(own * sizes)


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression in the span of the first texts of each language, ``landmarks`` at most."""
    points = [letters(x) for x in texts]
    kept = [i for i, p in enumerate(points) if (p != 32).any() and languages[i] is not None]
    names = sorted({languages[i] for i in kept})
    if not names:
        return Model([], np.zeros((_WIDTH, 0), np.float32), np.zeros(0), np.zeros((0, 0)))
    landmarks = min(landmarks, max(FEWEST, ALL_LANDMARKS // len(names)))
    label = np.searchsorted(names, [languages[i] for i in kept])
    order = np.argsort(label, kind="stable")
    nth = np.empty(len(label), np.int64)
    nth[order] = np.arange(len(label)) - np.searchsorted(label[order], label[order])
    chosen = spectra([points[i] for i, n in zip(kept, nth) if n < landmarks])
    sizes = np.maximum(chosen.sum(axis=1), 1)
    # The sample's table is made and multiplied piece by piece.
    pieces = [kept[at : at + AT_ONCE] for at in range(0, len(kept), AT_ONCE)]
    cross = np.vstack([kernel(spectra([points[i] for i in piece]), chosen.T, sizes) for piece in pieces]).astype(np.float64)
    inner = kernel(chosen, chosen.T, sizes).astype(np.float64)
    # Nyström features, then ridge on +1/-1 targets; languages weigh alike however many texts they have.
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = cross @ root
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1.0 / np.bincount(label)[label]
    share = share / share.mean()
    left = features.T @ (features * share[:, None]) + ridge * len(label) * np.eye(features.shape[1])
    weights = root @ np.linalg.solve(left, features.T @ (target * share[:, None]))
    return Model(names, np.ascontiguousarray(chosen.T), sizes, weights)


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text; ``und`` and 0 without letters."""
    blocks, owner = [], []
    for i, text in enumerate(texts):
        points = letters(text) if text else np.zeros(0, np.uint32)
        if not (points != 32).any():
            continue
        for at in range(0, len(points), BLOCK):
            blocks.append(points[at : at + BLOCK])
            owner.append(i)
    total = np.zeros((len(texts), max(len(model.languages), 1)))
    weight = np.zeros(len(texts))
    for at in range(0, len(blocks), AT_ONCE):
        part = blocks[at : at + AT_ONCE]
        size = np.array([len(p) for p in part], float)
        if model.languages:
            found = kernel(spectra(part), model.landmarks, model.sizes) @ model.weights
            np.add.at(total, owner[at : at + AT_ONCE], found * size[:, None])
        np.add.at(weight, owner[at : at + AT_ONCE], size)
    out = []
    for row, n in zip(total, weight):
        if not n or not model.languages:
            out.append(("und", 0.0))
            continue
        row = np.exp(4 * (row / n - (row / n).max()))
        best = int(row.argmax())
        out.append((model.languages[best], float(row[best] / row.sum())))
    return out


def held_out(id_col: str) -> Column:
    """Whether a document is kept from the fit: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``SAMPLE_BLOCKS`` blocks of the texts of each language, however many there are.

    Only documents that aren't held out and have a text and a language teach. Their whole texts are cut
    into blocks, and the distinct blocks with the smallest hashes are taken.
    """
    usable = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{SAMPLE_CHARACTERS}}}"), F.lit(0))
    blocks = usable.select(F.col(lang_col).cast("string").alias("lang"), F.explode(pieces).alias("text"))
    blocks = blocks.filter(F.rlike("text", F.lit(r"\p{IsAlphabetic}"))).withColumn("hash", F.xxhash64("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    # First which hashes, then their texts: only the sample's texts are moved.
    wanted = stage(blocks.select("lang", "hash").distinct().withColumn("nth", nth).filter(F.col("nth") <= SAMPLE_BLOCKS).select("lang", "hash"))
    rows = blocks.join(wanted, ["lang", "hash"]).dropDuplicates(["lang", "hash"]).collect()
    rows = sorted((r["lang"], r["hash"], r["text"]) for r in rows)
    return fit([r[2] for r in rows], [r[0] for r in rows])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    The prediction reads the text alone. ``und`` with score 0 if the text is null, empty or has no
    letter, or if the model knows no language. Rows are judged one by one: repeated rows and null ids
    stay, an empty table stays empty. Columns of those two names are replaced.
    """
    # Bounded by the landmarks.
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = docs.columns.index(text_col) if text_col in kept else None
    if place is None:
        raise ValueError(f"no column {text_col}")
    fields = docs.select(*kept).schema
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = predict(sent.value, part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                    [*kept, "lang_pred", "score"],
                )

    out = type(fields)([*fields.fields]).add("lang_pred", "string").add("score", "double")
    return docs.select(*kept).mapInArrow(run, out)
