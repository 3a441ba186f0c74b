"""Grades of books from a few ratings: an ordinal regression on hashed words.

A book's text becomes shares of word shapes and presence of words, hashed; one
set of weights gives a number, and ordered thresholds cut it into grades: the
probability of at least grade k is the logistic function of the number less
threshold k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import text_of
from shelfmark.llm.tokens import LETTER, WHITE, chunks, mixed, words

WORD_BITS, SHAPE_BITS = 18, 10
FEATURES = (1 << WORD_BITS) + (1 << SHAPE_BITS)
# Ratings that the model is fitted on at most, for each grade, by a digest of the book's id.
MOST_RATED = 4096
LEAST_BOOKS = 3
STEPS, RATE, PENALTY = 250, 0.1, 2e-6
LEAST_TAIL = 0.5
# Text that is graded and sent on at a time.
SLICE_BYTES = 4_000_000

_BYTES = np.arange(256)
# Upper case, lower case (with all bytes beyond ASCII), digits; signs stay themselves.
CLASS = np.where((_BYTES >= 65) & (_BYTES <= 90), ord("A"), np.where(LETTER | (_BYTES >= 128), ord("a"), np.where((_BYTES >= 48) & (_BYTES <= 57), ord("0"), _BYTES))).astype(np.uint8)


def shapes(texts: pa.Array) -> np.ndarray:
    """A hash of each word's shape: its classes of characters, repeats left out."""
    found = words(texts, lower=False)
    if not len(found.start):
        return np.zeros(0, np.uint64)
    kind = CLASS[found.data]
    solid = ~WHITE[found.data]
    new = solid.copy()
    new[1:] &= kind[1:] != kind[:-1]
    new[found.start] = True
    kept = np.flatnonzero(new)
    at = np.searchsorted(kept, found.start)
    length = np.diff(np.append(at, len(kept)))
    inside = np.arange(len(kept)) - np.repeat(at, length)
    powers = np.full(int(length.max()), 0x100000001B3, dtype=np.uint64).cumprod()
    return mixed(np.add.reduceat((kind[kept].astype(np.uint64) + np.uint64(1)) * powers[inside], at))


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and values of each text's features."""
    for _, part in chunks(texts):
        found, shape = words(part), shapes(part)
        word = (found.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        shape = (shape >> np.uint64(64 - SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS)
        for i in range(len(part)):
            own = found.of(i)
            n = own.stop - own.start
            present = np.unique(word[own])
            kinds, counts = np.unique(shape[own], return_counts=True)
            yield np.append(present, kinds), np.append(np.full(len(present), 1 / np.sqrt(max(len(present), 1))), np.sqrt(counts / max(n, 1)))


@dataclass
class Model:
    """Weights of features and ascending thresholds; grade k of `grades` is reached beyond threshold k - 1."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def tails(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The probability of at least each grade but the lowest."""
        return 1 / (1 + np.exp(self.thresholds - self.weights[index] @ value))


def _fit(starts: np.ndarray, index: np.ndarray, value: np.ndarray, level: np.ndarray, share: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least weighted loss, by gradient steps of adapted size."""
    books = np.bincount(index, minlength=FEATURES)
    used = np.flatnonzero(books >= LEAST_BOOKS)
    place = np.full(FEATURES, len(used))
    place[used] = np.arange(len(used))
    index = place[index]
    owner = np.repeat(np.arange(len(level)), np.diff(np.append(starts, len(index))))
    params = np.zeros(len(used) + 1 + top)
    params[len(used) + 1 :] = np.arange(top) * 0.1  # first threshold, then logarithms of gaps
    params[len(used) + 2 :] = 0.0
    mean, square = np.zeros_like(params), np.zeros_like(params)
    reached = level[:, None] > np.arange(top)[None, :]
    for step in range(1, STEPS + 1):
        weights = np.append(params[: len(used)], 0.0)
        raw = params[len(used) + 1 :]
        thresholds = raw[0] + np.append(0.0, np.exp(raw[1:]).cumsum())
        z = np.bincount(owner, weights=weights[index] * value, minlength=len(level))
        cumulative = 1 / (1 + np.exp(np.clip(thresholds[None, :] - z[:, None], -40, 40)))
        bounds = np.concatenate([np.ones((len(level), 1)), cumulative, np.zeros((len(level), 1))], axis=1)
        rows = np.arange(len(level))
        high, low = bounds[rows, level], bounds[rows, level + 1]
        p = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        dz = -share * (slope_high - slope_low) / p
        dt = np.zeros(top)
        for k in range(top):
            upper, lower = level == k + 1, level == k
            dt[k] = (share * slope_high / p)[upper].sum() - (share * slope_low / p)[lower].sum()
        grad = np.zeros_like(params)
        grad[: len(used)] = np.bincount(index, weights=value * dz[owner], minlength=len(used) + 1)[: len(used)] + PENALTY * params[: len(used)]
        grad[len(used) + 1] = dt.sum()
        for k in range(1, top):
            grad[len(used) + 1 + k] = dt[k:].sum() * np.exp(raw[k])
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        params -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-10)
    weights = np.zeros(FEATURES)
    weights[used] = params[: len(used)]
    raw = params[len(used) + 1 :]
    return weights, raw[0] + np.append(0.0, np.exp(raw[1:]).cumsum())


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(features(batch.column(1)))
        columns = [batch.column(0), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["grade", "index", "value"])


def fit(books: DataFrame, ratings: DataFrame, most_rated: int = MOST_RATED) -> Model | None:
    """A model of `ratings` (id, grade: whole numbers) over the texts of `books` (id, text).

    At most `most_rated` rated books of each grade are used, the first by a
    digest of their ids; they weigh as all of their grade do. That bounds what
    the driver holds. NULL grades count as none. Ratings of one grade or none
    give no model.
    """
    rated = ratings.filter("grade is not null and id is not null").select(F.col("id").alias("_id"), F.col("grade").cast("long").alias("grade"))
    numbers = {row["grade"]: row["count"] for row in rated.groupBy("grade").count().collect()}
    if len(numbers) < 2:
        return None
    grades = sorted(numbers)
    chosen = None
    for grade in grades:
        part = rated.filter(F.col("grade") == grade).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(most_rated)
        chosen = part if chosen is None else chosen.unionByName(part)
    # Of a size fixed by `most_rated`, so it is sent to every task rather than the texts shuffled.
    texts = books.select("id", text_of().alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("grade", "text")
    rows = texts.mapInArrow(_featured, "grade long, index binary, value binary").toArrow().to_pydict()
    if len(set(rows["grade"])) < 2:
        return None
    grades = sorted(set(rows["grade"]))
    index = [np.frombuffer(x, np.int32).astype(np.int64) for x in rows["index"]]
    level = np.searchsorted(grades, rows["grade"])
    sampled = np.bincount(level)
    share = np.array([numbers[g] for g in grades]) / sampled
    starts = np.append(0, np.cumsum([len(x) for x in index]))[:-1]
    weights, thresholds = _fit(
        starts, np.concatenate(index), np.concatenate([np.frombuffer(x) for x in rows["value"]]), level, (share / share.dot(sampled))[level], len(grades) - 1
    )
    return Model(weights, thresholds, np.array(grades, dtype=np.float64))


def grader(model: Model, grade: int, text: str = "text", given: tuple[str, ...] = ("id",)) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with the columns `given` and `text` to (*given, expected_grade, tail), slice by slice."""
    gaps = np.diff(model.grades)
    wanted = int(np.searchsorted(model.grades, grade)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch.column(text), SLICE_BYTES):
                expected, tail = [], []
                for index, value in features(part):
                    tails = model.tails(index, value)
                    expected.append(float(model.grades[0] + gaps @ tails))
                    tail.append(1.0 if wanted < 0 else float(tails[wanted]) if wanted < len(tails) else 0.0)
                columns = [batch.column(name).slice(at, len(part)) for name in given]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], names=[*given, "expected_grade", "tail"])

    return run


def grade(books: DataFrame, model: Model | None, least_grade: int, least_tail: float = LEAST_TAIL) -> DataFrame:
    """One row for each row of `books` (id, text; others ignored): id, expected_grade, tail and kept.

    `tail` is the probability of `least_grade` or better; a book is kept if it
    reaches `least_tail`. Whole texts are read. NULL and empty texts have no
    features and are judged by the thresholds alone; repeated rows are graded
    each; without a model every book is kept, with NULL grades; no books give no
    rows. Nothing is shuffled.
    """
    if model is None:
        empty = F.lit(None).cast("double")
        return books.select("id", empty.alias("expected_grade"), empty.alias("tail"), F.lit(True).alias("kept"))
    plain = books.select(F.col("id").cast("long").alias("id"), text_of().alias("text"))
    scored = plain.mapInArrow(grader(model, least_grade), "id long, expected_grade double, tail double")
    return scored.withColumn("kept", F.col("tail") >= least_tail)
