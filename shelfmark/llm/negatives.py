"""Hard negatives of vectors with labels, by exact whole scores from small residues.

Components are whole numbers, so an inner product is one too. It is computed
modulo several primes, each so small that the products of a block of components
add up exactly in single precision, where matrix products are fast; the residues
give the signed product back by Chinese remaindering, as the product of the
primes passes twice the greatest score there can be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import keep

FACTOR = 256
POSITIVES, NEGATIVES = 5, 3
# Rows of a block on either side, and of the part of a block that is multiplied at a time.
BLOCK_ROWS = 16384
PART_ROWS = 1024
# Components added up before they are reduced; sums of whole numbers below EXACT are exact in single precision.
COMPONENTS, EXACT = 64, 1 << 24
# A vector's greatest square; beyond it scores might pass what 64 bits hold.
MOST_SQUARE = 2.0**52


def primes(bound: int) -> list[int]:
    """The greatest primes for blocks of COMPONENTS whose product passes 2 * `bound`, the greatest absolute score."""
    at, found, product = 2 * int((EXACT / COMPONENTS) ** 0.5) - 1, [], 1
    while product <= 2 * bound:
        if all(at % d for d in range(2, int(at**0.5) + 1)):
            found.append(at)
            product *= at
        at -= 1
    return found


class Residues:
    """Rows of whole components modulo each prime, in single precision."""

    def __init__(self, rows: np.ndarray, moduli: list[int]):
        self.count = len(rows)
        self.parts = []
        for m in moduli:
            r = np.mod(rows, m)
            self.parts.append(np.where(r > m // 2, r - m, r).astype(np.float32))


def _modulo(x: np.ndarray, m: int) -> np.ndarray:
    """Numpy divides whole numbers by one divisor many times faster than it takes remainders."""
    return x - x // m * m


def scores(left: Residues, a: slice, right: Residues, b: slice, moduli: list[int]) -> np.ndarray:
    """Exact inner products of rows a of `left` with rows b of `right`.

    The digits of the mixed radix form are found prime by prime; the last sum is
    taken modulo the product of the primes and made signed.
    """
    product, value = 1, None
    for m, x, y in zip(moduli, left.parts, right.parts, strict=True):
        whole = np.zeros((len(x[a]), len(y[b])), np.int32)
        for at in range(0, x.shape[1], COMPONENTS):
            whole += (x[a, at : at + COMPONENTS] @ y[b, at : at + COMPONENTS].T).astype(np.int32)
            whole = _modulo(whole, m)
        if value is None:
            value = whole
        else:
            if product * m >= 1 << 31:
                value = value.astype(np.int64, copy=False)
            digit = _modulo(_modulo(whole - value, m) * pow(product, -1, m), m)
            value += product * digit
        product *= m
    value -= product * (value > product // 2)
    return value.astype(np.int64, copy=False)


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole n with 50 * p <= 100 * n <= 95 * p."""
    return -((-positive) // 2), positive + (-positive) // 20


NONE = np.iinfo(np.int64).min


def _best(found: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, score) of the greatest of each row, `count` times; of equals the first column. NONE is no score."""
    rows = np.arange(len(found))
    for _ in range(min(count, found.shape[1])):
        at = found.argmax(axis=1)
        value = found[rows, at]
        real = value != NONE
        if not real.any():
            return
        yield rows[real], at[real], value[real]
        found[rows, at] = NONE


def _matrix(values, length: int) -> np.ndarray:
    """Rows of whole components; shorter vectors are filled with zeros."""
    out = np.zeros((len(values), length), np.int64)
    for i, value in enumerate(values):
        out[i, : len(value)] = value
    return out


def _cells(moduli: list[int], length: int, choose: Callable) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The work of one block of anchors and one of rows, part by part; `choose` keeps what it wants of the scores."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            rows = rows.sort_values("id", kind="stable").reset_index(drop=True)
            left, right = (Residues(_matrix(x["vector"], length), moduli) for x in (anchors, rows))
            for a in range(0, len(anchors), PART_ROWS):
                for b in range(0, len(rows), 4 * PART_ROWS):
                    here, there = slice(a, a + PART_ROWS), slice(b, b + 4 * PART_ROWS)
                    out += choose(anchors.iloc[here], rows.iloc[there], scores(left, here, right, there, moduli))
        names = ("anchor_id", "positive_id", "id", "score", "positive_score")
        whole = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * len(names)
        return pd.DataFrame(dict(zip(names, whole, strict=True)))

    return run


def _choose_positives(count: int) -> Callable:
    def choose(anchors: pd.DataFrame, rows: pd.DataFrame, found: np.ndarray) -> list[tuple]:
        ids, own = rows["id"].to_numpy(), anchors["id"].to_numpy()
        fits = (anchors["label"].to_numpy()[:, None] == rows["label"].to_numpy()[None, :]) & (own[:, None] != ids[None, :])
        best = _best(np.where(fits, found, NONE), count)
        return [(own[i], ids[j], ids[j], value, value) for i, j, value in best]

    return choose


def _choose_negatives(count: int) -> Callable:
    def choose(anchors: pd.DataFrame, rows: pd.DataFrame, found: np.ndarray) -> list[tuple]:
        ids, out = rows["id"].to_numpy(), []
        other = np.where(anchors["label"].to_numpy()[:, None] != rows["label"].to_numpy()[None, :], found, NONE)
        own = anchors["id"].to_numpy()
        most = max(map(len, anchors["positives"]))
        for k in range(most):
            has = np.array([len(p) > k for p in anchors["positives"]])
            here = np.flatnonzero(has)
            positive = np.array([anchors["positives"].iat[i][k]["positive_id"] for i in here])
            score = np.array([anchors["positives"].iat[i][k]["positive_score"] for i in here])
            low, high = window(score)
            part = other[here]
            inside = np.where((part >= low[:, None]) & (part <= high[:, None]), part, NONE)
            out += [(own[here[i]], positive[i], ids[j], value, score[i]) for i, j, value in _best(inside, count)]
        return out

    return choose


def usable(vectors: DataFrame, label: Column, factor: int = FACTOR) -> DataFrame:
    """id, label and the whole components floor(factor * x) of the rows that take part; one row for each id."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * factor))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + F.pow(F.floor(x.cast("double") * factor).cast("double"), F.lit(2.0)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), "embedding")
    fit = rows.filter("id is not null and label is not null and embedding is not null").filter(finite).filter(square < MOST_SQUARE)
    plain = fit.select("id", F.struct("label", whole.alias("vector")).alias("row"))
    return plain.groupBy("id").agg(F.max("row").alias("row")).select("id", "row.label", "row.vector")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
    factor: int = FACTOR, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows of other labels that come close to an anchor's nearest rows of its own label.

    General, as the library's own records hold no vectors: `vectors` has vec_id,
    embedding and label (others ignored); `is_anchor` is a condition on the column
    `id`, `label` replaces the column label. A component x counts as
    floor(factor * x); a score is the whole inner product with the anchor, ties
    go to the smaller id. An anchor's positives are its best `positives` other
    rows of its label; for each the best `negatives` rows of other labels with
    50 * positive_score <= 100 * negative_score <= 95 * positive_score are given.

    Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score
    and negative_score. NULL ids, labels and vectors, and vectors with NULL or
    non-finite components, take no part; nor do vectors whose squared length in
    whole components passes MOST_SQUARE (components of thousands times thousands
    of dimensions), whose scores may pass 64 bits. Of rows with one id the
    greatest label, then vector, counts. Shorter vectors are filled with zeros.
    Positives without a negative give no rows, nor does an empty table.

    Anchors and rows are spread over blocks by a digest of the id; each pair of
    blocks is one small task of bounded memory that sends on its best rows only.
    """
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = keep(usable(vectors, F.col("label") if label is None else label, factor), "vectors")
    anchors = rows.filter(is_anchor)
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda total, x: total + x * x)
    number, longest, greatest = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(square)).first()
    asked = anchors.count()
    if not number or not asked:
        return vectors.sparkSession.createDataFrame([], empty)
    moduli = primes(max(int(greatest), 1))
    row_blocks, anchor_blocks = -(-number // block_rows), -(-asked // block_rows)
    block = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    right = rows.withColumns({"row_block": block(row_blocks)}).select("*", every(anchor_blocks).alias("anchor_block"))
    cell = "anchor_id long, positive_id long, id long, score long, positive_score long"

    def met(left: DataFrame, choose: Callable) -> DataFrame:
        spread = left.withColumns({"anchor_block": block(anchor_blocks)}).select("*", every(row_blocks).alias("row_block"))
        keys = ["anchor_block", "row_block"]
        return spread.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_cells(moduli, longest, choose), cell)

    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))
    near = met(anchors, _choose_positives(positives)).withColumn("_n", best("anchor_id")).filter(F.col("_n") <= positives)
    own = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    # Small rows beside the anchors' vectors, cut to these blocks before they are spread.
    asking = keep(anchors.join(own, "id"), "asking")
    hard = met(asking, _choose_negatives(negatives)).withColumn("rank", best("anchor_id", "positive_id").cast("int")).filter(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
