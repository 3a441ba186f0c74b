"""Toxic passages of books: segments of greatest score over the log-odds of their words.

From books rated toxic or not, each word gets the log-odds of a book holding it,
with a Dirichlet prior proportional to the books that hold it in all, brought
towards 0 by two standard errors, less a price for being read. A word that one
book repeats a hundred times counts once. A linear scan finds all maximal segments
of a text. The greatest segment of a text that is not toxic follows an extreme
value distribution, so a passage has an expected number of its like in a text
of that length; the passages of a book are added up by the sum statistic of
that theory, and a logistic curve turns it into the share of toxic books.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import keep, text_of
from shelfmark.llm.tokens import chunks, words

# Words are told apart by this many bits of their hash: what bounds the model, however large the corpus.
WORD_BITS = 20
# Pseudo-counts of the prior in all, and the standard errors by which log-odds are brought towards 0.
PRIOR, ERRORS = 1000.0, 1.96
PRICE = 0.1
# Passages expected more often than this in a text that is not toxic are left out.
MOST_EXPECTED = 0.05
FOLDS = 2
# Rated books of each kind that the model is fitted on at most, by a digest of their ids.
MOST_RATED = 65_536
# Steps of the statistic at which the curve is fitted.
STEPS_A_UNIT, MOST_STATISTIC = 100, 12.0


@dataclass
class Passages:
    """A word's score by its bucket, and the extreme value law of texts that are not toxic."""

    scores: np.ndarray
    decay: float
    factor: float = 1.0


@dataclass
class Model:
    """`passages` of all ratings, and intercept and slope of the curve over the statistic."""

    passages: Passages | None
    intercept: float
    slope: float


def _buckets(found) -> np.ndarray:
    return (found.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (class, text) to the books that hold each word, and its occurrences, by class: tables of fixed size for each task."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        kinds = batch.column(0).to_numpy(zero_copy_only=False)
        for at, part in chunks(batch.column(1)):
            found = words(part, split_signs=True)
            book = np.repeat(np.arange(len(part)), np.diff(found.first))
            held, n = np.unique((book << WORD_BITS) | _buckets(found), return_counts=True)
            kind, bucket = kinds[at + (held >> WORD_BITS)], held & ((1 << WORD_BITS) - 1)
            for k in np.unique(kind).tolist():
                if k not in totals:
                    totals[k] = np.zeros((2, 1 << WORD_BITS), np.int64)
                own = kind == k
                np.add.at(totals[k][0], bucket[own], 1)
                np.add.at(totals[k][1], bucket[own], n[own])
    for k, total in totals.items():
        own = np.flatnonzero(total[0])
        for at in range(0, len(own), 65536):
            here = own[at : at + 65536]
            columns = [pa.array(np.full(len(here), k, np.int64)), pa.array(here), pa.array(total[0][here]), pa.array(total[1][here])]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "books", "n"])


def log_odds(toxic: Column, clean: Column, every: Column, toxic_all: int, clean_all: int, every_all: int) -> Column:
    """Log-odds of words between two counts of books, with a prior that follows `every`, brought towards 0 by ERRORS standard errors."""
    prior = every * (PRIOR / max(every_all, 1))
    a, b = toxic + prior, clean + prior
    odds = F.log(a / (toxic_all + PRIOR - a)) - F.log(b / (clean_all + PRIOR - b))
    return F.signum(odds) * F.greatest(F.abs(odds) - ERRORS * F.sqrt(1 / a + 1 / b), F.lit(0.0))


def decay_of(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root x of: the mean of exp(x * score) over words drawn by `shares` is 1."""
    used = shares > 0
    scores, shares = scores[used], shares[used] / shares[used].sum()
    if not len(scores) or scores.max() <= 0 or shares @ scores >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while shares @ np.exp(high * scores) < 1:
        low, high = high, 2 * high
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if shares @ np.exp(middle * scores) < 1 else (low, middle)
    return high


def maximal_segments(before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments over runs of positive words, in linear time: (first run, last run, score).

    Run i lifts the running sum from before[i] to after[i]. A run joins the
    segments to its left as long as one began lower and ended lower; `back`
    names the next candidate of each segment, so none is looked at twice.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    back: list[int] = []
    for i, (left, right) in enumerate(zip(before.tolist(), after.tolist(), strict=True)):
        start = i
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = back[j]
            if j < 0 or high[j] >= right:
                first.append(start), last.append(i), low.append(left), high.append(right), back.append(j)
                break
            start, left = first[j], low[j]
            del first[j:], last[j:], low[j:], high[j:], back[j:]
    return [(a, b, h - v) for a, b, v, h in zip(first, last, low, high, strict=True)]


def segments_of(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal segments of word scores: (first word, word after the last, score)."""
    up = scores > 0
    if not up.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.append(0.0, scores.cumsum())
    return [(int(starts[a]), int(ends[b]), s) for a, b, s in maximal_segments(sums[starts], sums[ends])]


def statistic(scores: np.ndarray, n_words: int, law: Passages) -> tuple[float, np.ndarray]:
    """How unlikely a text that is not toxic has such passages, and each one's expected number.

    The passages that count are added up: the chance that r normalised scores
    add up to t is about exp(-t) * t^(r - 1) / (r! (r - 1)!). The statistic is
    log(1 - log(chance)), so that a long book of many passages outweighs no curve.
    """
    if not len(scores) or not n_words:
        return 0.0, np.zeros(0)
    normal = law.decay * scores - np.log(law.factor * n_words)
    expected = np.exp(-np.maximum(normal, -700.0))
    top = float(expected.min())
    single = -np.log(-np.expm1(-top)) if top > 1e-300 else float(normal.max())  # of one passage: 1 - exp(-expected)
    counted = np.sort(normal[expected <= MOST_EXPECTED])
    r = len(counted)
    if r < 2:
        return float(np.log1p(max(single, 0.0))), expected
    orders = np.log(np.arange(1, r + 1)).sum(), np.log(np.arange(1, r)).sum()
    total = counted.sum()
    return float(np.log1p(max(total - (r - 1) * np.log(total) + sum(orders), single, 0.0))), expected


def _read(texts: pa.Array, law: Passages) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray, np.ndarray]]:
    """Words, segments, and the byte places where words begin and end, of each text; places count from the text's begin."""
    for _, part in chunks(texts):
        found = words(part, split_signs=True)
        score = law.scores[_buckets(found)]
        for i in range(len(part)):
            own = found.of(i)
            yield own.stop - own.start, segments_of(score[own]), found.start[own], found.length[own]


def _points(text: bytes, at: np.ndarray) -> np.ndarray:
    """Code points before byte places of a text."""
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.append(0, lead.cumsum())[at]


def _measured(laws: list[Passages]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (fold, toxic, text) to (fold, toxic, words, greatest score, scores) by the law of the other fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            n, scores = np.zeros(len(folds), np.int64), [b""] * len(folds)
            greatest = np.zeros(len(folds))
            for fold in range(len(laws)):
                own = np.flatnonzero(folds == fold)
                for i, (count, found, _, _) in zip(own.tolist(), _read(texts.take(pa.array(own)), laws[fold]), strict=True):
                    s = np.array([x for _, _, x in found])
                    n[i], scores[i], greatest[i] = count, s.tobytes(), s.max(initial=0.0)
            columns = [batch.column(0), batch.column(1), pa.array(n), pa.array(greatest), pa.array(scores, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["fold", "toxic", "n", "greatest", "scores"])

    return run


def _stepped(laws: list[Passages]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = []
            for fold, n, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                value, _ = statistic(np.frombuffer(raw), n, laws[fold])
                steps.append(int(round(min(value, MOST_STATISTIC) * STEPS_A_UNIT)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(steps, pa.int64())], names=["toxic", "step"])

    return run


def curve(value: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the logistic curve of likeliest fit, one book of each kind added at the mean; the slope is not negative."""
    value = np.append(value, [value.mean()] * 2)
    toxic, clean = np.append(toxic, [1.0, 0.0]), np.append(clean, [0.0, 1.0])
    params, design = np.array([np.log(toxic.sum() / clean.sum()), 0.0]), np.column_stack([np.ones(len(value)), value])
    number = toxic + clean
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ params, -30, 30)))
        grad = design.T @ (toxic - number * p) - np.array([0.0, 1e-3]) * params
        hess = (design * (number * p * (1 - p))[:, None]).T @ design + np.diag([1e-9, 1e-3])
        step = np.linalg.solve(hess, grad)
        params = params + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    if params[1] < 0:
        return float(np.log(toxic.sum() / clean.sum())), 0.0
    return float(params[0]), float(params[1])


def fit(books: DataFrame, ratings: DataFrame, most_rated: int = MOST_RATED) -> Model:
    """A model of `ratings` (id, toxic: 0 or 1) over the texts of `books` (id, text).

    Words are counted over all books for the prior, and for the log-odds over at
    most `most_rated` rated ones of each kind, the first by a digest of their
    ids, which are sent to every task so that no text is shuffled. They weigh as
    all of their kind do. An id's greatest rating counts, NULLs count as none.
    The extreme value law and the curve are fitted on rated books that each half
    of these ratings scores for the other half, so that no book judges itself.
    Without ratings of both kinds there are no passages, and every
    book gets the share of toxic ones (0 without any).

    The driver holds one number for each telling bucket of words (2^WORD_BITS
    buckets at most) and one for each step of the statistic.
    """
    rated = ratings.filter("id is not null and toxic is not null").groupBy(F.col("id").alias("_id")).agg(F.max((F.col("toxic") > 0).cast("long")).alias("toxic"))
    rated = keep(rated.withColumn("fold", F.pmod(F.xxhash64("_id"), F.lit(FOLDS))), "ratings")
    first = lambda kind: rated.filter(F.col("toxic") == kind).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(most_rated)
    numbers = {row["toxic"]: row["count"] for row in rated.groupBy("toxic").count().collect()}
    if len(numbers) < 2:
        only = numbers.get(1, 0) / max(sum(numbers.values()), 1)
        return Model(None, 30.0 if only else -30.0, 0.0)
    rated = F.broadcast(keep(first(0).unionByName(first(1)), "rated"))  # 2 * most_rated rows at most
    texts = books.select("id", text_of().alias("text"))
    kind = F.coalesce(F.col("fold") * 2 + F.col("toxic"), F.lit(-1).cast("long"))
    classed = texts.join(rated, F.col("id") == F.col("_id"), "left").select(kind.alias("kind"), "text")
    count = lambda what, *kinds: F.sum(F.when(F.col("kind").isin(list(kinds)), F.col(what)).otherwise(0))
    sums = [F.sum("books").alias("every")]
    for f in range(FOLDS):
        sums += [count("books", 2 * f + 1).alias(f"toxic{f}"), count("books", 2 * f).alias(f"clean{f}"), count("n", 2 * f).alias(f"n{f}")]
    buckets = keep(classed.mapInArrow(_counted, "kind long, bucket long, books long, n long").groupBy("bucket").agg(*sums), "words")
    all_ = buckets.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in buckets.columns if c != "bucket"]).first()

    def law(name: str, folds: list[int]) -> list[Column]:
        """The log-odds of a bucket by these folds, and how likely a word of a book that is not toxic is there."""
        add = lambda what: sum((F.col(f"{what}{f}") for f in folds[1:]), F.col(f"{what}{folds[0]}"))
        whole = lambda what: sum(all_[f"{what}{f}"] for f in folds)
        odds = log_odds(add("toxic"), add("clean"), F.col("every"), whole("toxic"), whole("clean"), all_["every"])
        share = (add("n") + F.col("every") * (PRIOR / max(all_["every"], 1))) / (whole("n") + PRIOR)
        return [odds.alias(f"odds_{name}"), share.alias(f"share_{name}")]

    names = [*map(str, range(FOLDS)), "all"]
    others = {**{str(own): [f for f in range(FOLDS) if f != own] for own in range(FOLDS)}, "all": list(range(FOLDS))}
    odds = buckets.select("bucket", *[c for name in names for c in law(name, others[name])])
    # Most words speak for neither side and stay in Spark.
    telling = odds.filter(" or ".join(f"odds_{name} <> 0" for name in names)).toArrow()
    at = telling.column("bucket").to_numpy()

    def passages(name: str) -> Passages:
        scores = np.full(1 << WORD_BITS, -PRICE, np.float32)
        own, share = telling.column(f"odds_{name}").to_numpy() - PRICE, telling.column(f"share_{name}").to_numpy()
        scores[at] = own
        return Passages(scores, decay_of(np.append(own, -PRICE), np.append(share, max(1 - share.sum(), 0.0))))

    laws, whole = [passages(name) for name in names[:-1]], passages("all")
    own = texts.join(rated, F.col("id") == F.col("_id")).select("fold", "toxic", "text")
    measured = keep(own.mapInArrow(_measured(laws), "fold long, toxic long, n long, greatest double, scores binary"), "measured")
    # With the decay known, n * exp(-decay * greatest) is exponential with the factor as its rate.
    decays = F.get(F.array(*[F.lit(x.decay) for x in laws]), F.col("fold").cast("int"))
    null = measured.filter("toxic = 0 and n > 0").groupBy("fold").agg(F.count("*").alias("m"), F.sum(F.col("n") * F.exp(-decays * F.col("greatest"))).alias("t"))
    rates = {row["fold"]: row["m"] / max(row["t"], 1e-300) for row in null.collect()}
    for f, x in enumerate(laws):
        x.factor = rates.get(f, 1.0)
    whole.factor = float(np.mean(list(rates.values()))) if rates else 1.0
    steps = measured.mapInArrow(_stepped(laws), "toxic long, step long").groupBy("step").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).collect()
    value, toxic, number = (np.array(x, dtype=np.float64) for x in zip(*((r["step"] / STEPS_A_UNIT, r["a"], r["n"]) for r in steps), strict=True)) if steps else (np.zeros(1),) * 3
    weigh = lambda found, kind: found * (numbers[kind] / max(found.sum(), 1.0))
    intercept, slope = curve(value, weigh(toxic, 1), weigh(number - toxic, 0))
    return Model(whole, intercept, slope)


PASSAGES = "array<struct<start: long, end: long, score: double, expected: double>>"
_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))


def _judge(shared, intercept: float, slope: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        law = shared.value
        for batch in batches:
            texts, chance, passages = batch.column(1), [], []
            for i, (n, found, start, length) in enumerate(_read(texts, law)):
                value, expected = statistic(np.array([s for _, _, s in found]), n, law)
                chance.append(1 / (1 + np.exp(-np.clip(intercept + slope * value, -30, 30))))
                own = [(a, b - 1, s, e) for (a, b, s), e in zip(found, expected.tolist(), strict=True) if e <= MOST_EXPECTED]
                places: list[dict] = []
                if own:
                    raw = texts[i].as_py().encode()
                    shift = int(start[0]) - _leading(raw)
                    begin = _points(raw, start[[a for a, *_ in own]] - shift)
                    end = _points(raw, start[[b for _, b, *_ in own]] + length[[b for _, b, *_ in own]] - shift)
                    places = [{"start": x, "end": y, "score": s, "expected": e} for x, y, (_, _, s, e) in zip(begin.tolist(), end.tolist(), own, strict=True)]
                passages.append(places)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chance, pa.float64()), pa.array(passages, _PASSAGES)], names=["id", "score", "passages"])

    return run


def _leading(text: bytes) -> int:
    """Bytes of white space that a text begins with."""
    return len(text) - len(text.lstrip(b" \t\n\x0b\f\r"))


def find(books: DataFrame, model: Model) -> DataFrame:
    """One row for each row of `books` (id, text; others ignored): id, score and passages.

    `score` is the chance from 0 to 1 that the book is toxic; `passages` are its
    segments that a book of its length that is not toxic has at most
    MOST_EXPECTED times: start and end in code points (end exclusive), score and
    that expected number. Words are runs without ASCII white space, A-Z folded,
    also cut where a letter meets an ASCII sign. Whole texts are read. NULL and
    empty texts have no passage and the lowest score; repeated rows are judged
    each, NULL ids stay; no books give no rows. Nothing is shuffled.
    """
    plain = books.select(F.col("id").cast("long").alias("id"), text_of().alias("text"))
    if model.passages is None:
        chance = 0.0 if model.intercept < 0 else 1.0
        return plain.select("id", F.lit(chance).alias("score"), F.array().cast(PASSAGES).alias("passages"))
    # Of a size fixed by WORD_BITS.
    shared = books.sparkSession.sparkContext.broadcast(model.passages)
    return plain.mapInArrow(_judge(shared, model.intercept, model.slope), f"id long, score double, passages {PASSAGES}")
