"""Toxic passages, hard negatives and the audit of archives: brute force and edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import audit, negatives, queries_mined, toxicity
from shelfmark.llm.tokens import words

FOLDER = "/root/testdata/sf0.01"
BOOKS = "id long, text string, lang string, archive string, rank int, value string, start int, label int"


def books(spark, rows):
    """(text, lang, archive) as books, with further columns whose names clash with those of results."""
    return spark.createDataFrame([(i, *row, 1, "v", 2, None) for i, row in enumerate(rows)], BOOKS)


# --- words -----------------------------------------------------------------------------


@pytest.mark.parametrize("size", [8, 64, 1024, 4096])
def test_words_that_polynomials_take_for_one(size):
    one = "a"
    while len(one) < size:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    found = words(pa.array([f"{one} {two} {one}", one])).hash
    assert found[0] == found[2] == found[3] != found[1]


# --- toxic passages ----------------------------------------------------------------------


def maximal_by_hand(scores):
    """The defining recursion: the greatest segment, then the same left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            # Of equal totals the shorter segment.
            if total > best + 1e-9 or (abs(total - best) <= 1e-9 and at and j + 1 - i < at[1] - at[0]):
                best, at = total, (i, j + 1)
    if at is None or best <= 0:
        return []
    return [*maximal_by_hand(scores[: at[0]]), (*at, best), *((a + at[1], b + at[1], s) for a, b, s in maximal_by_hand(scores[at[1] :]))]


@pytest.mark.parametrize("seed", range(30))
def test_maximal_segments_by_hand(seed):
    rng = random.Random(seed)
    scores = np.array([rng.choice([-1.7, -0.9, -0.3, 0.6, 1.1, 2.3]) + rng.random() / 100 for _ in range(rng.choice([1, 5, 20, 40]))])
    found = toxicity.segments_of(scores)
    assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in maximal_by_hand(scores.tolist())]
    assert all(math.isclose(s, scores[a:b].sum()) for a, b, s in found)


def test_decay_and_statistic():
    scores, shares = np.array([-1.0, 2.0]), np.array([0.9, 0.1])
    decay = toxicity.decay_of(scores, shares)
    assert decay > 0 and math.isclose(shares @ np.exp(decay * scores), 1, rel_tol=1e-6)
    law = toxicity.Passages(scores, 1.0, 0.1)
    value = lambda s, n: toxicity.statistic(np.array(s), n, law)[0]
    assert value([], 10) == value([3.0], 0) == 0 < value([3.0], 1000) < value([12.0], 1000) < value([12.0, 12.0], 1000)
    assert value([12.0], 1000) > value([12.0], 100_000) and math.isfinite(value([5000.0] * 40, 10))
    intercept, slope = toxicity.curve(np.array([0.0, 1.0, 2.0]), np.array([1.0, 5.0, 9.0]), np.array([99.0, 5.0, 1.0]))
    assert slope > 0 and 1 / (1 + math.exp(-intercept)) < 0.1
    assert toxicity.curve(np.array([0.0, 1.0]), np.array([5.0, 0.0]), np.array([0.0, 5.0]))[1] == 0


def rated_books(rng):
    plain = [f"word{i}" for i in range(300)]
    rows, ratings = [], []
    for i in range(240):
        text = [rng.choice(plain) for _ in range(rng.choice([30, 80, 200]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["Scoundrel,", "villain", "FIEND!"])
        rows.append((" ".join(text), "en", "a"))
        ratings.append((i, int(toxic)))
    return rows, ratings


def test_planted_passages_are_found(spark):
    rows, ratings = rated_books(random.Random(7))
    quiet = "word1 word2 word3 " * 40
    edges = [
        (f"\n {quiet}é中 villain fiend, scoundrel villain {quiet}", "en", "a"), (quiet, "en", "a"), (None, None, None), ("", "", ""), (quiet, "en", "a"),
        (quiet * 3000 + "villain fiend scoundrel fiend villain " + quiet * 3000, "en", "b"), ("villain", "en", "a"), ("junk " * 300, "en", "a"),
    ]
    frame = books(spark, rows + edges)
    model = toxicity.fit(frame, spark.createDataFrame([*ratings, (3, None), (None, 1), (1, 0)], "id long, toxic int"))
    found = {r["id"]: r for r in toxicity.find(frame, model).collect()}
    assert len(found) == len(rows) + len(edges)
    right = sum((found[i]["score"] >= 0.3) == bool(t) for i, t in ratings)
    assert right >= 0.97 * len(ratings)
    first = len(rows)
    (passage,) = found[first]["passages"]
    text = edges[0][0]
    assert text[passage["start"] : passage["end"]] == "villain fiend, scoundrel villain".replace(", ", ", ") and passage["expected"] <= toxicity.MOST_EXPECTED
    assert found[first]["score"] > 0.5 > 0.3 > found[first + 1]["score"] == found[first + 4]["score"]
    assert found[first + 2]["score"] == found[first + 3]["score"] <= found[first + 1]["score"] and not found[first + 2]["passages"]
    (far,) = found[first + 5]["passages"]
    assert edges[5][0][far["start"] : far["end"]] == "villain fiend scoundrel fiend villain"
    assert found[first + 7]["score"] < 0.3


def test_toxicity_without_ratings_or_books(spark):
    frame = books(spark, [("a b", "en", "a"), (None, None, None)])
    none = spark.createDataFrame([], "id long, toxic int")
    assert [r["score"] for r in toxicity.find(frame, toxicity.fit(frame, none)).collect()] == [0.0, 0.0]
    every = spark.createDataFrame([(0, 1)], "id long, toxic int")
    assert [r["score"] for r in toxicity.find(frame, toxicity.fit(frame, every)).collect()] == [1.0, 1.0]
    rated = spark.createDataFrame([(0, 1), (1, 0), (5, 1), (7, 0)], "id long, toxic int")
    assert toxicity.find(frame.limit(0), toxicity.fit(frame.limit(0), rated)).count() == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the generated tables")
def test_toxicity_of_books_held_out(spark):
    found = {r["doc_id"]: r for r in queries_mined.op11_toxic_passages(spark, FOLDER).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [(found[i]["predicted"], t) for i, t in labels.items() if found[i]["held_out"]]
    assert sum(p and t for p, t in held) >= 0.55 * sum(t for _, t in held) and sum(p and not t for p, t in held) <= 0.05 * len(held)
    import zlib

    assert len(found) == 1000 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())


# --- hard negatives -----------------------------------------------------------------------


def negatives_by_hand(rows, step, positives=5, count=3):
    whole = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        scaled = [math.floor(256 * x) for x in vector]
        whole[key] = max(whole.get(key, (label, scaled)), (label, scaled))
    out = []
    for a, (label, left) in whole.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(left, v, strict=False)), i, other) for i, (other, v) in whole.items() if i != a)
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(i, -n) for n, i, other in scored if other != label and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(a, positive, rank, i, -p, n) for rank, (i, n) in enumerate(fits[:count], 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "size", "block"), [(1, 6, 7), (2, 70, 1000), (3, 130, 50)])
def test_negatives_by_hand(spark, seed, size, block, monkeypatch):
    monkeypatch.setattr(negatives, "PART_ROWS", 4)
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=size) * (1000 if seed == 3 else 1) + 0.4], int(rng.integers(3))) for i in range(120)]
    rows += [(200, rows[3][1], 2), (201, rows[3][1], 2), (202, None, 1), (203, [], 0), (204, [1.0, None], 0), (205, [float("nan")], 0), (206, [float("-inf")], 1)]
    rows += [(207, rows[4][1], None), (None, rows[4][1], 1), (3, rows[3][1], rows[3][2]), (10, rows[11][1], 0), (208, rows[5][1][: size // 2], 1), (210, [0.0] * size, 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, id string")
    found = negatives.hard_negatives(frame, F.col("id") % 10 == 0, block_rows=block)
    assert sorted(tuple(r) for r in found.collect()) == negatives_by_hand(rows, 10)


def test_negatives_edges(spark):
    schema = "vec_id long, embedding array<double>, label int"
    none = spark.createDataFrame([], schema)
    assert negatives.hard_negatives(none, F.col("id") % 10 == 0).count() == 0
    lone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], schema)
    assert negatives.hard_negatives(lone, F.col("id") % 10 == 0).count() == 0  # no positive
    assert negatives.hard_negatives(lone, F.col("id") < 0).count() == 0  # no anchor
    huge = spark.createDataFrame([(0, [1e300], 1), (1, [1.0], 1), (2, [1.0], 2)], schema)
    assert negatives.hard_negatives(huge, F.col("id") % 10 == 0).count() == 0


@pytest.mark.parametrize(("size", "most"), [(64, 60), (200, 5000), (3, 10_000_000), (1, 1 << 25)])
def test_residues_are_exact(size, most):
    rng = np.random.default_rng(size)
    left, right = rng.integers(-most, most + 1, (30, size)), rng.integers(-most, most + 1, (40, size))
    moduli = negatives.primes(int(max((left**2).sum(1).max(), (right**2).sum(1).max())))
    found = negatives.scores(negatives.Residues(left, moduli), slice(2, 30), negatives.Residues(right, moduli), slice(0, 40), moduli)
    assert (found == left[2:] @ right.T).all()
    assert len(set(moduli)) == len(moduli) and all(m * m * negatives.COMPONENTS / 4 <= negatives.EXACT for m in moduli)


def test_window():
    values = np.arange(-300, 300)
    low, high = negatives.window(values)
    for p, a, b in zip(values.tolist(), low.tolist(), high.tolist(), strict=True):
        assert [n for n in range(-400, 400) if 50 * p <= 100 * n <= 95 * p] == list(range(a, b + 1))


# --- divergence ---------------------------------------------------------------------------


def divergence_by_hand(rows, most=200):
    count, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, archive in rows:
        lang, archive = lang or "", archive or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, archive))
        count[lang, archive].update(found)
        held[lang].update(set(found))
    out = []
    for lang, archive in groups:
        kept = sorted(t for t, n in held[lang].items() if n >= 3)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        p = share(count[lang, archive])
        whole = share(sum((count[g] for g in groups if g[0] == lang), Counter()))
        pairs = []
        for other in sorted(a for g, a in groups if g == lang and a != archive):
            q = share(count[lang, other])
            pairs.append((other, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)))
        terms = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in kept if count[lang, archive][t] and p[t] > whole[t]]
        for part, items, limit in (("pair", pairs, None), ("term", terms, most)):
            ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out += [(lang, archive, part, item, value, rank) for rank, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_by_hand(spark, seed, monkeypatch):
    monkeypatch.setattr(audit, "PLACES", 12)  # many small trees
    rng = random.Random(seed)
    vocabulary = [*(f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(20)), "ÉCOLE", "école", "École", "don't", "naïve", "a1b", "中文"]
    rows = []
    for _ in range(90):
        archive = rng.choice(["a", "a", "a", "B", "ü", "c", None])
        own = vocabulary[: rng.choice([4, 12, len(vocabulary)])]
        rows.append((" ".join(rng.choice(own) for _ in range(rng.randrange(25))), rng.choice(["en", "en", "de", None]), archive))
    rows += [(None, "en", "void"), ("once only here", "xx", "a"), ("other", "xx", "b"), ("", "en", "a"), ("lone lone", "yy", "z"), rows[0], rows[0]]
    rows.append(("wax " * 200_000, "en", "long"))
    found = audit.divergence(books(spark, rows), most_terms=7)
    assert sorted(tuple(r) for r in found.collect()) == divergence_by_hand(rows, 7)


def test_divergence_of_no_books(spark):
    assert audit.divergence(books(spark, [("a", "en", "a")]).limit(0)).count() == 0
    assert audit.divergence(books(spark, [(None, None, None)])).count() == 0


def test_shares_beyond_64_bits(spark):
    row = spark.range(1).select(audit.share(F.lit(5 * 10**11), F.lit(10**13), F.lit(10**6)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (5 * 10**11 + 1) // (10**13 + 10**6)
