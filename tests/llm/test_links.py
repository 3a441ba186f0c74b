"""All links of the n-gram join against brute force, and ids that repeat with other texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from shelfmark.llm import copies


def sets_of(texts):
    return [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]


def variants(rng, count, size=80):
    origin = [str(rng.randrange(10_000)) for _ in range(size)]
    out = []
    for _ in range(count):
        copy = list(origin)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(size)] = str(rng.randrange(10_000))
        out.append(" ".join(copy))
    return out


def linked_by_hand(texts):
    sets = sets_of(texts)
    return {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])}


def test_every_link_counts(spark, monkeypatch):
    monkeypatch.setattr(copies, "LEAF_BOOKS", 8)
    monkeypatch.setattr(copies, "BLOCK_GRAMS", 16)
    rng = random.Random(12)
    texts = [t for _ in range(3) for t in variants(rng, 30)] + variants(rng, 1)
    texts += texts[:3]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r["id"]: r["n_links"] for r in copies.near_copies(frame).collect()}
    sets = [frozenset(s) for s in sets_of(texts)]
    by_hand = linked_by_hand(texts)
    others = lambda i: {sets[a + b - i] for a, b in by_hand if i in (a, b)}
    assert [found[i] for i in range(len(texts))] == [len(others(i)) for i in range(len(texts))]
    assert max(found.values()) > 3


def test_links_returns_every_pair(spark):
    texts = list(dict.fromkeys(variants(random.Random(13), 25)))
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    profile = frame.mapInArrow(copies.profiler(3), copies.PROFILE)
    sets = profile.groupBy("hi", "lo", "n").agg(F.min("id").alias("id"))
    pairs = [(r["a"], r["b"]) for r in copies.links(frame, sets).collect()]
    assert {(max(p), min(p)) for p in pairs} == linked_by_hand(texts) and len(pairs) == len(set(pairs))


def test_other_text_of_a_repeated_id_keeps_its_links(spark):
    base = [f"w{i}" for i in range(100)]
    changed = lambda *at: " ".join("x" + w if i in at else w for i, w in enumerate(base))
    # By size, 1's second text follows its first; it alone links with 2.
    rows = [(1, " ".join(changed(20).split()[:98])), (1, " ".join(base[:99])), (2, changed(60))]
    assert expected_links(rows) == [1, 2, 1]
    found = copies.near_copies(spark.createDataFrame(rows, "id long, text string")).collect()
    assert sorted((r["id"], r["component"], r["n_links"]) for r in found) == sorted((1, 1, n) for n in expected_links(rows)[:2]) + [(2, 1, expected_links(rows)[2])]


def expected_links(rows):
    by_hand = linked_by_hand([t for _, t in rows])
    return [sum(i in pair for pair in by_hand) for i in range(len(rows))]
