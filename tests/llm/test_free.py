"""Mixing, near copies, neighbours, grades, packing and addresses: brute force and edge cases."""

from __future__ import annotations

import bisect
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import copies, grades, mixing, neighbours, packing, urls
from shelfmark.llm.graph import components

public_tokenizers = pytest.importorskip("public_tokenizers")
BOOKS = "id long, text string, archive string, n int, rank string, label int"


def books(spark, texts, archives=None):
    return spark.createDataFrame([(i, t, archives[i] if archives else "a", 1, "r", None) for i, t in enumerate(texts)], BOOKS)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (300, 300)] + [(500, 500 + i) for i in range(1, 50)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 1 for i in (*range(1, 41), 100)) and found[201] == 200 and found[549] == 500 and 300 not in found
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain(spark):
    """Ascending neighbours and a node with many: rounds grow with the logarithm, and labels are least nodes."""
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 200)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1200), 1000)}


def classes_by_hand(texts):
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} if words else set())
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [(len(s), c) for s, c in zip(sets, label, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_by_hand(spark, seed, monkeypatch):
    monkeypatch.setattr(copies, "LEAF_BOOKS", 4)  # many leaves, so that pairs of them are searched
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = [None, "", "one", "One", "two words", "x y z", "x y z"]
    for size in (9, 10, 12, 19, 20, 30, 60, 200):
        origin = [word() for _ in range(size)]
        for _ in range(14):
            copy = list(origin)
            for _ in range(rng.randint(0, max(1, size // 30))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.4:
                copy = copy[rng.randint(0, size // 12) :]
            texts.append(rng.choice([" ", "\n"]).join(copy))
    found = {r["id"]: (r["n_grams"], r["component"]) for r in copies.near_copies(books(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == classes_by_hand(texts)


def test_near_copies_edges(spark):
    assert copies.near_copies(books(spark, [])).count() == 0
    frame = books(spark, ["a b c d"]).unionAll(books(spark, ["a b c d"])).unionAll(books(spark, ["a b c d", None]).withColumn("id", F.lit(None).cast("long")))
    rows = sorted(((r["id"], r["n_grams"], r["component"]) for r in copies.near_copies(frame).collect()), key=str)
    assert rows == [(0, 2, 0), (0, 2, 0), (None, 0, None), (None, 2, 0)]


def test_plan_by_hand(spark):
    rng = random.Random(5)
    texts = ["w " * rng.randint(0, 40) for _ in range(300)] + [None, "", "x " * 900]
    archives = [rng.choice(["a", "b", "c", "c", "c", None]) for _ in texts]
    schedule = spark.createDataFrame([("a", 0.2, 3.0), ("a", 0.7, 1.0), ("b", 0.0, 1.0), ("c", 0.0, 0.0), ("c", 1.0, 4.0), (None, 0.5, 2.0)], "archive string, at double, weight double")
    frame = books(spark, texts, archives)
    rows = mixing.plan(frame, schedule).collect()
    size = defaultdict(int)
    for t, a in zip(texts, archives, strict=True):
        size[a] += len((t or "").split())
    weight = {"a": 0.2 * 3 + 0.5 * 2 + 0.3 * 1, "b": 1.0, "c": 2.0, None: 2.0}
    target, free, left = {}, set(size), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[a] for a in free)
        over = {a for a in free if level * weight[a] >= 2 * size[a]}
        if not over:
            target |= {a: level * weight[a] for a in free}
            break
        target |= {a: 2.0 * size[a] for a in over}
        left -= sum(2 * size[a] for a in over)
        free -= over
    taken = defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(target[r["archive"]]) and r["archive_size"] == size[r["archive"]]
        assert r["taken"] <= 2 * r["size"] and len(r["positions"]) <= 2 and all(0 <= p <= 1 for p in r["positions"])
        taken[r["archive"]] += r["taken"]
    assert len(rows) == len(texts) and all(abs(taken[a] - target[a]) <= 450 for a in size)
    first = [r["positions"][0] for r in rows if r["positions"]]
    assert first == sorted(first)
    # A weight that rises from 0 is read late: the middle of its words lies at the square root of a half.
    late = np.median([p for r in rows if r["archive"] == "c" for p in r["positions"]])
    assert late == pytest.approx(0.5**0.5, abs=0.1)
    assert rows == mixing.plan(frame.repartition(3), schedule).collect()
    order = [r["position"] for r in mixing.curriculum(mixing.plan(frame, schedule)).collect()]
    assert order == sorted(order) and mixing.plan(frame.limit(0), schedule).count() == 0


def best_fit(lengths, capacity):
    rooms, count = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, length)
        room = rooms.pop(i) if i < len(rooms) else capacity
        count += i == len(rooms) and room == capacity
        bisect.insort(rooms, room - length)
    return len(rooms)


def test_packing_of_counts_equals_best_fit():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice([7, 16, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        places = defaultdict(list)
        for run in packing.pack_counts(counts, capacity):
            for k in range(run.pieces):
                places[run.first + k // run.each].append((run.offset + k % run.each * run.length, run.length))
        assert len(places) == best_fit(lengths, capacity) and sum(map(len, places.values())) == len(lengths)
        for pieces in places.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(7)
    bits = ["Tale", "don't", "l'été", "a,b", "x=\u0338y", "…,", "'", ",", "<|endoftext|>", "<|", "42", "É", "e\u0301", "\u00a0", "ﬁ", "日本語", "😀", "\x1c", "İ", "ΑΣ", "we'll,"]
    texts = [None, "", " ", "long " * 5000] + ["".join(rng.choice(bits) + rng.choice(["", " ", "\n", "\u2003"]) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    rows = packing.pack(books(spark, texts), path).collect()
    expected = set()
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected |= {(i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))}
    assert {(r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected and len(rows) == len(expected)
    assert packing.pack(books(spark, []), path).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    matrix = rng.normal(size=(600, 8)).round(2)
    matrix[50:90] = matrix[50]
    rows = [(int(i), [float(x) for x in v], 1) for i, v in enumerate(matrix)]
    odd = [(1000, None, 1), (1020, [0.0] * 8, 1), (1040, [float("nan")] + [1.0] * 7, 1), (1060, [1.0, None] + [1.0] * 6, 1), (1080, [1.0], 1), (None, [1.0] * 8, 1), (0, rows[0][1], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    found = defaultdict(list)
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0, search_rows=2000).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 600, 20))
    hits = 0
    for query, own in found.items():
        own.sort()
        scores = (matrix * matrix[query]).sum(axis=1)
        order = [int(i) for i in np.lexsort((np.arange(600), -scores)) if i != query][:20]
        assert [rank for rank, _, _ in own] == list(range(1, 21)) and all(scores[v] == pytest.approx(s, abs=1e-12) for _, v, s in own)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(order))
    assert hits >= 0.9 * 20 * len(found)
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(frame.filter("vec_id < 5"), F.col("vec_id") == 0).count() == 4


def test_grades(spark):
    rng = random.Random(9)
    good, bad = [f"calm{i}" for i in range(60)], [f"JUNK{i}!!" for i in range(60)]

    def text(grade):
        return " ".join(rng.choice(bad if rng.random() > grade / 2 else good) for _ in range(60))

    truth = [i % 3 for i in range(360)]
    frame = books(spark, [text(g) for g in truth] + [None, ""])
    ratings = spark.createDataFrame([(i, g) for i, g in enumerate(truth) if i < 240] + [(500, 1), (3, None)], "id long, grade int")
    model = grades.fit(frame, ratings)
    assert list(model.grades) == [0, 1, 2] and list(model.thresholds) == sorted(model.thresholds)
    rows = {r["id"]: r for r in grades.grade(frame, model, 2).collect()}
    right = sum(rows[i]["kept"] == (truth[i] == 2) for i in range(240, 360))
    assert right >= 108 and len(rows) == 362 and rows[360]["tail"] == rows[361]["tail"]
    assert all(0 <= r["expected_grade"] <= 2 for r in rows.values())
    assert grades.fit(frame, ratings.filter("grade = 1")) is None and grades.fit(frame, ratings.limit(0)) is None
    assert all(r["kept"] for r in grades.grade(frame.limit(3), None, 1).collect()) and grades.grade(frame.limit(0), model, 1).count() == 0


def test_urls(spark):
    rules = [urls.Rule("allow", "com"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/")]
    given = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/x?y=/fr/#z", "https://www.example.com/en/", "https://example.com/enx", "https://notexample.com/en/", "http://b.org/q", "x://c.com", "x://h?p://q/r"]
    pages = spark.createDataFrame(list(enumerate(given)), "id long, url string").selectExpr("*", "1 as host", "2 as rule")
    labelled = spark.createDataFrame([(f"http://{'bad' if i % 2 else 'fine'}{i}.org/{i}", i % 2 == 1) for i in range(60)] + [(None, None)], "url string, blocked boolean")
    rows = {r["id"]: r for r in urls.judge(pages, rules, labelled).collect()}
    assert len(rows) == len(given) and all((rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == ("", "", None) for i in range(4))
    assert [(rows[i]["host"], rows[i]["path"]) for i in (4, 8, 10)] == [("a.example.com", "/en/x"), ("b.org", "/q"), ("h", "")]
    assert [rows[i]["rule"] for i in range(4, 10)] == ["example.com/en/", "www.example.com/en/", "com/", "com/", None, None]
    assert [rows[i]["verdict"] for i in range(4, 8)] == ["block", "allow", "allow", "allow"]
    fresh = spark.createDataFrame([(0, "http://bad99.org/1"), (1, "http://fine98.org/1")], "id long, url string")
    assert [r["verdict"] for r in urls.judge(fresh, [], labelled).orderBy("id").collect()] == ["block", "allow"]
    assert {r["verdict"] for r in urls.judge(fresh, [], labelled.limit(0)).collect()} == {"allow"}
    assert urls.judge(fresh.limit(0), rules, labelled).count() == 0
