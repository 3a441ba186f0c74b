"""Licences within longer texts: sliding windows against brute force."""

from __future__ import annotations

import random
import re
import textwrap

from shelfmark.llm import licences
from shelfmark.llm.licence_texts import TEXTS


def scan(spark, texts, **how):
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r["id"]: r for r in licences.find(frame, **how).collect()}


def test_licences_inside_texts(spark):
    texts = [
        "A tale of old. " * 50 + textwrap.fill(TEXTS["MIT"][1], 60) + " and so on" * 50,
        TEXTS["MIT"][0],
        TEXTS["Apache-2.0"][1],
        "Copyright 2020 Jane Doe. Released under the MIT License. See the file for details.",
        "Copyright (c) 2019 Jane Doe. All rights reserved.",
        textwrap.fill("prose " * 300 + TEXTS["BSD-3-Clause"][0] + " prose" * 300, 70),
        "All rights were reserved by the licensed baker under the bridge. " * 40,
    ]
    found = scan(spark, texts)
    assert [found[i]["licence"] for i in range(7)] == ["MIT", "MIT", "Apache-2.0", "MIT", "all-rights-reserved", "BSD-3-Clause", None]
    assert all(found[i]["dice"] == 1.0 and found[i]["n_notices"] >= 1 for i in range(6)) and found[6]["n_notices"] == 0


def test_passages_count_once(spark):
    one, other = "Released under the MIT License", "All rights reserved"
    prose = " ".join(f"p{i}" for i in range(30)) + " "
    texts = [f"{one}\n{prose}", f"{prose}{one} y {other} z {one} {prose}", f"{one}\n{prose}{one} {prose}", f"{prose}{other}", prose]
    found = scan(spark, texts)
    assert [found[i]["n_notices"] for i in range(5)] == [1, 2, 1, 1, 0]


def by_hand(text, templates, least):
    pairs = lambda t: list(zip(w := re.findall("[a-z0-9]+", t.lower()), w[1:]))
    best = {}
    for name, notice in templates.items():
        own, all_pairs = set(pairs(notice)), pairs(text)
        reach = int(len(own) * (2 - least) / least + 1e-9)
        for i in range(len(all_pairs)):
            for j in range(i + 1, min(i + reach, len(all_pairs)) + 1):
                window = set(all_pairs[i:j])
                dice = 2 * len(window & own) / (len(window) + len(own))
                if dice >= least:
                    best[name] = max(best.get(name, 0), dice)
    return best


def test_windows_by_hand(spark):
    rng = random.Random(11)
    templates = {"one": "a b c d e f g", "two": "a b a c a b d e", "three": "f g", "four": "c d e f g a b h i j k l"}
    texts = []
    for _ in range(300):
        words = rng.choice(list(templates.values())).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice("abcdefgh")
        around = lambda: [rng.choice("abcdefghijxyz") for _ in range(rng.randint(0, 9))]
        texts.append("".join(word + rng.choice([" ", ", ", "\n"]) for word in around() + words + around()))
    for least in (0.6, 0.8):
        found = scan(spark, texts, templates=templates, least_dice=least)
        for i, text in enumerate(texts):
            best = by_hand(text, templates, least)
            assert found[i]["licences"] == sorted(best) and found[i]["dice"] == (round(max(best.values()), 6) if best else None), text
