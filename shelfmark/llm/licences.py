"""Licence notices in book texts, by likeness to templates.

Texts are normalised and compared with each template by the Dice coefficient of
their sets of word pairs: the lines and paragraphs, and every window that slides
over the whole text, up to the greatest size that can reach the least
coefficient. What reaches it shares a number of pairs with the template at
least, so of any few more pairs than may be missing it has one: texts without
these are passed over after one regular expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import let, text_of
from shelfmark.llm.licence_texts import TEXTS

# Names and short notices of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0",
    "all-rights-reserved": "All rights reserved",
}
LEAST_DICE = 0.8
GAP = r"[^\p{L}\p{N}]++"
WINDOW = "struct<start:int,end:int,less:double,name:string>"


def normalised(text: Column) -> Column:
    """Lower case; every run of other characters than letters and digits becomes one blank."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def neighbours_of(words: Column) -> Column:
    """The pairs of neighbouring words in order, each pair as text."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda word, i: F.concat_ws(" ", word, F.get(words, i + 1)))


def word_pairs(plain: Column) -> Column:
    """The distinct pairs of neighbouring words, each pair as text."""
    return let(F.split(plain, " "), lambda words: F.array_distinct(neighbours_of(words)))


def least_shared(size: int, least_dice: float) -> int:
    """Pairs that any set shares with one of `size` when they reach the coefficient."""
    return max(1, math.ceil(size * least_dice / (2 - least_dice) - 1e-9))


def any_needed(pairs: list[str], least_dice: float) -> set[str]:
    """Pairs of a template, long ones first, of which every match has one: one more than a match may lack."""
    return set(sorted(pairs, key=lambda pair: (-len(pair), pair))[: len(pairs) - least_shared(len(pairs), least_dice) + 1])


def one_of(pairs: set[str]) -> str:
    """A pattern that finds any of the pairs in a lower-case text, as normalising would make them; told apart by first letters."""
    tree: dict[str, dict[str, list[str]]] = {}
    for first, second in sorted(pair.split(" ") for pair in pairs):
        tree.setdefault(first[0], {}).setdefault(first[1:], []).append(second)
    rests = lambda own: "|".join(f"{rest}{GAP}(?:{'|'.join(seconds)})" for rest, seconds in own.items())
    letters = "|".join(f"{letter}(?:{rests(own)})" for letter, own in tree.items())
    return rf"(?<![\p{{L}}\p{{N}}])(?:{letters})(?![\p{{L}}\p{{N}}])"


def with_former(pairs: Column) -> Column:
    """array<struct<at, former, pair>>: each pair in order with the place of the same pair before it, else -1."""
    alike = F.array_sort(F.transform(pairs, lambda pair, i: F.struct(pair.alias("pair"), i.alias("at"))))

    def joined(sorted_pairs: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            before = F.get(sorted_pairs, j - 1)
            former = F.when(before["pair"] == x["pair"], before["at"]).otherwise(F.lit(-1))
            return F.struct(x["at"].alias("at"), former.alias("former"), x["pair"].alias("pair"))

        return F.array_sort(F.transform(sorted_pairs, one))

    return let(alike, joined)


def windows_of(placed: Column, name: str, own: list[str], least_dice: float, room: float) -> Column:
    """For each start the best window that reaches the coefficient with one template.

    The best windows start and end with a pair of the template. A pair counts
    once in a window: where its former place lies before the start. Starts
    without enough of the template's pairs within reach are passed over.
    """
    reach, needed = math.floor(len(own) * room), least_shared(len(own), least_dice)
    marked = F.transform(placed, lambda x: F.struct(x["former"].alias("former"), x["pair"].isin(*own).alias("hit")))

    def search(marked: Column) -> Column:
        def best_from(start: Column) -> Column:
            def grow(state: Column, x: Column) -> Column:
                new = x["former"] < start
                size = state["size"] + new.cast("int")
                shared = state["shared"] + (new & x["hit"]).cast("int")
                dice = 2.0 * shared / (size + len(own))
                better = x["hit"] & (dice > state["dice"])
                at = state["at"] + 1
                return F.struct(
                    size.alias("size"), shared.alias("shared"), F.when(better, dice).otherwise(state["dice"]).alias("dice"),
                    F.when(better, at).otherwise(state["end"]).alias("end"), at.alias("at"),
                )

            zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("shared"), F.lit(0.0).alias("dice"), start.alias("end"), (start - 1).alias("at"))
            return F.aggregate(
                F.slice(marked, start + 1, reach), zero, grow,
                lambda state: F.struct(start.alias("start"), state["end"].alias("end"), (-state["dice"]).alias("less"), F.lit(name).alias("name")),
            )

        places = F.filter(F.transform(marked, lambda x, i: F.when(x["hit"], i)), lambda at: at.isNotNull())
        starts = let(places, lambda hits: F.filter(hits, lambda at, j: F.get(hits, j + (needed - 1)) < at + reach))
        return F.filter(F.transform(starts, best_from), lambda window: -window["less"] >= least_dice)

    return let(marked, search)


def passages(windows: Column, words: Column) -> Column:
    """The distinct texts of the best windows (higher coefficient, then name, then place) of each run of overlapping ones."""
    best_of = lambda w: F.struct(w["less"].alias("less"), w["name"].alias("name"), w["start"].alias("start"), w["end"].alias("end"))
    kind = "struct<less:double,name:string,start:int,end:int>"

    def merge(state: Column, window: Column) -> Column:
        apart = window["start"] > state["upto"]
        return F.struct(
            F.greatest(state["upto"], window["end"]).alias("upto"),
            F.when(apart, best_of(window)).otherwise(F.least(state["best"], best_of(window))).alias("best"),
            F.when(apart, F.concat(state["done"], F.array(state["best"]))).otherwise(state["done"]).alias("done"),
        )

    zero = F.struct(F.lit(-1).alias("upto"), F.lit(None).cast(kind).alias("best"), F.array().cast(f"array<{kind}>").alias("done"))
    runs = F.aggregate(F.array_sort(windows), zero, merge, lambda state: F.array_compact(F.concat(state["done"], F.array(state["best"]))))
    return F.array_distinct(F.transform(runs, lambda w: F.array_join(F.slice(words, w["start"] + 1, w["end"] - w["start"] + 2), " ")))


def find(books: DataFrame, templates: dict[str, str] | None = None, least_dice: float = LEAST_DICE) -> DataFrame:
    """One row for each row of `books` (id, text; others ignored): the licence its text carries.

    Columns: id, n_notices, licence and dice of the best match (higher
    coefficient, then name in alphabetical order; NULL without a match) and
    licences (all matched names, in order). Notices are the lines and the
    paragraphs between blank lines that match a template, each different one
    once, and the passages anywhere in the text that match, each different one
    once, unless they lie in such a line or paragraph or hold one. NULL and
    empty texts and units of one word match nothing; repeated rows are each
    judged; no books give no rows. `templates` is a short table kept by hand. It
    becomes part of the plan, so that every text meets the templates within its
    own row, without a shuffle.
    """
    notices = list(templates.items()) if templates else [*TEMPLATES.items(), *((name, text) for name, texts in TEXTS.items() for text in texts)]
    given = books.sparkSession.createDataFrame(sorted(notices), "name string, notice string")
    pairs_of = given.select("name", word_pairs(normalised(F.col("notice"))).alias("pairs"))
    known = [(row["name"], row["pairs"]) for row in sorted(pairs_of.collect()) if row["pairs"]]
    # A coefficient of t needs |A| between t / (2 - t) and (2 - t) / t times |B|.
    room = (2 - least_dice) / least_dice + 1e-9
    fits = lambda pairs, n: F.size(pairs).between(F.lit(n / room), F.lit(n * room))
    sizes = [len(pairs) for _, pairs in known] or [1]

    def matches(pairs: Column) -> Column:
        each = []
        for name, own in known:
            shared = F.size(F.array_intersect(pairs, F.array(*[F.lit(pair) for pair in own])))
            dice = 2.0 * shared / (F.size(pairs) + len(own))
            each.append(F.when(fits(pairs, len(own)) & (dice >= least_dice), F.struct((-dice).alias("less"), F.lit(name).alias("name"))))
        return F.array_compact(F.array(*each))

    def notices_of(text: Column) -> Column:
        units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[\x20\x09-\x0D]*\n")))
        sets = F.transform(units, lambda unit: let(normalised(unit), lambda plain: F.struct(plain.alias("plain"), word_pairs(plain).alias("pairs"))))
        fitting = F.filter(sets, lambda unit: F.size(unit["pairs"]).between(F.lit(min(sizes) / room), F.lit(max(sizes) * room)))
        found = F.transform(fitting, lambda unit: F.struct(unit["plain"].alias("plain"), matches(unit["pairs"]).alias("found")))
        return F.filter(found, lambda unit: F.size(unit["found"]) > 0)

    def windows(plain: Column, words: Column) -> Column:
        def search(placed: Column) -> Column:
            none = F.array().cast(f"array<{WINDOW}>")
            each = [F.when(plain.rlike(one_of(any_needed(own, least_dice))), windows_of(placed, name, own, least_dice, room)).otherwise(none) for name, own in known]
            return F.flatten(F.array(*each))

        return let(with_former(neighbours_of(words)), search)

    def judged(text: Column) -> Column:
        def counted(units: Column, found: Column, words: Column) -> Column:
            padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
            nested = lambda one, other: F.contains(padded(one), padded(other)) | F.contains(padded(other), padded(one))
            others = F.filter(passages(found, words), lambda passage: ~F.exists(units, lambda unit: nested(unit["plain"], passage)))
            matched = F.concat(F.flatten(F.transform(units, lambda unit: unit["found"])), F.transform(found, lambda w: F.struct(w["less"].alias("less"), w["name"].alias("name"))))
            return F.struct((F.size(units) + F.size(others)).cast("long").alias("n"), F.array_distinct(matched).alias("matched"))

        by_plain = lambda plain: let(F.split(plain, " "), lambda words: let(windows(plain, words), lambda found: let(notices_of(text), lambda units: counted(units, found, words))))
        return let(normalised(text), by_plain)

    text = text_of()
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<less:double,name:string>>").alias("matched"))
    needed = {pair for _, own in known for pair in any_needed(own, least_dice)}
    found = F.when(F.lower(text).rlike(one_of(needed)), judged(text)).otherwise(nothing) if needed else nothing
    best = F.array_min(F.col("_m.matched"))
    return books.select("id", found.alias("_m")).select(
        "id",
        F.col("_m.n").alias("n_notices"),
        best["name"].alias("licence"),
        F.round(-best["less"], 6).alias("dice"),
        F.array_sort(F.array_distinct(F.col("_m.matched")["name"])).alias("licences"),
    )
