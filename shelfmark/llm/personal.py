"""Personal data in book texts, by weak supervision.

Patterns propose spans. Labelers vote on each of them: the rule that belongs to
the pattern, its shape, a gazetteer, the words before it and what touches it.
Expectation-maximisation estimates how far each labeler can be trusted, without
any labelled span, and its posteriors train a classifier of spans. Spans that
satisfy their rule always stay, those that fail it never do; the classifier
decides on what no rule covers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import keep, let, matches_of, text_of

KINDS = ("email", "ip", "card", "phone")

# Fixed values. Runs are possessive and start where a run starts or the last
# match ended, which leaves the matches as they are and a long run linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SMALL_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

DOMAINS = "com|org|net|edu|gov|info|biz|io|de|fr|es|it|nl|uk|eu|ru|pl|ch|at|be|us|ca|au|jp|cn|in|br"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|62|35)"
CALLING_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|client|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|carte|tarjeta|karte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\b",
}
COUNTER_CUES = r"(?i)\b(?:isbn|issn|doi|version|chapter|page|pages|volume|vol|order|invoice|serial|section)\b[^\n]{0,12}$"

LABELERS = ("rule", "shape", "gazetteer", "context", "edges")
ROUNDS = 8
# What a vote of 1, 0, -1 is worth at the start, for true and for false spans,
# each counted as so many spans. A rule (a check
# digit, a range) fails on a true span almost never.
FIRST = {True: {1: 0.6, 0: 0.35, -1: 0.05}, False: {1: 0.1, 0: 0.4, -1: 0.5}}
FIRST_RULE = {True: {1: 0.6995, 0: 0.3, -1: 0.0005}, False: {1: 0.02, 0: 0.18, -1: 0.8}}
FIRST_WEIGHT = 50.0
LEAST_PROBABILITY = 0.9
AROUND = 32


def _vote(good: Column, bad: Column | None = None) -> Column:
    other = F.lit(0) if bad is None else F.when(bad, -1).otherwise(0)
    return F.when(good, 1).otherwise(other)


def _either(first: Callable[[Column], Column], second: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: first(m) | second(m)


def _ranked(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(
        F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["base"].alias("base"),
        s["votes"].alias("votes"), F.transform(s["features"], lambda f: F.concat(F.lit(kind + " "), f)).alias("features"),
    )


def _proposals(text: Column, kind: str) -> Column:
    """Spans that a kind's patterns propose, each with `base` and its votes."""
    digits = lambda m: F.regexp_replace(m["value"], "[^0-9]", "")
    n = lambda m: F.length(digits(m))
    if kind == "email":
        top = rf"\.(?:{DOMAINS})$"
        parts = [(EMAIL, lambda m: F.lit(True), None), (SPELT_EMAIL, None, None)]
        shape = lambda m: _vote(m["value"].rlike(r"(?i)[.\])\x20][a-z]{2,}$"), m["value"].rlike(r"[0-9]$"))
        listed = lambda m: _vote(F.lower(F.regexp_replace(m["value"], r"\x20?[(\[]dot[)\]]\x20?", ".")).rlike(top))
    elif kind == "ip":
        parts = [(IP, lambda m: m["value"].rlike(rf"^{SMALL_PART}(?:\.{SMALL_PART}){{3}}$"), lambda m: F.lit(True))]
        shape = lambda m: _vote(~m["value"].rlike(r"(?:^|\.)0[0-9]"), F.length(m["value"]) > 15)
        listed = lambda m: _vote(~m["value"].rlike(r"^(?:0|127|255)\."), m["value"].rlike(r"^0\."))
    elif kind == "card":
        sized = lambda m: n(m).between(13, 19)
        parts = [(CARD, lambda m: sized(m) & F.when(sized(m), F.call_function("luhn_check", digits(m))).otherwise(False), sized)]
        shape = lambda m: _vote(m["value"].rlike(r"^(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{15})$"))
        listed = lambda m: _vote(digits(m).rlike(ISSUERS), ~digits(m).rlike(ISSUERS))
    else:
        parts = [(PHONE, lambda m: n(m).between(9, 15), lambda m: n(m).between(7, 17)), (LOCAL_PHONE, None, None)]
        shape = lambda m: _vote(m["value"].rlike(r"[\x20().-]"), m["value"].rlike(r"[\x20().-]{4}"))
        listed = lambda m: _vote(m["value"].rlike(CALLING_CODES) | m["value"].rlike(r"^\(?[2-9]"), m["value"].rlike(r"^\+0"))

    def one(rule):
        def described(m: Column) -> Column:
            base = F.lit(False) if rule is None else rule(m)
            touching = lambda side, at: F.regexp_extract(m[side], r"[\p{L}\p{N}]$" if at else r"^[\p{L}\p{N}]", 0) != ""
            return F.struct(
                m["start"].alias("start"), m["end"].alias("end"), base.alias("base"),
                F.array(
                    F.lit(0) if rule is None else _vote(base, ~base),
                    shape(m), listed(m),
                    _vote(m["before"].rlike(CUES[kind]), m["before"].rlike(COUNTER_CUES)),
                    _vote(F.lit(False), touching("before", True) | touching("after", False)),
                ).cast("array<int>").alias("votes"),
                F.array(
                    F.concat(F.lit("length"), F.floor(F.log2(m["end"] - m["start"])).cast("string")),
                    F.concat(F.lit("digits"), F.least(n(m), F.lit(20)).cast("string")),
                    F.concat(F.lit("first"), _kind_of(F.left(m["value"], F.lit(1)))),
                    F.concat(F.lit("last"), _kind_of(F.right(m["value"], F.lit(1)))),
                    F.concat(F.lit("before"), _kind_of(F.right(m["before"], F.lit(1)))),
                    F.concat(F.lit("after"), _kind_of(F.left(m["after"], F.lit(1)))),
                ).alias("features"),
            )

        return described

    found = []
    for pattern, rule, worth in parts:
        spans = matches_of(text, pattern, AROUND)
        if rule is not None and worth is not None:
            spans = F.filter(spans, _either(rule, worth))
        found.append(F.transform(spans, one(rule)))
    return F.concat(*found)


def _kind_of(character: Column) -> Column:
    return (
        F.when(character.rlike(r"\p{L}"), "letter").when(character.rlike(r"\p{N}"), "digit").when(character.rlike(r"\s"), "white").when(character == "", "edge")
        .otherwise("mark")
    )


def proposed_spans(text: Column) -> Column:
    """array<struct<rank, start, end, kind, base, votes, features>>; proposals that cross a base span are dropped."""

    def apart(spans: Column) -> Column:
        base = F.filter(spans, lambda s: s["base"])
        free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.when(F.size(base) == F.size(spans), spans).otherwise(F.filter(spans, lambda s: s["base"] | free(s)))

    each = [F.transform(_proposals(text, kind), _ranked(rank, kind)) for rank, kind in enumerate(KINDS)]
    return let(F.concat(*each), apart)


def _log_odds(table: dict, vote: Column) -> Column:
    odds = {v: math.log(table[True][v] / table[False][v]) for v in (1, 0, -1)}
    return F.when(vote == 1, odds[1]).when(vote == -1, odds[-1]).otherwise(odds[0])


def reliabilities(patterns: DataFrame) -> tuple[list[dict], dict[str, float]]:
    """How often each labeler gives each vote on true and on false spans, and the share of true spans by kind.

    `patterns` has kind, votes and n: each combination of votes once, so at most
    3^5 rows a kind, however many spans there are. A round is one sum over them.
    """
    tables = [{side: dict((FIRST_RULE if name == "rule" else FIRST)[side]) for side in (True, False)} for name in LABELERS]
    starts = [{side: dict(table[side]) for side in table} for table in tables]
    shares = dict.fromkeys(KINDS, 0.5)
    for _ in range(ROUNDS):
        p = probability(tables, shares)
        sums = []
        for i, name in enumerate(LABELERS):
            for vote in (1, 0, -1):
                given = F.when(F.col("votes")[i] == vote, F.col("n")).otherwise(0)
                sums += [F.sum(given * F.col("p")).alias(f"{name} {vote} True"), F.sum(given * (1 - F.col("p"))).alias(f"{name} {vote} False")]
        for kind in KINDS:
            sums += [F.sum(F.when(F.col("kind") == kind, F.col("n") * F.col("p"))).alias(f"{kind} true"), F.sum(F.when(F.col("kind") == kind, F.col("n"))).alias(kind)]
        row = patterns.withColumn("p", p).agg(*sums).first()
        value = lambda name: row[name] or 0.0
        for i, name in enumerate(LABELERS):
            for side in (True, False):
                counts = {v: value(f"{name} {v} {side}") + FIRST_WEIGHT * starts[i][side][v] for v in (1, 0, -1)}
                tables[i][side] = {v: count / sum(counts.values()) for v, count in counts.items()}
        shares = {kind: (value(f"{kind} true") + 1) / (value(kind) + 2) for kind in KINDS}
    return tables, shares


def probability(tables: list[dict], shares: dict[str, float]) -> Column:
    prior = F.lit(0.0)
    for kind, share in shares.items():
        prior = F.when(F.col("kind") == kind, math.log(share / (1 - share))).otherwise(prior)
    return 1 / (1 + F.exp(-sum((_log_odds(table, F.col("votes")[i]) for i, table in enumerate(tables)), prior)))


@dataclass
class Model:
    """How far labelers are trusted, the share of true spans by kind, and the weights of the classifier."""

    tables: list[dict]
    shares: dict[str, float]
    weights: dict[str, float]

    def spans(self, proposed: Column, least_probability: float) -> Column:
        """Of proposed spans those that stay, by kind, then start."""
        known = F.create_map(*[F.lit(x) for pair in (sorted(self.weights.items()) or [("", 0.0)]) for x in pair])
        weight = lambda feature: F.coalesce(F.try_element_at(known, feature), F.lit(0.0))

        def scored(s: Column) -> Column:
            votes = sum((_log_odds(table, s["votes"][i]) for i, table in enumerate(self.tables)), F.lit(0.0))
            # Features say much the same thing several times; their mean is one more voter.
            features = F.aggregate(s["features"], F.lit(0.0), lambda total, f: total + weight(f)) / F.size(s["features"])
            probability = 1 / (1 + F.exp(-(votes + features + weight(s["kind"]))))
            return F.struct(*[s[c].alias(c) for c in ("rank", "start", "end", "kind", "base")], probability.alias("probability"))

        # What failed its rule has shown the labelers false spans and is not added.
        open_to = F.filter(proposed, lambda s: s["base"] | (s["votes"][0] >= 0))
        stay = F.filter(F.transform(open_to, scored), lambda s: s["base"] | (s["probability"] >= least_probability))
        return F.transform(F.array_sort(stay), lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "base", "probability")]))


def learn(proposed: DataFrame) -> Model:
    """A model of all proposed spans (column spans), without any label."""
    each = proposed.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    patterns = keep(each.groupBy("kind", "votes").agg(F.count("*").alias("n")), "votes")
    tables, shares = reliabilities(patterns)
    # Features pair a kind with one of a few classes: their number is fixed.
    labelled = each.withColumn("p", probability(tables, shares)).select("p", F.explode(F.concat(F.array("kind"), "features")).alias("feature"))
    rows = labelled.groupBy("feature").agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("f")).collect()
    odds = {row["feature"]: math.log((row["t"] + 1) / (row["f"] + 1)) for row in rows}
    return Model(tables, shares, {name: value - (odds[name.split(" ")[0]] if " " in name else 0.0) for name, value in odds.items()})


def find(books: DataFrame, least_probability: float = LEAST_PROBABILITY) -> DataFrame:
    """One row for each row of `books` (id, text; others ignored): id and its spans of personal data.

    spans is array<struct<kind, start, end, base, probability>> in code points,
    end exclusive, by kind (email, ip, card, phone), then start. `base` spans
    satisfy their rule and stay whatever the classifier says; others are there
    if it gives them `least_probability`. NULL and empty texts have no spans;
    repeated rows are each searched; without any span there is nothing to learn
    and none is added; no books give no rows. Texts are searched whole, in their
    own row; only counts of votes and features are shuffled.
    """
    proposed = keep(books.select("id", proposed_spans(text_of()).alias("spans")), "proposals")
    return proposed.select("id", learn(proposed).spans(F.col("spans"), least_probability).alias("spans"))


def mask(books: DataFrame, least_probability: float = LEAST_PROBABILITY) -> DataFrame:
    """`books` with every span of personal data in `text` replaced by its kind in angle brackets.

    Spans that overlap are replaced together, by the kind of the first. Other
    columns, NULL texts and texts without spans stay as they are. Texts are not
    shuffled; they are written down beside their proposals, which are found once.
    """
    proposed = keep(books.withColumn("_proposed", proposed_spans(text_of())), "proposals")
    spans = learn(proposed.select(F.col("_proposed").alias("spans"))).spans(F.col("_proposed"), least_probability)

    def masked(found: Column) -> Column:
        by_start = F.array_sort(F.transform(found, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "kind")])))

        def add(state: Column, s: Column) -> Column:
            between = F.substr(F.col("text"), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
            new = F.concat(state["out"], between, F.lit("<"), s["kind"], F.lit(">"))
            return F.struct(F.greatest(s["end"], state["at"]).alias("at"), F.when(s["start"] >= state["at"], new).otherwise(state["out"]).alias("out"))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
        rest = lambda state: F.concat(state["out"], F.substr(F.col("text"), (state["at"] + 1).cast("int")))
        return F.when(F.size(found) == 0, F.col("text")).otherwise(F.aggregate(by_start, start, add, rest))

    return proposed.withColumn("text", let(spans, masked)).select(*books.columns)
