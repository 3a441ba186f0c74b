"""Tokens of a search text, and the Russian stemmer as regex expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[^\p{L}\p{N}]+"


def _accent_table() -> tuple[str, str]:
    """Accented Latin and Cyrillic letters and their base letters, by Unicode rule."""
    accented, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x400, 0x500), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code):
            accented.append(chr(code))
            plain.append(base)
    return "".join(accented), "".join(plain)


def fold_accents(text: Column) -> Column:
    return F.translate(text, *_accent_table())


def _single_capitals() -> dict[str, str]:
    """Characters whose full capitals are several, and the single capital of each, itself if it has none."""
    long = [chr(code) for code in range(0x80, 0x10000) if len(chr(code).upper()) > 1]
    return {c: c.title() if len(c.title()) == 1 else c for c in long} | {"ß": "ẞ"}


def upper(text: Column) -> Column:
    """Capitals by the simple mapping: each character gives one, as ß gives ẞ and not SS."""
    single = _single_capitals()
    pairs = ("".join(single), "".join(single.values()))
    each = F.transform(F.split(text, ""), lambda c: F.when(F.translate(c, pairs[0], "") == "", F.translate(c, *pairs)).otherwise(F.upper(c)))
    return F.when(F.length(F.translate(text, pairs[0], "")) < F.length(text), F.array_join(each, "")).otherwise(F.upper(text))


def tokens(text: Column, fold: bool = False, stop_words: Iterable[str] = ()) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats kept."""
    lowered = F.lower(text)
    if fold:
        lowered = fold_accents(lowered)
    words = F.array_remove(F.split(lowered, SEPARATORS), "")
    dropped = list(stop_words)
    return F.filter(words, lambda t: ~t.isin(dropped)) if dropped else words


# --- Russian Snowball stemmer -------------------------------------------------
# The suffix classes of the published algorithm. Suffixes of the
# first group of a class count only after а or я.

_AFTER_A = "(?<=[ая])"
_VOWELS = "аеиоуыэюя"

_PERFECTIVE = (
    _AFTER_A + "(?:вшись|вши|в)|ившись|ывшись|ивши|ывши|ив|ыв"
)
_REFLEXIVE = "ся|сь"
_ADJECTIVE = (
    "ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею"
)
_PARTICIPLE = _AFTER_A + "(?:ем|нн|вш|ющ|щ)|ивш|ывш|ующ"
_VERB = (
    _AFTER_A + "(?:ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно)"
    "|ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю"
)
_NOUN = (
    "а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я"
)
_DERIVATIONAL = "ость|ост"
_SUPERLATIVE = "ейше|ейш"


def _ending(suffixes: str) -> str:
    return f"(?:{suffixes})\\z"


def stem_russian(frame: DataFrame, column: str) -> DataFrame:
    """Replace `column` by its Russian stem; words without Cyrillic stay as they are.

    Works on the part after the first vowel (`RV`); every step is a projection
    of its own so that no step's expression is evaluated twice. RV is NULL for
    words the rules do not concern, which spares them every pattern.
    """
    word, start, rest = F.col(column), f"_{column}_head", f"_{column}_rv"
    out = frame.withColumn(column, F.replace(word, F.lit("ё"), F.lit("е")))
    head = F.regexp_extract(column, f"^[^{_VOWELS}]*[{_VOWELS}]", 0)
    out = out.withColumn(start, F.when(word.rlike("[а-я]"), F.nullif(head, F.lit(""))))
    out = out.withColumn(
        rest, F.when(F.col(start).isNotNull(), F.substring(word, F.length(start) + 1, F.length(word)))
    )

    rv = F.col(rest)
    cut = lambda text, suffixes: F.regexp_replace(text, _ending(suffixes), "")
    ends = lambda text, suffixes: text.rlike(_ending(suffixes))

    def step(frame: DataFrame, value: Column) -> DataFrame:
        return frame.withColumn(rest, F.when(rv.isNotNull(), value))

    # Step 1: a perfective gerund, or (after any reflexive) the first of
    # adjectival, verb and noun endings that is there.
    plain = cut(rv, _REFLEXIVE)
    stepped = (
        F.when(ends(rv, _PERFECTIVE), cut(rv, _PERFECTIVE))
        .when(ends(plain, _ADJECTIVE), cut(cut(plain, _ADJECTIVE), _PARTICIPLE))
        .when(ends(plain, _VERB), cut(plain, _VERB))
        .when(ends(plain, _NOUN), cut(plain, _NOUN))
        .otherwise(plain)
    )
    out = step(out, stepped)
    # Step 2: a final и.
    out = step(out, F.regexp_replace(rv, r"и\z", ""))
    # Step 3: a derivational ending inside R2. R2 is what is left of the word
    # after two vowel + consonant passages; look for them from the word's start.
    whole = F.concat(F.col(start), rv)
    passage = f"[^{_VOWELS}]*[{_VOWELS}]+[^{_VOWELS}]"
    in_r2 = whole.rlike(f"^{passage}{passage}.*(?:{_DERIVATIONAL})\\z")
    out = step(out, F.when(in_r2, cut(rv, _DERIVATIONAL)).otherwise(rv))
    # Step 4: нн -> н, a superlative ending (then нн -> н), or a final ь.
    undouble = lambda text: F.regexp_replace(text, r"нн\z", "н")
    finished = (
        F.when(ends(rv, "нн"), undouble(rv))
        .when(ends(rv, _SUPERLATIVE), undouble(cut(rv, _SUPERLATIVE)))
        .otherwise(F.regexp_replace(rv, r"ь\z", ""))
    )
    out = step(out, finished)
    # Handed on through a generator: a filter on the stem must not be pushed
    # down, which would write all steps into one expression many times over.
    stem = F.array(F.coalesce(F.concat(start, rest), word))
    others = [name for name in frame.columns if name != column]
    return out.select(*others, F.explode_outer(stem).alias(column))


def term_counts(terms: Column) -> Column:
    """array<struct<term, tf>> of an array of terms: lengths of the runs of equal terms once it is sorted.

    Each step is linear and the sorted array is made once, so it is counted
    within the row, without a shuffle.
    """

    def counted(ordered: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ordered) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        ended = lambda all_: F.transform(
            all_, lambda at, k: F.struct(F.get(ordered, at).alias("term"), (F.coalesce(F.get(all_, k + 1), F.size(ordered)) - at).cast("bigint").alias("tf"))
        )
        return F.transform(F.array(starts), ended)[0]

    runs = F.transform(F.array(F.sort_array(terms)), counted)[0]
    return F.when(F.size(terms) > 0, runs).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))
