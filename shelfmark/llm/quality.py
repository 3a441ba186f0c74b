"""Quality rules whose thresholds follow the books themselves.

Each book gets plain measures of its text. Per language and archive the
measures' distributions are kept as mergeable quantile sketches (counts of
logarithmic buckets, so a quantile is known to a fixed relative error), and
thresholds are read from the sketches instead of being fixed. Books are then
joined with the thresholds of their language and archive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import WHITE, keep, let, text_of, words_of

SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 10
REPEAT_PERCENT = 20
REPEAT_WINDOW = 5

# Relative width of a sketch bucket: a quantile is off by half of it at most.
WIDTH = 1.02
# Measure -> the distance from the median, as a share of it, that is always
# tolerated. A tight archive must not lose books that differ a little.
MEASURES = {"word_length": 0.25, "symbol_share": 1.0, "line_repeats": 1.0, "word_repeats": 1.0}
# Shares up to these are no fault in any archive.
TOLERATED = {"symbol_share": 0.02, "line_repeats": 0.3, "word_repeats": 0.2}
# A value is an outlier beyond this many spreads (upper or lower quartile to median).
SPREADS = 6.0
# A language and archive with fewer books takes the language's sketch; that too small, that of all.
LEAST_BOOKS = 50


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words inside windows of `window` words that the text has twice or more, first included.

    Windows are compared by 64-bit digests; each word counts once.
    """

    def covered(digests: Column) -> Column:
        def of_pairs(pairs: Column) -> Column:
            same = lambda i, step: F.coalesce(F.get(pairs, i)["digest"] == F.get(pairs, i + step)["digest"], F.lit(False))
            twice = F.filter(pairs, lambda pair, i: same(i, -1) | same(i, 1))
            places = F.array_sort(F.transform(twice, lambda pair: pair["place"]))

            def add(state: Column, place: Column) -> Column:
                gained = F.least(F.lit(window), place - state["last"])
                return F.struct((state["total"] + gained).alias("total"), place.alias("last"))

            start = F.struct(F.lit(0).alias("total"), F.lit(-window).alias("last"))
            return F.aggregate(places, start, add, lambda state: state["total"].cast("long"))

        pairs = F.array_sort(F.transform(digests, lambda digest, i: F.struct(digest.alias("digest"), i.alias("place"))))
        return F.when(F.size(F.array_distinct(digests)) == F.size(digests), F.lit(0).cast("long")).otherwise(let(pairs, of_pairs))

    digests = F.transform(
        F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)])
    )
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(digests, covered))


def measured(books: DataFrame) -> DataFrame:
    """id, lang, archive and the counts of each book's text."""
    text = text_of()
    per_word = let(
        words_of(text),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        ),
    )
    per_line = let(
        F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(WHITE))) > 0),
        lambda lines: F.struct(
            F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")
        ),
    )
    counted = books.select(
        "id", "lang", "archive", per_word.alias("_w"), per_line.alias("_l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols")
    )
    return counted.select(
        "id", "lang", "archive", "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words"
    )


def _measures(name: str) -> Column:
    parts = {
        "word_length": ("word_chars", "n_words"),
        "symbol_share": ("n_symbols", "word_chars"),
        "line_repeats": ("n_dup_lines", "n_lines"),
        "word_repeats": ("n_repeat_words", "n_words"),
    }
    top, bottom = parts[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))


def sketches(counted: DataFrame) -> DataFrame:
    """lang, archive, measure, bucket, books: counts of equal rows are added before they are shuffled."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), _measures(name).alias("value")) for name in MEASURES])).alias("_m")
    bucket = F.when(F.col("_m.value") > 0, F.ceil(F.log(F.col("_m.value")) / F.lit(math.log(WIDTH))).cast("int"))
    rows = counted.select("lang", "archive", each).filter(F.col("_m.value").isNotNull())
    return rows.groupBy("lang", "archive", F.col("_m.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("books"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of the merged sketches of each `keys` and measure, and the number of books in them."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("books").alias("books"))
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("books").over(group.orderBy(F.col("bucket").asc_nulls_first()))
    placed = merged.select(*keys, "measure", "bucket", upto.alias("_upto"), F.sum("books").over(group).alias("_all"))
    # The middle of a bucket in relative terms; the NULL bucket holds zeros.
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(2 * F.pow(F.lit(WIDTH), F.col("bucket").cast("double")) / (1 + WIDTH))
    at = lambda share, name: F.min(F.when(F.col("_upto") >= share * F.col("_all"), value)).alias(name)
    return placed.groupBy(*keys, "measure").agg(F.max("_all").alias("books"), at(0.25, "low"), at(0.5, "mid"), at(0.75, "high"))


def thresholds(counted: DataFrame) -> DataFrame:
    """lang, archive and for each measure its least and greatest accepted value.

    Sketches of few books are replaced by the merged ones of the language, or of
    all books, so that every language and archive has thresholds.
    """
    sketch = keep(sketches(counted), "sketches")
    own = quantiles(sketch, ["lang", "archive"])
    names = ["books", "low", "mid", "high"]
    lang = quantiles(sketch, ["lang"]).select(F.col("lang").alias("_lang"), F.col("measure").alias("_measure"), F.struct(*names).alias("_by_lang"))
    whole = quantiles(sketch, []).select(F.col("measure").alias("_of"), F.struct(*names).alias("_whole"))
    by_lang = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_measure")))
    every = by_lang.join(whole, F.col("measure") == F.col("_of"))
    chosen = (
        F.when(F.col("books") >= LEAST_BOOKS, F.struct(*names))
        .when(F.col("_by_lang.books") >= LEAST_BOOKS, F.col("_by_lang"))
        .otherwise(F.col("_whole"))
    )
    picked = every.select("lang", "archive", "measure", chosen.alias("_q"))
    listed = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    least_room = F.try_element_at(listed(MEASURES), F.col("measure")) * F.col("_q.mid")
    tolerated = F.coalesce(F.try_element_at(listed(TOLERATED), F.col("measure")), F.lit(0.0))
    above = F.greatest(F.lit(SPREADS) * (F.col("_q.high") - F.col("_q.mid")), least_room)
    below = F.greatest(F.lit(SPREADS) * (F.col("_q.mid") - F.col("_q.low")), least_room)
    limits = picked.select(
        "lang", "archive", "measure", (F.col("_q.mid") - below).alias("least"), F.greatest(F.col("_q.mid") + above, tolerated).alias("most")
    )
    pick = lambda name, side: F.max(F.when(F.col("measure") == name, F.col(side))).alias(f"{side}_{name}")
    sides = [pick(name, side) for name in MEASURES for side in (("least", "most") if name == "word_length" else ("most",))]
    return limits.groupBy("lang", "archive").agg(*sides)


def judge(books: DataFrame) -> DataFrame:
    """One row for each row of `books` (id, text, lang, archive; others ignored) with counts and verdicts.

    Columns: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, failed (names of the measures beyond their adaptive thresholds)
    and kept. A NULL or empty text has zero counts and fails the base rule; NULL
    languages and archives form groups of their own. Repeated rows are judged
    each; a value equal to a threshold is accepted. No books give no rows. Texts
    are measured whole, once; what is shuffled are counts.
    """
    counted = keep(measured(books), "measured")
    limits = thresholds(counted).withColumnsRenamed({"lang": "_lang", "archive": "_archive"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("archive").eqNullSafe(F.col("_archive"))
    joined = counted.join(limits, same, "left")
    beyond = lambda name: F.coalesce(_measures(name) > F.col(f"most_{name}"), F.lit(False))
    short = F.coalesce(_measures("word_length") < F.col("least_word_length"), F.lit(False))
    faults = [F.when((beyond(name) | short) if name == "word_length" else beyond(name), F.lit(name)) for name in MEASURES]
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    named = joined.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), F.array_compact(F.array(*faults)).alias("failed"),
    )
    return named.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
