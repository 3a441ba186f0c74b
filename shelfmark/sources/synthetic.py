"""Seeded books for scale tests (S2): rows, documents, and archives of them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources import export

_FIRST = "Ada Boris Clara Denis Elena Felix Greta Hugo Irina Jonas Katya Leo Marta Nils Olga Pavel".split()
_LAST = "Adler Bauer Castle Dorn Ek Fisher Grau Holm Ivens Janko Keller Lund Moroz Nord Orlow Petri".split()
_ADJECTIVES = "Amber Bitter Cold Distant Early Faint Green Heavy Inner Long".split()
_NOUNS = "Anchor Bridge Candle Desert Engine Feather Glacier Harbor Island Journey".split()
_SERIES = ["Night Shelves", "Paper Worlds", "Quiet Rivers", "Salt Roads", "Winter Notes"]
# How many genres there are, and the years of publication.
GENRES = [f"genre_{i:02d}" for i in range(28)]
FIRST_YEAR, YEARS = 1950, 75


def _draw(seed: int, purpose: str, bound: int, *more: Column) -> Column:
    """A repeatable number below `bound` for a book and a purpose."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(purpose), *more), F.lit(bound)).cast("int")


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*(F.lit(value) for value in values)), index)


def synthetic_books(spark: SparkSession, archives: int, per_archive: int, seed: int = 42, lang: str = "en") -> DataFrame:
    """Book rows with `archive`; ids run through all archives from 1."""
    ids = spark.range(1, archives * per_archive + 1)
    number = F.floor((F.col("id") - 1) / per_archive).cast("int")
    positions = F.sequence(F.lit(0), _draw(seed, "authors", 3))
    authors = F.transform(
        positions,
        lambda i: F.struct(
            _pick(_FIRST, _draw(seed, "first", len(_FIRST), i)).alias("first_name"),
            _pick(_LAST, _draw(seed, "last", len(_LAST), i)).alias("last_name"),
        ),
    )
    title = F.concat_ws(
        " ",
        F.lit("The"),
        _pick(_ADJECTIVES, _draw(seed, "adjective", len(_ADJECTIVES))),
        _pick(_NOUNS, _draw(seed, "noun", len(_NOUNS))),
    )
    series = F.when(
        _draw(seed, "in series", 3) != 0,
        F.struct(
            _pick(_SERIES, _draw(seed, "series", len(_SERIES))).alias("name"),
            (_draw(seed, "number", 19) + 1).alias("number"),
        ),
    )
    return ids.select(
        "id",
        title.alias("title"),
        _pick(GENRES, _draw(seed, "genre", len(GENRES))).alias("genre"),
        (_draw(seed, "year", YEARS) + FIRST_YEAR).cast("string").alias("date"),
        F.lit(lang).alias("lang"),
        series.alias("series"),
        authors.alias("authors"),
        F.format_string("made-%05d.zip", number).alias("archive"),
        number.alias("number"),
    )


def synthetic_documents(books: DataFrame, paragraphs: int = 5) -> DataFrame:
    """(id, archive, number, text): the books as marked-up documents."""

    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    people = F.transform(
        "authors",
        lambda a: tag("author", F.concat(tag("first-name", a["first_name"]), tag("last-name", a["last_name"]))),
    )
    series = F.concat(
        F.lit('<sequence name="'), F.col("series.name"), F.lit('" number="'), F.col("series.number").cast("string"), F.lit('"/>')
    )
    info = F.concat(
        tag("genre", F.col("genre")),
        F.array_join(people, ""),
        tag("book-title", F.col("title")),
        tag("date", F.col("date")),
        F.coalesce(series, F.lit("")),
        tag("lang", F.col("lang")),
    )
    body = F.array_join(F.transform(F.array_repeat("title", paragraphs), lambda t: tag("p", t)), "\n")
    text = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<FictionBook>\n'),
        tag("description", tag("title-info", info)),
        tag("body", tag("section", body)),
        F.lit("\n</FictionBook>"),
    )
    return books.select("id", "archive", "number", text.alias("text"))


def write_synthetic_archives(
    spark: SparkSession, out_dir: str, archives: int, per_archive: int, seed: int = 42, lang: str = "en"
) -> DataFrame:
    """Write the archives in parallel, one task per group of archives; returns what they hold."""
    docs = synthetic_documents(synthetic_books(spark, archives, per_archive, seed, lang))
    entries = docs.select(
        "archive",
        "id",
        F.concat(F.col("id").cast("string"), F.lit(".fb2")).alias("file_name"),
        F.encode("text", "UTF-8").alias("data"),
    )
    grouped = entries.repartition(archives, "archive").sortWithinPartitions("archive", "id")
    return export.write_archives(grouped, out_dir, f"{out_dir}/_manifest-{uuid.uuid4().hex}")
