"""Scalar derivations of catalog fields, all as built-in column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.schema import AUTHOR_FIELDS, DESCRIPTION, MAX_BOOK_ID

_NO_TEXTS = "array<string>"

# The metadata a document without a <description> gets.
UNKNOWN_DESCRIPTION = (
    "<description><title-info><book-title>Unknown</book-title></title-info></description>"
)


def trim_space(text: Column) -> Column:
    """Trim every Unicode white space character; SQL `trim` strips blanks only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def book_id(entry_name: Column) -> Column:
    """`123.fb2` -> 123; NULL for other names and for numbers past 32 bits."""
    number = F.regexp_extract(entry_name, r"^([0-9]+)\.fb2\z", 1).try_cast("bigint")
    return F.when(number <= MAX_BOOK_ID, number)


# --- metadata slice and parse ------------------------------------------------


def description_slice(text: Column) -> Column:
    """The first <description> block of a document, or the stand-in one."""
    block = F.regexp_extract(text, r"(?s)<description[^>]*>.*?</description>", 0)
    return F.when(block == "", F.lit(UNKNOWN_DESCRIPTION)).otherwise(block)


def parse_description(block: Column) -> Column:
    """XML text -> `schema.DESCRIPTION` struct; malformed XML fills `_corrupt_record`."""
    return F.from_xml(block, DESCRIPTION)


def reject_reason(description: Column) -> Column:
    """Why a parsed description cannot become a book, NULL if it can."""
    infos = description["title-info"]
    titled = F.exists(infos, lambda info: F.size(info["book-title"]) > 0)
    return (
        F.when(description["_corrupt_record"].isNotNull(), F.lit("malformed metadata"))
        .when(infos.isNull() | (F.size(infos) == 0), F.lit("no title-info"))
        .when(~F.coalesce(titled, F.lit(False)), F.lit("no title-info has a book-title"))
    )


def title_info(description: Column) -> Column:
    """Only the first title-info counts."""
    return F.get(description["title-info"], F.lit(0))


def _last(texts: Column) -> Column:
    return F.try_element_at(texts, F.lit(-1))


def title(titles: Column) -> Column:
    return F.coalesce(F.concat_ws(" ", titles), F.lit(""))


def date(title_dates: Column, publish_years: Column, document_dates: Column) -> Column:
    """First non-empty of: last title date, last publish year, last document date."""
    choices = [F.nullif(_last(texts), F.lit("")) for texts in (title_dates, publish_years, document_dates)]
    return F.coalesce(*choices, F.lit(""))


def lang(langs: Column) -> Column:
    return F.coalesce(F.get(langs, F.lit(0)), F.lit(""))


def genres(values: Column) -> Column:
    """Distinct, in order of first appearance."""
    return F.array_distinct(F.coalesce(values, F.array().cast(_NO_TEXTS)))


def sequence_text(block: Column) -> Column:
    """Series of the first title-info of a metadata block, nested to any depth,
    parents before children: `Parent 1, Child 2`.

    Opening tags in the order of the text are that order already, so nothing
    recursive is needed. Tags of the plain form are cut by a pattern; only those
    with entities, other attributes or blanks at the edges are parsed as XML.
    """
    hidden = F.regexp_replace(block, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")
    bare = F.when(block.contains("<!"), hidden).otherwise(block)
    info = F.regexp_extract(bare, r"(?s)<title-info(?:\s[^>]*?)?(?:/>|>(.*?)</title-info>)", 1)
    tags = F.regexp_extract_all(info, F.lit(r"""<sequence(?=[\s/>])((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""), 1)

    edge = r"""[^"&<\x00-\x20]"""
    value = rf"""{edge}(?:[^"&<\x00-\x1F]*{edge})?"""
    plain = rf"""\A\s+name="({value})"(?:\s+number="({value})")?[\s/]*\z"""

    def label(attributes: Column) -> Column:
        tag = F.concat(F.lit("<sequence"), F.regexp_replace(attributes, r"[\s/]+\z", ""), F.lit("/>"))
        given = F.from_xml(tag, "_name string, _number string")
        name, number = F.coalesce(given["_name"], F.lit("")), given["_number"]
        parsed = F.when(number.isNull(), name).otherwise(F.concat(name, F.lit(" "), number))
        cut = F.rtrim(F.regexp_replace(attributes, plain, "$1 $2"))
        return F.when(attributes.rlike(plain), cut).otherwise(parsed)

    return F.array_join(F.transform(tags, label), ", ")


# --- authors -----------------------------------------------------------------


def _names(texts: Column) -> Column:
    trimmed = F.transform(F.coalesce(texts, F.array().cast(_NO_TEXTS)), trim_space)
    return F.filter(trimmed, lambda name: F.coalesce(name != "", F.lit(False)))


def author_rows(authors: Column) -> Column:
    """XML authors -> array of structs (id, four name parts).

    The four name lists are paired by position up to the longest one; an
    author without any name stays, as an anonymous one.
    """

    def expand(author: Column) -> Column:
        zipped = F.arrays_zip(
            _names(author["first-name"]),
            _names(author["middle-name"]),
            _names(author["last-name"]),
            _names(author["nickname"]),
        )
        row = lambda names: F.struct(
            author["id"].alias("id"),
            *(names[str(i)].alias(field) for i, field in enumerate(AUTHOR_FIELDS)),
        )
        anonymous = F.struct(
            author["id"].alias("id"),
            *(F.lit(None).cast("string").alias(field) for field in AUTHOR_FIELDS),
        )
        people = F.transform(zipped, row)
        return F.when(F.size(people) == 0, F.array(anonymous)).otherwise(people)

    empty = F.array().cast(
        "array<struct<id:string," + ",".join(f"{field}:string" for field in AUTHOR_FIELDS) + ">>"
    )
    return F.coalesce(F.flatten(F.transform(authors, expand)), empty)


def author_id(given: Column, book: Column, pos: Column, names: Sequence[Column]) -> Column:
    """The given id, else a digest of book, position and names (repeatable)."""
    parts = [F.coalesce(name, F.lit("")) for name in names]
    digest = F.sha2(F.concat_ws("|", book.cast("string"), pos.cast("string"), *parts), 256)
    return F.coalesce(F.nullif(given, F.lit("")), digest)


def author_display(*names: Column) -> Column:
    """Non-empty name parts joined by a blank, `Anonymous` when there are none."""
    joined = F.concat_ws(" ", *(F.nullif(name, F.lit("")) for name in names))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("Anonymous"))


def author_label(first: Column, middle: Column, last: Column, nick: Column) -> Column:
    """One author inside `authors_text`: `first middle last  (nick)`."""
    padded = [F.coalesce(F.concat(part, F.lit(" ")), F.lit("")) for part in (first, middle, last)]
    return F.concat(*padded, F.coalesce(F.concat(F.lit(" ("), nick, F.lit(")")), F.lit("")))


def authors_text(authors: Column) -> Column:
    """Labels of an ordered author array joined by `,`; NULL without authors."""
    labels = F.transform(authors, lambda a: author_label(*(a[field] for field in AUTHOR_FIELDS)))
    return F.when(F.size(authors) > 0, F.array_join(labels, ","))


def genres_text(values: Column) -> Column:
    return F.array_join(values, ", ")


def genres_from_json(text: Column) -> Column:
    """JSON array text -> list; text that is no JSON array gives NULL."""
    return F.from_json(text, "array<string>")


def file_size(content: Column) -> Column:
    return F.octet_length(content).cast("bigint")


def human_size(size: Column) -> Column:
    """Binary units, one decimal: `1.5 MB`, `2.0 KB`, `17 B`."""
    kb, mb = 1024, 1024 * 1024
    return (
        F.when(size >= mb, F.format_string("%.1f MB", size / mb))
        .when(size >= kb, F.format_string("%.1f KB", size / kb))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


# --- the whole row -----------------------------------------------------------


def book_columns(description: Column, block: Column) -> dict[str, Column]:
    """Catalog columns of a description, parsed and as text (id, size and archive excepted)."""
    info = title_info(description)
    return {
        "title": title(info["book-title"]),
        "genres": genres(info["genre"]),
        "date": date(
            info["date"],
            F.get(description["publish-info"], F.lit(0))["year"],
            F.get(description["document-info"], F.lit(0))["date"],
        ),
        "lang": lang(info["lang"]),
        "sequence": sequence_text(block),
        "authors": author_rows(info["author"]),
    }
