"""Set-based catalog maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.fields import author_id
from shelfmark.schema import AUTHOR_FIELDS, STATUS_INDEXED, STATUS_INDEXING


def without(rows: DataFrame, gone: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.join(gone, key, "left_anti")


def replace_archives(existing: DataFrame, fresh: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """K1: `fresh` rows take the place of all rows of their archives.

    `replaced` names the archives when some of them have no fresh rows.
    """
    gone = fresh.select("archive").distinct() if replaced is None else replaced
    return without(existing, gone, "archive").unionByName(fresh)


def delete_links(links: DataFrame, books: DataFrame, archives: DataFrame) -> DataFrame:
    """K2: links that stay when the books of `archives` (archive) go."""
    gone = books.join(archives, "archive", "left_semi").select(F.col("id").alias("book_id"))
    return without(links, gone, "book_id")


def delete_books(books: DataFrame, archives: DataFrame) -> DataFrame:
    """K3: books that stay when `archives` (archive) go."""
    return without(books, archives, "archive")


def live_authors(authors: DataFrame, links: DataFrame) -> DataFrame:
    """K4, kept side: authors that still have a link.

    Ids are made distinct before the join: that is combined per task, so an
    author with a large share of the links does not fill one task.
    """
    return authors.join(_linked_ids(links), "id", "left_semi")


def orphan_authors(authors: DataFrame, links: DataFrame) -> DataFrame:
    """K4, purged side: authors without any link."""
    return authors.join(_linked_ids(links), "id", "left_anti")


def _linked_ids(links: DataFrame) -> DataFrame:
    return links.select(F.col("author_id").alias("id")).distinct()


def upsert_status(archives: DataFrame, names: DataFrame, status: str) -> DataFrame:
    """K5, K9: every row of `names` (name) gets `status`; unknown names join in."""
    marked = names.select("name", F.lit(True).alias("_marked"))
    merged = archives.join(marked, "name", "full_outer")
    changed = F.when(F.col("_marked"), F.lit(status)).otherwise(F.col("status"))
    return merged.withColumn("status", changed).drop("_marked")


def first_per_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the least by `order`; combined before the shuffle."""
    rest = [name for name in rows.columns if name != key]
    kept = F.min_by(F.struct(*rest), order).alias("_row")
    return rows.groupBy(key).agg(kept).select(key, "_row.*").select(*rows.columns)


def insert_or_ignore(existing: DataFrame, fresh: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """K6: add the fresh rows whose key is unknown, the first one per key."""
    rest = [F.col(name) for name in fresh.columns if name != key]
    once = first_per_key(fresh, key, F.struct(*rest) if order is None else order)
    return existing.unionByName(without(once, existing.select(key), key))


def insert_or_replace(existing: DataFrame, fresh: DataFrame, key: str | list[str]) -> DataFrame:
    """K7: fresh rows win over existing ones of the same key."""
    keys = [key] if isinstance(key, str) else key
    return without(existing, fresh.select(*keys), key).unionByName(fresh)


def flatten_books(nested: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K8: nested books (with `authors` and `archive`) -> books, authors, links."""
    books = nested.drop("authors")
    exploded = nested.select("archive", F.col("id").alias("book_id"), F.posexplode("authors").alias("pos", "a"))
    people = exploded.select(
        author_id(
            F.col("a.id"), F.col("book_id"), F.col("pos"), [F.col(f"a.{name}") for name in AUTHOR_FIELDS]
        ).alias("id"),
        *(F.col(f"a.{name}").alias(name) for name in AUTHOR_FIELDS),
        "book_id",
        "pos",
        "archive",
    )
    # One id may stand for several names of a book: the first position links.
    links = people.groupBy("book_id", F.col("id").alias("author_id"), "archive").agg(F.min("pos").alias("pos"))
    authors = first_per_key(
        people.select("id", *AUTHOR_FIELDS, "book_id", "pos"), "id", F.struct("book_id", "pos")
    ).drop("book_id", "pos")
    return books, authors, links.select("book_id", "author_id", "pos", "archive")


# --- which archives to skip ----------------------------------------------------


def indexed_names(archives: DataFrame) -> DataFrame:
    """Skipped by the incremental mode; interrupted archives are not."""
    return archives.filter(F.col("status") == STATUS_INDEXED).select("name")


def pending_names(archives: DataFrame) -> DataFrame:
    return archives.filter(F.col("status") == STATUS_INDEXING).select("name")


def unpicked_names(archives: DataFrame, picked: DataFrame) -> DataFrame:
    """Known archives that were not picked (unknown ones are not skipped)."""
    return without(archives.select("name"), picked.select("name"), "name")


def archives_to_read(on_disk: DataFrame, skipped: DataFrame | None, only: DataFrame | None = None) -> DataFrame:
    """S1 minus an ignore set; `only` restricts to the picked names."""
    out = on_disk if skipped is None else without(on_disk, skipped.select("name"), "name")
    return out if only is None else out.join(only.select("name"), "name", "left_semi")


# --- selections ------------------------------------------------------------------


def add_to_selection(selection: DataFrame, added: DataFrame, key: str = "id") -> DataFrame:
    """The selection keeps its rows; new ids join in once."""
    columns = selection.columns
    once = added.select(*columns).dropDuplicates([key])
    return selection.unionByName(without(once, selection.select(key), key))


def remove_from_selection(selection: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return without(selection, gone.select(key), key)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
