"""Constraint checks that a catalog of files cannot enforce while writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.merge import union_all
from shelfmark.schema import MAX_BOOK_ID, STATUS_INDEXED, STATUS_INDEXING


def check_catalog(archives: DataFrame, books: DataFrame, authors: DataFrame, links: DataFrame) -> DataFrame:
    """(check, violations): keys, references and allowed values, all zero when sound."""

    def duplicates(name: str, rows: DataFrame, *key: str) -> DataFrame:
        repeated = rows.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        return repeated.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")

    def count(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")

    link_books = links.select(F.col("book_id").alias("id"))
    link_authors = links.select(F.col("author_id").alias("id"))
    return union_all(
        [
            duplicates("archive name repeated", archives, "name"),
            duplicates("book id repeated", books, "id"),
            duplicates("author id repeated", authors, "id"),
            duplicates("link repeated", links, "book_id", "author_id"),
            count("link without book", link_books.join(books, "id", "left_anti")),
            count("link without author", link_authors.join(authors, "id", "left_anti")),
            count(
                "book without archive",
                books.select(F.col("archive").alias("name")).join(archives, "name", "left_anti"),
            ),
            count("unknown status", archives.filter(~F.col("status").isin(STATUS_INDEXED, STATUS_INDEXING))),
            count("book id out of range", books.filter(~F.col("id").between(0, MAX_BOOK_ID))),
        ]
    )
