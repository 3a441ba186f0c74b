"""Counts, facets and library health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.schema import STATUS_INDEXED, STATUS_INDEXING, STATUS_NEW

NOT_SPECIFIED = "Not specified"


def total(books: DataFrame) -> DataFrame:
    return books.agg(F.count("*").alias("total"))


def facet(books: DataFrame, column: str = "lang", unspecified: bool = False) -> DataFrame:
    """(value, count) of the non-empty values, most frequent first.

    With `unspecified`, one leading row counts the books without a value. It
    comes from the same pass: the values are grouped once, empty ones together.
    """
    value = F.coalesce(F.col(column), F.lit(""))
    counts = books.groupBy(value.alias(column)).agg(F.count("*").alias("count"))
    empty = F.col(column) == ""
    if not unspecified:
        return counts.filter(~empty).orderBy(F.desc("count"), column)
    return (
        counts.select(
            F.when(empty, F.lit(NOT_SPECIFIED)).otherwise(F.col(column)).alias(column),
            "count",
            empty.alias("_first"),
        )
        .orderBy(F.desc("_first"), F.desc("count"), column)
        .drop("_first")
    )


def archives_per_status(archives: DataFrame) -> DataFrame:
    return archives.groupBy("status").agg(F.count("*").alias("count"))


def index_validity(books: DataFrame, search_docs: DataFrame | None) -> DataFrame:
    """One row: the index is valid when it holds as many rows as there are books."""
    counted = books.agg(F.count("*").alias("total_books"))
    if search_docs is None:
        return counted.select("total_books", (F.col("total_books") == 0).alias("search_index_valid"))
    indexed = search_docs.agg(F.count("*").alias("n")).scalar()
    valid = (F.col("total_books") == 0) | (F.col("total_books") == indexed)
    return counted.select("total_books", valid.alias("search_index_valid"))


def health(
    archives: DataFrame, books: DataFrame, search_docs: DataFrame | None, new_archives: DataFrame | None = None
) -> DataFrame:
    """One row with archive counts, index validity and total books."""
    count_if = lambda status: F.count_if(F.col("status") == status)
    validity = index_validity(books, search_docs)
    fresh = F.lit(0).cast("bigint") if new_archives is None else new_archives.agg(F.count("*")).scalar()
    row = archives.agg(
        count_if(STATUS_INDEXED).alias("archives_indexed"), count_if(STATUS_INDEXING).alias("archives_pending")
    ).select(
        "archives_indexed",
        "archives_pending",
        fresh.alias("archives_new"),
        validity.select("search_index_valid").scalar().alias("search_index_valid"),
        validity.select("total_books").scalar().alias("total_books"),
    )
    resume = (F.col("archives_pending") > 0) | (F.col("archives_new") > 0)
    return row.withColumn("needs_resume", resume)


def ingest_counters(log: DataFrame) -> DataFrame:
    """Log rows per level."""
    return log.groupBy("level").agg(F.count("*").alias("count"))


def listing(archives: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Catalog rows plus archives only found on disk, by name."""
    unknown = on_disk.select("name").join(archives.select("name"), "name", "left_anti")
    fresh = unknown.select("name", F.lit(STATUS_NEW).alias("status"))
    return archives.select("name", "status").unionByName(fresh).orderBy("name")
