"""Joins between books, links, authors and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fields, naming
from shelfmark.operators.filters import by_ids
from shelfmark.schema import AUTHOR_FIELDS

_AUTHOR = "array<struct<id:string," + ",".join(f"{name}:string" for name in AUTHOR_FIELDS) + ">>"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over many tasks, a number that is not lowered to the size of the shuffled bytes.

    For rows that costly ones are made of: documents of small rows, or lists of
    names, of which a task would hold many times what it reads.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)


def authors_per_book(links: DataFrame, authors: DataFrame, *also: str) -> DataFrame:
    """(id, authors): the authors of each linked book in link order.

    `also` names columns of the links that tell books of one id apart.

    The join key is the author: a name that holds a large share of the links
    is split at run time, because the aggregate after the join shuffles by
    book anyway. A book's own list is the result row and stays whole.
    """
    people = authors.select(F.col("id").alias("author_id"), *AUTHOR_FIELDS)
    joined = spread(links.select("book_id", "author_id", "pos", *also).join(people, "author_id"), "book_id", *also)
    ordered = F.array_sort(
        F.collect_list(F.struct("pos", F.col("author_id").alias("id"), *AUTHOR_FIELDS))
    )
    listed = F.transform(
        ordered, lambda a: F.struct(a["id"].alias("id"), *(a[name].alias(name) for name in AUTHOR_FIELDS))
    )
    return joined.groupBy(F.col("book_id").alias("id"), *also).agg(listed.alias("authors"))


def with_authors(books: DataFrame, links: DataFrame, authors: DataFrame, *also: str) -> DataFrame:
    """Books plus their `authors` array, empty for books without any."""
    found = books.join(authors_per_book(links, authors, *also), ["id", *also], "left")
    return found.withColumn("authors", F.coalesce("authors", F.array().cast(_AUTHOR)))


def page_with_authors(page: DataFrame, links: DataFrame, authors: DataFrame) -> DataFrame:
    """The rows of a result page plus their `authors` array, with the page in the plan once.

    The page is small, so it meets links and authors as they are read.
    """
    columns = [F.col(name) for name in page.columns]
    own = page.join(links.select(F.col("book_id").alias("id"), "author_id", "pos"), "id", "left")
    people = authors.select(F.col("id").alias("author_id"), F.struct("id", *AUTHOR_FIELDS).alias("_names"))
    named = own.join(people, "author_id", "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("_names").isNotNull(), F.struct("pos", "_names"))))
    return named.groupBy(*columns).agg(F.transform(listed, lambda a: a["_names"]).cast(_AUTHOR).alias("authors"))


def search_docs(books: DataFrame, links: DataFrame, authors: DataFrame) -> DataFrame:
    """What the full-text index reads, one row per book."""
    return docs_of(with_authors(books, links, authors))


def docs_of(books: DataFrame, *also: str) -> DataFrame:
    """T1 of books that carry their authors."""
    return books.select(
        "id",
        "title",
        fields.genres_text(F.col("genres")).alias("genres_text"),
        fields.authors_text(F.col("authors")).alias("authors_text"),
        "sequence",
        *also,
    )


def hits_with_books(hits: DataFrame, books: DataFrame) -> DataFrame:
    """Book columns of search hits; a hit without a book keeps NULLs."""
    return hits.join(books, "id", "left")


def export_manifest(
    books: DataFrame, links: DataFrame, authors: DataFrame, archives: DataFrame, ids=None
) -> DataFrame:
    """(id, title, author, file_name, archive) of the wanted books; those that carry their authors need no join."""
    wanted = books if ids is None else by_ids(books, ids)
    known = wanted.join(archives.select(F.col("name").alias("archive")), "archive")
    if "authors" in known.columns:
        rows = known.select("id", "title", "archive", "authors")
    else:
        # Only the wanted books' links take part in the author join. No semi join: Spark would
        # do it below the move of the links, and its tasks hold more than those of the lists.
        own_links = links
        if ids is not None:
            own_links = spread(links, "book_id").join(known.select(F.col("id").alias("book_id")).distinct(), "book_id")
        rows = with_authors(known.select("id", "title", "archive"), own_links, authors)
    author = naming.normalized_author(fields.authors_text(F.col("authors")))
    named = rows.select("id", "title", author.alias("author"), "archive")
    return naming.with_file_name(named, F.col("author"), F.col("title"), F.col("id")).select(
        "id", "title", "author", "file_name", "archive"
    )


def archive_of(books: DataFrame, archives: DataFrame, book_id: int) -> DataFrame:
    """Name of the archive that holds one book."""
    one = books.filter(F.col("id") == book_id).select("id", F.col("archive").alias("name"))
    return one.join(archives.select("name"), "name").select("id", F.col("name").alias("archive"))
