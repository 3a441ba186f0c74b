"""Full-text index and ranked search (T2–T7), browse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators import filters as flt
from shelfmark.operators import relations
from shelfmark.operators.content import present

# Fixed values of the ranking (Okapi BM25) and of the result page.
K1, B = 1.2, 0.75
RESULT_LIMIT = 1000

SEARCHED = ("title", "authors_text", "sequence")
RESULT_COLUMNS = ("id", "title", "genres", "authors", "date", "lang", "file_size", "sequence", "score")


def searched_text(columns: Sequence[str] = SEARCHED) -> Column:
    return F.concat_ws(" ", *columns)


def doc_tokens(docs: DataFrame, columns: Sequence[str] = SEARCHED, **options) -> DataFrame:
    """(doc_id, len, terms): tokens of a document and how many there are."""
    listed = docs.select(F.col("id").alias("doc_id"), text.tokens(searched_text(columns), **options).alias("terms"))
    return listed.select("doc_id", F.size("terms").cast("bigint").alias("len"), "terms")


def doc_stats(docs: DataFrame, columns: Sequence[str] = SEARCHED, **options) -> DataFrame:
    return doc_tokens(docs, columns, **options).select("doc_id", "len")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of documents and their average length."""
    return lengths.agg(
        F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).cast("double").alias("avgdl")
    )


def postings(
    docs: DataFrame, columns: Sequence[str] = SEARCHED, only: Sequence[str] | None = None, stem: bool = False, also: Sequence[str] = (), **options
) -> DataFrame:
    """(term, doc_id, tf, len). `only` keeps the terms of one query, `also` further columns of the documents.

    Terms are counted within their row, so nothing is shuffled but stems that
    several words of a text share. The length of the document travels with each
    posting, so ranking needs no join for it.
    """
    listed = docs.select(F.col("id").alias("doc_id"), text.tokens(searched_text(columns), **options).alias("terms"), *also)
    listed = listed.select("doc_id", F.size("terms").cast("bigint").alias("len"), "terms", *also)
    if only is not None and not stem:
        wanted = list(only)
        listed = listed.withColumn("terms", F.filter("terms", lambda t: t.isin(wanted)))
    # The outer form, because the plain one lets Spark add a check of the array
    # below, which would split every text twice.
    runs = listed.select("doc_id", "len", *also, F.explode_outer(text.term_counts(F.col("terms"))).alias("_t"))
    words = runs.select(F.col("_t.term").alias("term"), "doc_id", F.col("_t.tf").alias("tf"), "len", *also).filter("term IS NOT NULL")
    if stem:
        words = text.stem_russian(words, "term")
        if only is not None:
            words = words.filter(F.col("term").isin(list(only)))
        words = words.groupBy("doc_id", "len", "term", *also).agg(F.sum("tf").alias("tf"))
    return words.select("term", "doc_id", "tf", "len", *also)


def term_stats(posts: DataFrame) -> DataFrame:
    """(term, df). A term that is in most documents still is one row per task.

    Counting by `tf` keeps that column in the plan, so that a query over texts
    without an index can share the shuffle of its postings with this one.
    """
    return posts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def query_terms(spark, query: str, stem: bool = False, **options) -> list[str]:
    """Distinct terms of a query, by the same expressions that made the index."""
    words = spark.range(1).select(F.explode(text.tokens(F.lit(query), **options)).alias("term"))
    if stem:
        words = text.stem_russian(words, "term")
    return sorted({row.term for row in words.collect()})


def idf(n: Column, df: Column) -> Column:
    return F.log10((n - df + 0.5) / (df + 0.5) + 1)


def bm25(n: Column, df: Column, tf: Column, length: Column, avgdl: Column) -> Column:
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


def rank(posts: DataFrame, terms: Sequence[str], df: DataFrame, corpus: DataFrame) -> DataFrame:
    """T4: (id, score) of the documents that hold any of the terms.

    `df` is cut to the query's terms, so it has at most as many rows as the
    query has words and is safe to broadcast. The sum per document is combined
    before the shuffle.
    """
    wanted = F.col("term").isin(list(terms))
    known = F.broadcast(df.filter(wanted))
    stats = corpus.select(F.struct("n", "avgdl")).scalar()
    parts = posts.filter(wanted).join(known, "term").withColumn("s", stats)
    score = bm25(F.col("s.n"), F.col("df"), F.col("tf"), F.col("len"), F.col("s.avgdl"))
    return parts.groupBy(F.col("doc_id").alias("id")).agg(F.sum(score).alias("score"))


def rank_documents(docs: DataFrame, query_words: Sequence[str], columns: Sequence[str] = SEARCHED, **options) -> DataFrame:
    """T4 over documents that have no stored index."""
    # Few rows are left of the texts: moved once, they serve frequencies and scores.
    posts = postings(docs, columns, only=query_words, **options).repartition("doc_id")
    plain = {name: value for name, value in options.items() if name != "stem"}
    corpus = corpus_stats(doc_stats(docs, columns, **plain))
    return rank(posts, query_words, term_stats(posts), corpus)


def rank_by_scan(docs: DataFrame, query_words: Sequence[str], columns: Sequence[str] = SEARCHED, **options) -> DataFrame:
    """T4 without an index and without a shuffle of postings.

    Each text keeps its occurrences of the query's words; document frequencies
    are one global aggregate, so only scored rows leave the scan.
    """
    words = list(query_words)
    matched = doc_tokens(docs, columns, **options).select(
        "doc_id", "len", F.filter("terms", lambda t: t.isin(words)).alias("hits")
    )

    def occurrences(word: str) -> Column:
        return (F.size("hits") - F.size(F.array_remove("hits", word))).cast("bigint")

    stats = matched.agg(
        F.struct(
            F.count("*").alias("n"),
            F.avg("len").cast("double").alias("avgdl"),
            *(F.count_if(F.array_contains("hits", word)).alias(f"df{i}") for i, word in enumerate(words)),
        )
    ).scalar()
    found = present(matched.withColumn("hits", F.when(F.size("hits") > 0, F.col("hits"))), "hits")
    scored = found.withColumn("s", stats)
    score = F.lit(0.0)
    for i, word in enumerate(words):
        tf = occurrences(word)
        part = bm25(F.col("s.n"), F.col(f"s.df{i}"), tf, F.col("len"), F.col("s.avgdl"))
        score = score + F.when(tf > 0, part).otherwise(F.lit(0.0))
    return scored.select(F.col("doc_id").alias("id"), score.alias("score"))


def _first(ordered: DataFrame, limit: int | None) -> DataFrame:
    return ordered if limit is None else ordered.limit(limit)


def top_by_score(rows: DataFrame, limit: int | None = RESULT_LIMIT) -> DataFrame:
    """The best `limit` rows; every row, sorted, without one.

    A sort of every row draws a sample first: moved once, rows are not made
    twice. By id alone they may lie already and would not be moved.
    """
    moved = rows if limit is not None else rows.repartition("id", "score")
    return _first(moved.orderBy(F.desc("score"), "id"), limit)


def top_by_title(books: DataFrame, limit: int | None = RESULT_LIMIT) -> DataFrame:
    return _first(books.orderBy(F.asc_nulls_last("title"), "id"), limit)


def _page(top: DataFrame, links: DataFrame, authors: DataFrame, order: list[Column]) -> DataFrame:
    """Books that carry their authors are the page; for others they are looked up for the page only."""
    if "authors" in top.columns:
        return top.select(*RESULT_COLUMNS)
    return relations.page_with_authors(top, links, authors).select(*RESULT_COLUMNS).orderBy(*order)


def browse(
    books: DataFrame, links: DataFrame, authors: DataFrame, filters: flt.Filters, limit: int | None = RESULT_LIMIT
) -> DataFrame:
    """Filtered books by title, score 0."""
    found = flt.apply_filters(flt.complete_rows(books), filters, links, authors)
    top = top_by_title(found, limit).withColumn("score", F.lit(0.0))
    return _page(top, links, authors, [F.asc_nulls_last("title"), F.col("id")])


def ranked(
    hits: DataFrame,
    books: DataFrame,
    links: DataFrame,
    authors: DataFrame,
    filters: flt.Filters,
    limit: int | None = RESULT_LIMIT,
) -> DataFrame:
    """T4, T5: hits (id, score) with book columns; filters come before the limit."""
    found = flt.apply_filters(flt.complete_rows(books), filters, links, authors)
    top = top_by_score(hits.join(found, "id"), limit)
    return _page(top, links, authors, [F.desc("score"), F.col("id")])
