"""The stored full-text index: segments of contents, and versions that say which of them serve."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import schema
from shelfmark.operators import search
from shelfmark.sources.tables import VersionedTable

# Segments whose sizes lie within one power of GROWTH are a tier; as many of them become one.
GROWTH = 8
# Ids of a block of postings, and the blocks that a search scores before it knows a threshold.
BLOCK_IDS = 4096
FIRST_BLOCKS = 64
# Scores are sums in no fixed order: bounds are taken this much higher.
SLACK = 1 + 1e-9


class SearchIndex:
    """Segments are written once; a version of two small tables names those in force.

    `served` says which content of each archive the version serves, `segments`
    what covers it. A run adds a segment of its own contents and reads no older
    postings, but when a tier is full: then its segments become one, of live
    rows only. So an archive is rewritten a logarithmic number of times. The
    version is written last; a build that dies leaves the former one in force.
    """

    def __init__(self, spark: SparkSession, path: str, docs: VersionedTable, postings: VersionedTable, stats: VersionedTable, stem: bool):
        self.spark, self.stem = spark, stem
        self.docs_table, self.postings_table, self.stats_table = docs, postings, stats
        self.lengths = VersionedTable(spark, f"{path}/lengths", schema.LENGTHS)
        self.blocks = VersionedTable(spark, f"{path}/blocks", schema.BLOCKS)
        self.served = VersionedTable(spark, f"{path}/served", schema.SERVED)
        # Written last: its latest version is the index in force.
        self.segments = VersionedTable(spark, f"{path}/segments", schema.SEGMENTS)

    def _parts(self) -> tuple[VersionedTable, ...]:
        return self.docs_table, self.postings_table, self.stats_table, self.lengths, self.blocks

    def version(self) -> int | None:
        return self.segments.latest()

    def _next(self) -> int:
        return max(part.next_number() for part in (*self._parts(), self.segments, self.served))

    def _named(self, version: int | None) -> dict[int, tuple[int, list[int]]]:
        """segment -> (bytes, contents): as many rows as runs were indexed."""
        named: dict[int, tuple[int, list[int]]] = {}
        for row in self.segments.read(version).collect() if version is not None else []:
            named.setdefault(row.segment, (row.size, []))[1].append(row.content)
        return named

    # --- writing ----------------------------------------------------------------

    def missing(self, archives: DataFrame, whole: bool = False) -> DataFrame:
        """(archive, content) of `archives` (name, content, …) that no segment covers."""
        covered = [] if whole else sorted({c for _, contents in self._named(self.version()).values() for c in contents})
        live = archives.filter(F.col("content").isNotNull()).select(F.col("name").alias("archive"), "content")
        return live.join(self.spark.createDataFrame([(c,) for c in covered], "content long"), "content", "left_anti")

    def add(self, docs: DataFrame, archives: DataFrame, whole: bool = False) -> int:
        """A version that serves `archives` (name, content, shared_ids): a segment of `docs` beside those in force, or alone.

        `docs`: search documents with archive and content, of every content that is missing.
        """
        named = {} if whole else self._named(self.version())
        number = self._next()
        # Contents without any book are covered too.
        fresh = sorted(row.content for row in self.missing(archives, whole).select("content").distinct().collect())
        if fresh:
            self._write(docs, number)
            named[number] = (self.postings_table.size(number), fresh)
        self.served.write(archives.filter(F.col("content").isNotNull()), number)
        self._name(number, named)
        self._merge(number, named)
        return self.version()

    def _name(self, version: int, named: dict[int, tuple[int, list[int]]]) -> None:
        rows = [(segment, content, size) for segment, (size, contents) in sorted(named.items()) for content in contents]
        self.segments.write(self.spark.createDataFrame(rows, schema.SEGMENTS).coalesce(1), version)

    def _write(self, docs: DataFrame, number: int) -> None:
        """Postings are laid out by (term, document): a query reads the row groups
        of its terms only, and a term found in most documents spans many files."""
        sized = docs.withColumn("len", F.size(search.text.tokens(search.searched_text())).cast("bigint"))
        self.docs_table.write(sized, number)
        posts = search.postings(self.docs_table.read(number), stem=self.stem, also=("archive", "content"))
        self._write_postings(posts, number)

    def _write_postings(self, posts: DataFrame, number: int) -> None:
        self.postings_table.write(posts.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), number)
        counted = self.postings_table.read(number).groupBy("term", "archive", "content").agg(F.count("*").alias("df"))
        self.stats_table.write(counted.repartitionByRange("term", "archive").sortWithinPartitions("term", "archive"), number)
        bounds = self.postings_table.read(number).groupBy("term", self._block("doc_id")).agg(F.max("tf").alias("most_tf"), F.min("len").alias("least_len"))
        self.blocks.write(bounds.repartitionByRange("term", "block").sortWithinPartitions("term", "block"), number)
        docs = self.docs_table.read(number).groupBy("archive", "content")
        self.lengths.write(docs.agg(F.count("*").alias("docs"), F.sum("len").alias("words")), number)

    def _merge(self, version: int, named: dict[int, tuple[int, list[int]]]) -> None:
        """Full tiers become one segment each, the smallest first; rows that the version does not serve are left out."""
        while True:
            tiers: dict[int, list[int]] = {}
            for segment, (size, _) in named.items():
                tiers.setdefault(size.bit_length() // (GROWTH.bit_length() - 1), []).append(segment)
            full = next((tiers[tier] for tier in sorted(tiers) if len(tiers[tier]) >= GROWTH), None)
            if full is None:
                return
            number = self._next()
            live = self.served.read(version)
            self.docs_table.write(self._live(self.docs_table.read_all(full), live), number)
            self._write_postings(self._live(self.postings_table.read_all(full), live), number)
            contents = sorted(c for segment in full for c in named[segment][1])
            named = {segment: rest for segment, rest in named.items() if segment not in full}
            named[number] = (self.postings_table.size(number), contents)
            self.served.write(live, number)
            self._name(number, named)
            version = number

    def remove_unnamed(self) -> None:
        """Deletes segments and versions that are not in force."""
        version = self.version()
        if version is not None:
            for part in self._parts():
                part.remove(set(self._named(version)))
            self.segments.remove({version})
            self.served.remove({version})

    # --- reading ----------------------------------------------------------------

    @staticmethod
    def _live(rows: DataFrame, served: DataFrame) -> DataFrame:
        return rows.join(served.select(F.col("name").alias("archive"), "content"), ["archive", "content"], "left_semi")

    def _shared(self, version: int) -> DataFrame | None:
        """Archives of the version whose books other archives claim too, if there are any."""
        shared = self.served.read(version).filter("shared_ids")
        return None if shared.isEmpty() else shared

    def _kept(self, version: int, shared: DataFrame) -> DataFrame:
        """(id, archive): of the archives that claim one id the greatest name wins."""
        claimed = self._live(self.docs_table.read_all(list(self._named(version))), shared)
        return claimed.groupBy("id").agg(F.max("archive").alias("archive"))

    def _resolved(self, rows: DataFrame, version: int, shared: DataFrame | None, key: str) -> DataFrame:
        served = self.served.read(version)
        if shared is None:
            return self._live(rows, served)
        kept = self._kept(version, shared).withColumnRenamed("id", key)
        disputed = self._live(rows, shared).join(kept, [key, "archive"], "left_semi")
        return self._live(rows, served.filter("not shared_ids")).unionByName(disputed.select(*rows.columns))

    def docs(self) -> DataFrame | None:
        """Search documents of the version in force, one for each book."""
        version = self.version()
        if version is None:
            return None
        return self._resolved(self.docs_table.read_all(list(self._named(version))), version, self._shared(version), "id")

    @staticmethod
    def _block(column: str) -> Column:
        return F.floor(F.col(column) / BLOCK_IDS).alias("block")

    def _statistics(self, posts: DataFrame, terms: list[str], version: int, shared: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(term, df) of the terms and one row (n, avgdl).

        They are added up from the tables of the segments; of archives that
        share ids they are counted from the rows.
        """
        segments, served = list(self._named(version)), self.served.read(version)
        plain = served if shared is None else served.filter("not shared_ids")
        df = self._live(self.stats_table.read_all(segments).filter(F.col("term").isin(terms)), plain).select("term", "df")
        lengths = self._live(self.lengths.read_all(segments), plain).select("docs", "words")
        if shared is not None:
            df = df.unionByName(self._live(posts, shared).groupBy("term").agg(F.count("*").alias("df")))
            own = self._live(self.docs(), shared).agg(F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"))
            lengths = lengths.unionByName(own)
        n, words = F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))
        corpus = lengths.agg(n.alias("n"), F.when(n > 0, words / n).otherwise(F.lit(0.0)).alias("avgdl"))
        return df.groupBy("term").agg(F.sum("df").alias("df")), corpus

    def _postings(self, terms: list[str], version: int, shared: DataFrame | None) -> DataFrame:
        rows = self.postings_table.read_all(list(self._named(version))).filter(F.col("term").isin(terms))
        return self._resolved(rows, version, shared, "doc_id")

    def hits(self, terms: list[str], blocks: DataFrame | None = None) -> DataFrame:
        """T4: (id, score) by the postings of the version in force; `blocks` (block) leaves the others out."""
        version = self.version()
        shared = self._shared(version)
        posts = self._postings(terms, version, shared)
        df, corpus = self._statistics(posts, terms, version, shared)
        if blocks is not None:
            posts = posts.withColumn("block", self._block("doc_id")).join(blocks, "block", "left_semi")
        return search.rank(posts, terms, df, corpus)

    def bounds(self, terms: list[str]) -> DataFrame:
        """(block, bound): what no document of the block scores more than."""
        version = self.version()
        shared = self._shared(version)
        df, corpus = self._statistics(self._postings(terms, version, shared), terms, version, shared)
        rows = self.blocks.read_all(list(self._named(version))).filter(F.col("term").isin(terms))
        best = rows.groupBy("term", "block").agg(F.max("most_tf").alias("tf"), F.min("least_len").alias("len"))
        stats = corpus.select(F.struct("n", "avgdl")).scalar()
        parts = best.join(F.broadcast(df), "term").withColumn("s", stats)  # one row for each word of the query
        score = search.bm25(F.col("s.n"), F.col("df"), F.col("tf"), F.col("len"), F.col("s.avgdl"))
        return parts.groupBy("block").agg((F.sum(score) * SLACK).alias("bound"))

    def best_hits(self, terms: list[str], limit: int, wanted: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
        """Hits among which are the best `limit` of those that `wanted` keeps, and the blocks they were read from.

        The blocks of the greatest bounds are scored first; the last of their
        best `limit` is a threshold, and blocks whose bound does not reach it
        are not scored at all. With few blocks, or fewer rows than wanted in the
        first ones, every block is read (None).
        """
        bounds = self.bounds(terms)
        first = [row.block for row in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS + 1).collect()]
        if len(first) <= FIRST_BLOCKS:
            return self.hits(terms), None
        some = self.spark.createDataFrame([(block,) for block in first[:FIRST_BLOCKS]], "block long")
        best = wanted(self.hits(terms, some)).orderBy(F.desc("score")).limit(limit)
        row = best.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        if row.n < limit:
            return self.hits(terms), None
        reached = bounds.filter(F.col("bound") >= row.least).select("block")
        return self.hits(terms, reached), reached
