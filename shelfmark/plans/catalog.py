"""The catalog: its tables, and everything a user asks of them."""

from __future__ import annotations

import bisect
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import schema
from shelfmark.operators import checks, content, facets, merge, relations, search
from shelfmark.operators import filters as flt
from shelfmark.plans import ingest as runs
from shelfmark.plans.index import SearchIndex
from shelfmark.sources import archives as arc
from shelfmark.sources import export
from shelfmark.sources.tables import BatchTable, Folder, VersionedTable

# Runs whose books take less than this are rewritten together.
COMPACT_BYTES = 128 * 1024 * 1024


class Catalog:
    """A library folder of archives and the warehouse folder with its catalog.

    Books, links, authors and log rows are written once per ingest run and
    never changed. The small `archives` table says which run holds an
    archive's current rows; it is written as a new version after the data, so
    a run that dies half-way leaves the previous content in force.
    """

    def __init__(self, spark: SparkSession, library: str, warehouse: str, stem: bool = True):
        self.spark, self.library, self.warehouse, self.stem = spark, library, warehouse.rstrip("/"), stem
        self._seen: tuple[int | None, list[int], bool] | None = None
        at = lambda name: f"{self.warehouse}/{name}"
        self._archives = VersionedTable(spark, at("archives"), schema.ARCHIVES)
        self._books = BatchTable(spark, at("books"), schema.BOOKS)
        self._links = BatchTable(spark, at("books_authors"), schema.LINKS)
        self._authors = BatchTable(spark, at("authors"), schema.AUTHORS)
        self._log = BatchTable(spark, at("ingest_log"), schema.INGEST_LOG)
        # Where the documents lie within the archives, and the id ranges of the files of `books`.
        self._entries = BatchTable(spark, at("entries"), arc.ENTRIES)
        self._directories = BatchTable(spark, at("directories"), schema.DIRECTORIES)
        self._zones = BatchTable(spark, at("books_zones"), schema.ZONES)
        self._search_docs = VersionedTable(spark, at("index/search_docs"), schema.SEARCH_DOCS)
        self._postings = VersionedTable(spark, at("index/postings"), schema.POSTINGS)
        self._term_stats = VersionedTable(spark, at("index/term_stats"), schema.TERM_STATS)
        self._index = SearchIndex(spark, at("index"), self._search_docs, self._postings, self._term_stats, stem)

    # --- tables ---------------------------------------------------------------

    def archive_table(self) -> DataFrame:
        return self._archives.read()

    def _state(self) -> tuple[list[int], bool]:
        """(runs that hold current rows, whether archives share book ids), read
        once per version of the archive table; as many runs as were made, not rows."""
        version = self._archives.latest()
        if self._seen is None or self._seen[0] != version:
            row = self.archive_table().agg(F.collect_set("batch").alias("batches"), F.bool_or("shared_ids").alias("shared")).first()
            self._seen = (version, sorted(row.batches), bool(row.shared))
        return self._seen[1:]

    def _current(self, table: BatchTable, archives: DataFrame | None = None) -> DataFrame:
        """Rows of the run that each archive points to."""
        return self._live(table.read(self._state()[0]), self.archive_table() if archives is None else archives)

    @staticmethod
    def _live(rows: DataFrame, archives: DataFrame) -> DataFrame:
        live = archives.filter(F.col("batch").isNotNull()).select(F.col("name").alias("archive"), "batch")
        return rows.join(live, ["archive", "batch"], "left_semi").drop("batch")

    def _resolved(self, table: BatchTable, key: str) -> DataFrame:
        """Current rows; of the archives that claim one id the greatest name wins.

        Ingest flags the archives concerned, so normally there is nothing to
        resolve and no shuffle is spent on it.
        """
        rows = self._current(table)
        if not self._state()[1]:
            return rows
        shared = self.archive_table().filter("shared_ids").select(F.col("name").alias("archive"))
        claimed = self._current(self._books).join(shared, "archive", "left_semi")
        kept = claimed.groupBy(F.col("id").alias(key)).agg(F.max("archive").alias("archive"))
        disputed = rows.join(shared, "archive", "left_semi").join(kept, [key, "archive"], "left_semi")
        return rows.join(shared, "archive", "left_anti").unionByName(disputed.select(*rows.columns))

    def books(self) -> DataFrame:
        return self._resolved(self._books, "id")

    def links(self) -> DataFrame:
        return self._resolved(self._links, "book_id")

    def _author_history(self) -> DataFrame:
        """Author rows of all runs up to the last one in force, with their `batch`."""
        last = max(self._state()[0], default=0)
        return self._authors.read([number for number in self._authors.complete() if number <= last])

    def _author_rows(self) -> DataFrame:
        """Latest row per author id. A run adds an id only when no other
        archive links to it, so the first name given to a linked id stays."""
        return self._newest(self._author_history())

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        names = F.struct(*schema.AUTHOR_FIELDS)
        newest = rows.groupBy("id").agg(F.max_by(names, F.col("batch")).alias("a"))
        return newest.select("id", *(F.col(f"a.{name}").alias(name) for name in schema.AUTHOR_FIELDS))

    def authors(self) -> DataFrame:
        """Authors with at least one book (orphans are purged by not showing)."""
        return merge.live_authors(self._author_rows(), self.links())

    def log(self) -> DataFrame:
        return self._log.read(self._log.complete())

    # --- ingest -----------------------------------------------------------------

    def ingest(
        self,
        mode: str = "new",
        archives: list[str] | DataFrame | None = None,
        strict: bool = False,
        build_index: bool = True,
    ) -> None:
        """Index archives: `full`, `new`, `pick` + names, `search`, or one name."""
        if mode == "search":
            self.build_search_index(whole=True)
            return
        on_disk = arc.list_archives(self.spark, self.library)
        chosen = runs.choose_archives(on_disk, self.archive_table(), mode, archives, strict)
        self.ingest_archives(chosen, build_index)

    def ingest_archives(self, todo: DataFrame, build_index: bool = True) -> bool:
        """One run over archive rows (name, path, length); True if it wrote.

        Parsing is written down before anything else is derived from it: the
        archives are read once, and a lost executor costs its tasks only.
        """
        run = self._runs()
        batch = run.write(todo)
        todo = run.read(batch)
        if todo.isEmpty():
            return False
        # Names of a run that died before its commit would count as the last ones.
        last = max(self._state()[0], default=0)
        self._authors.remove({number for number in self._authors.complete() if number <= last})
        self._entries.write(runs.list_archives_of(todo), batch)
        self._directories.write(todo.withColumnRenamed("name", "archive"), batch)
        parsed_at = f"{self.warehouse}/runs/parsed/batch={batch}"
        listed = self._entries.read([batch]).drop("batch")
        runs.parse_archives(listed).write.mode("overwrite").parquet(parsed_at)
        parsed = self.spark.read.parquet(parsed_at)

        known = self.archive_table()
        results = runs.outcomes(todo, parsed, known)
        self._log.write(runs.log_rows(parsed, results), batch)
        # Storage that failed says nothing about an archive: it keeps its rows and
        # stays to be indexed by the next run.
        failed = results.filter("io_failed").select("name")
        if not failed.isEmpty():
            self.mark(failed, schema.STATUS_INDEXING)
        whole = (F.col("books") > 0) | (F.col("known") & F.col("readable"))
        replaced = results.filter(~F.col("io_failed") & whole).select("name")
        if replaced.isEmpty():
            return False
        self.mark(replaced, schema.STATUS_INDEXING)
        accepted = runs.accepted(parsed).join(replaced.withColumnRenamed("name", "archive"), "archive", "left_semi")
        self._write_rows(accepted, replaced, batch)
        self._commit(replaced, batch)
        if build_index:
            self.build_search_index()
        return True

    def _runs(self) -> VersionedTable:
        """The archives (name, path, length, modified) of each run; its versions number the runs."""
        return VersionedTable(self.spark, f"{self.warehouse}/runs/archives", arc.ARCHIVES)

    def mark(self, names: DataFrame, status: str) -> None:
        """K9: a new version of the archive table with these statuses."""
        self._archives.write(merge.upsert_status(self.archive_table(), names, status))

    def _others(self, replaced: DataFrame) -> DataFrame:
        return merge.without(self.archive_table(), replaced, "name")

    def _write_rows(self, nested: DataFrame, replaced: DataFrame, batch: int) -> None:
        books, authors, links = merge.flatten_books(nested)
        named = None
        if self._state()[0]:
            # Ids that other archives still link to keep their row (K6). The ids
            # are made distinct first, so that no author's links fill one task.
            others = self._current(self._links, self._others(replaced))
            linked = others.select(F.col("author_id").alias("id")).distinct().join(authors.select("id"), "id", "left_semi")
            named = self._newest(self._author_history().join(linked, "id", "left_semi"))
            authors = merge.without(authors, linked, "id")
        self._authors.write(authors, batch)
        self._links.write(links, batch)
        # The names that links to these authors show, here and in other archives:
        # they stay as long as any current book has them.
        shown = self._authors.read([batch]).drop("batch")
        shown = shown if named is None else shown.unionByName(named)
        self._write_books(relations.with_authors(books, self._links.read([batch]), shown, "archive"), batch)

    def _write_books(self, books: DataFrame, batch: int) -> None:
        """Books by ranges of ids, and the range that each file holds."""
        self._books.write(books.repartitionByRange("id").sortWithinPartitions("id"), batch)
        named = self._books.read([batch]).groupBy(F.col("_metadata.file_name").alias("file"))
        self._zones.write(named.agg(F.min("id").alias("least"), F.max("id").alias("greatest")).coalesce(1), batch)

    def _files_in_reach(self, batch: int) -> list[tuple[int, str]]:
        """Files of `books` of current runs whose id ranges meet those of a run.

        One row for each file of the table, which the driver lists anyway.
        """
        ranges: list[list[int]] = []
        for row in sorted(self._zones.read([batch]).collect(), key=lambda r: r.least):
            if ranges and row.least <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], row.greatest)
            else:
                ranges.append([row.least, row.greatest])
        starts = [least for least, _ in ranges]
        met = []
        for row in self._zones.read([b for b in self._state()[0] if b != batch]).collect():
            at = bisect.bisect_right(starts, row.greatest) - 1
            if at >= 0 and ranges[at][1] >= row.least:
                met.append((row.batch, row.file))
        return met

    def _commit(self, replaced: DataFrame, batch: int) -> None:
        fresh = self._books.read([batch]).select("id", "archive")
        claims = fresh
        files = self._files_in_reach(batch)
        if files:
            rows = self._live(self._books.read_files(files), self._others(replaced)).select("id", "archive")
            claims = fresh.unionByName(rows.join(fresh.select("id").distinct(), "id", "left_semi"))
        disputed = claims.groupBy("id").agg(F.min("archive").alias("a"), F.max("archive").alias("b")).filter("a <> b")
        shared = claims.join(disputed.select("id"), "id", "left_semi").select(F.col("archive").alias("name"))
        flags = shared.distinct().withColumn("_shared", F.lit(True))
        done = replaced.withColumn("_done", F.lit(True))
        rows = self.archive_table().join(done, "name", "left").join(flags, "name", "left")
        finished = F.coalesce("_done", F.lit(False))
        self._archives.write(
            rows.select(
                "name",
                F.when(finished, F.lit(schema.STATUS_INDEXED)).otherwise(F.col("status")).alias("status"),
                F.when(finished, F.lit(batch).cast("long")).otherwise(F.col("batch")).alias("batch"),
                F.when(finished, F.lit(batch).cast("long")).otherwise(F.col("content")).alias("content"),
                F.coalesce("_shared", F.when(finished, F.lit(False)).otherwise(F.col("shared_ids")), F.lit(False)).alias(
                    "shared_ids"
                ),
            )
        )

    # --- upkeep -----------------------------------------------------------------

    def compact(self, small_bytes: int = COMPACT_BYTES) -> int | None:
        """Current rows of runs smaller than `small_bytes` become one run; then all that no archive points to goes.

        So a catalog of any number of runs reads as many paths as it has large
        ones. Nothing is parsed or indexed again: the archives keep their
        content and point to the new run, which is written whole before they
        do. Not to be called while a run ingests. Returns the new run, if any.
        """
        live = self._state()[0]
        small = [run for run in live if self._books.size(run) < small_bytes]
        if not small or (len(small) == 1 and self._books.complete() == small):
            return None
        kept = [run for run in live if run not in small]
        run = self._runs().write(self.spark.createDataFrame([], arc.ARCHIVES))
        moved = self.archive_table().filter(F.col("batch").isin(small))
        for table in (self._links, self._entries, self._directories):
            table.write(self._live(table.read(small), moved), run)
        self._write_books(self._live(self._books.read(small), moved), run)
        # Author rows of runs that go, as far as they are the last of an id that is linked.
        newest = self._author_history().groupBy("id").agg(F.max_by(F.struct(*schema.AUTHOR_FIELDS, "batch"), "batch").alias("a"))
        gone = newest.filter(~F.col("a.batch").isin(kept)).select("id", *(F.col(f"a.{name}").alias(name) for name in schema.AUTHOR_FIELDS))
        self._authors.write(merge.live_authors(gone, self._current(self._links)), run)
        self._log.write(self._log.read([number for number in self._log.complete() if number not in kept]), run)
        into = F.when(F.col("batch").isin(small), F.lit(run).cast("long")).otherwise(F.col("batch"))
        self._archives.write(self.archive_table().withColumn("batch", into))
        self._remove_unnamed({*kept, run})
        return run

    def _remove_unnamed(self, kept: set[int]) -> None:
        for table in (self._books, self._zones, self._links, self._authors, self._entries, self._directories, self._log):
            table.remove(kept)
        self._runs().remove({max(kept)})
        Folder(self.spark, self.warehouse).delete("runs/parsed")
        self._archives.remove({self._archives.latest()})
        self._index.remove_unnamed()

    # --- full-text index --------------------------------------------------------

    def build_search_index(self, whole: bool = False, upto: int | None = None) -> int:
        """A new index version; the old one serves until it is written.

        Contents that are not indexed yet become a segment; `whole` indexes
        every content anew, in one. `upto` leaves the contents of later runs out.
        """
        archives = self.archive_table()
        if upto is not None:
            archives = archives.filter(F.col("content") <= upto)
        missing = self._index.missing(archives, whole)
        own = archives.join(missing.select(F.col("archive").alias("name")), "name", "left_semi")
        books = flt.complete_rows(self._current(self._books, own))
        contents = own.select(F.col("name").alias("archive"), "content")
        docs = relations.docs_of(books, "archive").join(contents, "archive")
        return self._index.add(docs, archives, whole)

    def search_docs(self) -> DataFrame | None:
        return self._index.docs()

    # --- questions --------------------------------------------------------------

    def search(self, query: str = "", filters: flt.Filters | None = None, limit: int | None = search.RESULT_LIMIT) -> DataFrame:
        """Ranked match of a query, or browse by title when it is blank."""
        filters = filters or flt.Filters()
        # Links and authors are read only for a filter by author.
        books, links, authors = self.books(), self.links(), self._author_rows()
        if not query.strip():
            return search.browse(books, links, authors, filters, limit)
        if self._index.version() is None:
            self.build_search_index()
        terms = search.query_terms(self.spark, query, stem=self.stem)
        if limit is None:
            hits = self._index.hits(terms)
        else:
            found = flt.apply_filters(flt.complete_rows(books), filters, links, authors).select("id")
            hits, _ = self._index.best_hits(terms, limit, lambda rows: rows.join(found, "id", "left_semi"))
        return search.ranked(hits, books, links, authors, filters, limit)

    def count(self) -> int:
        return facets.total(self.books()).first().total

    def facet(self, column: str = "lang", unspecified: bool = False) -> DataFrame:
        return facets.facet(self.books(), column, unspecified)

    def archives(self) -> DataFrame:
        """Known archives with their status, and new ones on disk."""
        return facets.listing(self.archive_table(), arc.list_archives(self.spark, self.library))

    def health(self) -> DataFrame:
        known = self.archive_table()
        fresh = arc.list_archives(self.spark, self.library).join(known, "name", "left_anti")
        return facets.health(known, self.books(), self.search_docs(), fresh)

    def check(self) -> DataFrame:
        return checks.check_catalog(self.archive_table(), self.books(), self.authors(), self.links())

    # --- contents -----------------------------------------------------------------

    def manifest(self, ids=None) -> DataFrame:
        """(id, title, author, file_name, archive) of the books to export."""
        if isinstance(ids, list):
            ids = self.spark.createDataFrame([(number,) for number in ids], "id long").distinct()
        return relations.export_manifest(self.books(), self.links(), self._author_rows(), self.archive_table(), ids)

    def _read(self, wanted: DataFrame, what: str, ids=None, by: str | None = None, most: int | None = None) -> DataFrame:
        """Bytes or text of books, by the kept directories of their archives.

        A list of ids is looked up by literals, which reach the row groups of
        the kept directories.
        """
        entries = self._current(self._entries)
        if isinstance(ids, list):
            archives = sorted({row.archive for row in wanted.select("archive").collect()})
            entries = entries.filter(F.col("archive").isin(archives) & F.col("entry").isin([f"{number}.fb2" for number in ids]))
        directory = (self._current(self._directories), entries)
        return arc.lookup(arc.list_archives(self.spark, self.library), wanted, what, None, directory, by, most)

    def _documents(self, ids) -> DataFrame:
        books = self.books() if ids is None else flt.by_ids(self.books(), ids)
        return self._read(books.select("archive", "id"), "text", ids)

    def annotations(self, ids=None) -> DataFrame:
        return content.annotations(self._documents(ids)).select("id", "annotation")

    def covers(self, ids=None) -> DataFrame:
        return content.covers(self._documents(ids)).select("id", "cover_type", "cover_data")

    def contents(self, ids=None) -> DataFrame:
        """(id, file_name, data)."""
        read = self._read(self.manifest(ids).select("archive", "id", "file_name"), "content", ids)
        return read.select("id", "file_name", F.col("content").alias("data"))

    def export(self, ids, out_dir: str) -> DataFrame:
        """Write the books as files; returns (id, title, author, output_path)."""
        read = self._read(self.manifest(ids), "content", ids).withColumnRenamed("content", "data")
        return export.write_files(read, out_dir, self._new_export()).select("id", "title", "author", "output_path")

    def export_bundles(self, ids, out_dir: str, per_bundle: int = 1000) -> DataFrame:
        """Pack the books into several archives; returns (bundle, id, file_name).

        Books are dealt to bundles before they are read, so no document is shuffled.
        """
        books = self.manifest(ids).select("archive", "id", "file_name")
        bundles = max(1, -(-books.count() // per_bundle))
        dealt = books.withColumn("bundle", F.format_string("books-%05d.zip", F.pmod(F.xxhash64("id"), F.lit(bundles))))
        read = self._read(dealt, "content", ids, by="bundle", most=bundles).withColumnRenamed("content", "data")
        return export.write_archives(read.withColumn("archive", F.col("bundle")), out_dir, self._new_export())

    def _new_export(self) -> str:
        """A folder for the manifest of an export."""
        return f"{self.warehouse}/exports/{uuid.uuid4().hex}"
