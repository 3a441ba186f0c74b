"""What a catalog of many runs keeps: index segments, directories of archives, id ranges, compacted runs."""

from __future__ import annotations

import os

import pytest
from builders import book, write_zip
from pyspark.sql import functions as F

from shelfmark.operators import search
from shelfmark.operators.filters import Filters
from shelfmark.plans import index
from shelfmark.plans.catalog import Catalog
from shelfmark.sources import archives as arc
from shelfmark.sources import export
from shelfmark.sources.reader import read_archives


def found(frame):
    return {r.id: round(r.score, 9) for r in frame.collect()}


def by_hand(catalog, query):
    """The same ranking over the search documents, without any index."""
    terms = search.query_terms(catalog.spark, query, stem=catalog.stem)
    hits = search.rank_documents(catalog.search_docs(), terms, stem=catalog.stem)
    return found(hits.join(catalog.books(), "id", "left_semi"))


def segments(catalog):
    return catalog._index._named(catalog._index.version())


def test_segments_of_runs(catalog, library, monkeypatch):
    write_zip(library / "a.zip", {f"{i}.fb2": book(f"Red Book {i % 3}", "Ann", "Lee") for i in range(1, 9)})
    catalog.ingest("new")
    assert len(segments(catalog)) == 1
    write_zip(library / "b.zip", {"11.fb2": book("Красные книги", "Иван", "Петров", "ru"), "12.fb2": book("Red sea", "Bob", "Ray")})
    # The second run reads and writes postings of its own segment only.
    touched = []
    reading, writing = catalog._postings.read, catalog._postings.write
    monkeypatch.setattr(catalog._postings, "read", lambda number: touched.append(number) or reading(number))
    monkeypatch.setattr(catalog._postings, "write", lambda frame, number: touched.append(number) or writing(frame, number))
    monkeypatch.setattr(catalog._postings, "read_all", lambda numbers: pytest.fail("older postings were read"))
    catalog.ingest("new")
    monkeypatch.undo()
    (first, second) = sorted(segments(catalog))
    assert set(touched) == {second} and catalog.health().first().search_index_valid
    for query in ("red lee", "красная книга", "ray sea 2"):
        assert found(catalog.search(query)) == by_hand(catalog, query) != {}

    # A replaced archive leaves its old postings behind; an id that two archives claim counts once.
    write_zip(library / "a.zip", {"1.fb2": book("Blue Book", "Ann", "Lee"), "12.fb2": book("Red coast", "Ann", "Lee")})
    catalog.ingest("a.zip")
    assert len(segments(catalog)) == 3
    for query in ("red lee", "coast sea book"):
        assert found(catalog.search(query)) == by_hand(catalog, query) != {}
    assert [r.title for r in catalog.search("coast sea").collect()] == ["Red sea"]
    before = found(catalog.search("red book"))
    # Equal to an index made anew, in one segment, of which nothing is stale.
    catalog.ingest("search")
    assert len(segments(catalog)) == 1 and found(catalog.search("red book")) == before


def test_full_tiers_become_one_segment(catalog, library, monkeypatch):
    monkeypatch.setattr(index, "GROWTH", 2)
    for number in range(1, 5):
        write_zip(library / f"{number}.zip", {f"{number}{i}.fb2": book(f"Tale {i} of {number}", "Ann", "Lee") for i in range(3)})
        catalog.ingest("new")
    assert len(segments(catalog)) <= 3
    assert sorted(c for _, contents in segments(catalog).values() for c in contents) == [1, 2, 3, 4]
    assert found(catalog.search("tale 3 lee")) == by_hand(catalog, "tale 3 lee") and len(found(catalog.search("tale"))) == 12
    catalog._index.remove_unnamed()
    assert found(catalog.search("tale 3 lee")) == by_hand(catalog, "tale 3 lee")


def test_blocks_below_the_threshold_are_not_scored(catalog, library, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_IDS", 8)
    monkeypatch.setattr(index, "FIRST_BLOCKS", 4)
    word = lambda i: " ".join(["Sea"] * (4 if i % 40 == 3 else 1) + ["wide"] * (i % 7))
    write_zip(library / "a.zip", {f"{i}.fb2": book(f"{word(i)} no{i}", "Ann", "Lee", "ru" if i % 3 else "en") for i in range(1, 161)})
    catalog.ingest("new")
    write_zip(library / "b.zip", {f"{i}.fb2": book(f"sea {i}", "Bob", "Ray") for i in range(201, 221)})
    catalog.ingest("new")
    terms = search.query_terms(catalog.spark, "sea", stem=True)
    every = catalog._index.bounds(terms).count()
    hits, blocks = catalog._index.best_hits(terms, 3, lambda rows: rows)
    assert every > 20 > 8 >= blocks.count() >= 1 and hits.count() < 80
    bounds = {r.block: r.bound for r in catalog._index.bounds(terms).collect()}
    assert all(r.score <= bounds[r.id // 8] for r in catalog._index.hits(terms).collect())
    page = lambda rows: [(r.id, round(r.score, 9)) for r in rows.collect()]
    for query, filters in (("sea", None), ("sea wide", None), ("sea", Filters(lang="en")), ("sea lee", Filters(authors="ray")), ("sea", Filters(title="no7"))):
        whole = page(catalog.search(query, filters, limit=None))
        assert page(catalog.search(query, filters, limit=5)) == whole[:5] != []


def test_an_index_that_is_not_finished_serves_nothing(catalog, library, monkeypatch):
    write_zip(library / "a.zip", {"1.fb2": book("Original")})
    catalog.ingest("new")
    write_zip(library / "a.zip", {"1.fb2": book("Original again")})

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(catalog._index, "_name", crash)
    with pytest.raises(RuntimeError):
        catalog.ingest("a.zip")
    monkeypatch.undo()
    # The rows are new, the index is the former one until the next build.
    assert [r.title for r in catalog.search("original").collect()] == ["Original again"] and found(catalog.search("again")) == {}
    catalog.build_search_index()
    assert len(found(catalog.search("again"))) == 1 and catalog.health().first().search_index_valid


def test_compacted_runs(catalog, library):
    given = lambda name: f"<author><first-name>{name}</first-name><id>same</id></author>"
    for number, name in enumerate(("First", "Second", "Third"), 1):
        write_zip(library / f"{number}.zip", {f"{number}{i}.fb2": book(f"Tale {i} of {number}", "Ann", "Lee", extra=given(name)) for i in range(3)})
        catalog.ingest("new")
    write_zip(library / "1.zip", {"19.fb2": book("Other")})
    catalog.ingest("1.zip")
    state = lambda: (
        catalog.books().orderBy("id").collect(), catalog.links().orderBy("book_id", "pos").collect(), catalog.authors().orderBy("id").collect(),
        catalog.log().select("archive", "entry", "level", "message").orderBy("archive", "message").collect(), found(catalog.search("tale first lee")),
        sorted((r.id, bytes(r.data)) for r in catalog.contents([19, 20, 31]).collect()),
    )
    before, named = state(), segments(catalog)
    assert {r.id: r.first_name for r in catalog.authors().collect()}["same"] == "First"
    run = catalog.compact()
    assert run == 5 and state() == before
    assert catalog._books.complete() == [run] == catalog._authors.complete() == catalog._entries.complete() == catalog._log.complete()
    # Nothing is parsed or indexed again, and nothing is left to compact.
    assert segments(catalog) == named and catalog._index.missing(catalog.archive_table()).isEmpty() and catalog.compact() is None
    assert {r.content for r in catalog.archive_table().collect()} == {2, 3, 4}
    write_zip(library / "4.zip", {"41.fb2": book("Late", extra=given("Fourth"))})
    catalog.ingest("new")
    assert {r.id: r.first_name for r in catalog.authors().collect()}["same"] == "First"
    assert len(found(catalog.search("late"))) == 1 and {r.violations for r in catalog.check().collect()} == {0}


def test_ranges_of_files(spark, catalog, library):
    for number in (1, 5, 9):
        write_zip(library / f"{number}.zip", {f"{number}0{i}.fb2": book(f"{number} {i}") for i in range(4)})
        catalog.ingest("new", build_index=False)
    write_zip(library / "x.zip", {"503.fb2": book("Claimed twice"), "700.fb2": book("Between")})
    catalog.ingest("new", build_index=False)
    # Only the second run's file has ids in reach of the fourth's.
    assert {batch for batch, _ in catalog._files_in_reach(4)} == {2}
    assert {r.name for r in catalog.archive_table().filter("shared_ids").collect()} == {"5.zip", "x.zip"}
    assert catalog.count() == 13


def spoil_directory(path):
    """Garbage in place of an archive's directory; length and time stay."""
    raw, stat = path.read_bytes(), path.stat()
    path.write_bytes(raw[: raw.index(b"PK\x01\x02")] + b"?" * (len(raw) - raw.index(b"PK\x01\x02")))
    os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))


def test_lookups_by_kept_directories(catalog, library):
    cover = '<binary id="c" content-type="image/png">aGVsbG8=</binary>'
    extra = '<coverpage><image l:href="#c"/></coverpage>'
    write_zip(library / "a.zip", {"1.fb2": book("One", extra=extra, tail=cover), "2.fb2": book("Two", extra=extra, tail=cover)})
    write_zip(library / "b.zip", {"3.fb2": book("Three", extra=extra, tail=cover)})
    catalog.ingest("new", build_index=False)
    for name in ("a.zip", "b.zip"):
        spoil_directory(library / name)
    assert {r.id: bytes(r.cover_data) for r in catalog.covers([1, 3]).collect()} == {1: b"hello", 3: b"hello"}
    assert len(catalog.contents(None).collect()) == 3
    # Another time: the archive is listed again, and its directory is no more.
    os.utime(library / "a.zip", (1, 1))
    assert {r.id for r in catalog.covers(None).collect()} == {3}
    write_zip(library / "a.zip", {"2.fb2": book("Two", extra=extra, tail=cover.replace("aGVsbG8=", "bmV3"))})
    assert {r.id: bytes(r.cover_data) for r in catalog.covers([1, 2]).collect()} == {2: b"new"}


def test_storage_faults_fail_lookups(spark, catalog, library):
    write_zip(library / "a.zip", {"1.fb2": book("One")})
    on_disk = arc.list_archives(spark, str(library))
    gone = on_disk.withColumn("path", F.concat("path", F.lit(".gone")))
    wanted = spark.createDataFrame([("a.zip", 1)], "archive string, id long")
    with pytest.raises(Exception, match="I/O error"):
        arc.lookup(gone, wanted).collect()
    (row,) = arc.list_entries(gone).collect()
    assert row.error.startswith(arc.IO_ERROR) and row.entry is None
    assert len(arc.lookup(on_disk, wanted).collect()) == 1
    assert arc.lookup(on_disk, spark.createDataFrame([("a.zip", 7), ("none.zip", 1)], wanted.schema)).collect() == []


def test_faults_by_call():
    class Store:
        """As object stores fail: an error without a number."""

        def seek(self, *_):
            return 0

        def tell(self):
            return 100

        def read(self, *_):
            raise OSError("When reading information for key: AWS Error NETWORK_CONNECTION")

        def close(self):
            pass

    with pytest.raises(arc.StorageFault, match="NETWORK"):
        list(arc.directory_entries(arc.Stored(Store())))
    for path in ("dbfs:/lib/a.zip", "nosuch:/lib/a.zip", "nosuch://host/a.zip"):
        with pytest.raises(arc.UnknownStore):
            arc._open(path)
    with pytest.raises(arc.StorageFault):
        arc._open("/no/such folder: at all/a.zip")


def test_catalogs_of_one_warehouse_agree(spark, catalog, library, tmp_path):
    write_zip(library / "a.zip", {"1.fb2": book("One", "Ann", "Lee")})
    catalog.ingest("new")
    other = Catalog(spark, str(library), str(tmp_path / "warehouse"))
    assert found(other.search("one")) == found(catalog.search("one")) != {}
    assert [(r.id, r.authors[0].last_name) for r in other.search("").collect()] == [(1, "Lee")]


# --- exports with a commit ------------------------------------------------------------------


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    out, notes = tmp_path / "out", tmp_path / "notes"
    rows = spark.range(40).select("id", F.concat(F.lit("b "), F.col("id").cast("string")).alias("file_name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("data"))
    bad = rows.repartition(4, "id").withColumn("data", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        export.write_files(bad, str(out), str(notes))
    assert list(out.rglob("*")) == [] and [p for p in notes.rglob("*") if p.is_file()] == []
    written = export.write_files(rows.repartition(4, "id"), str(out), str(notes))
    assert sorted(p.name for p in out.iterdir()) == sorted(f"b {i}" for i in range(40))
    assert {r.id: open(r.output_path.removeprefix("file:")).read() for r in written.collect()} == {i: str(i) for i in range(40)}


def test_attempts_that_are_not_committed_leave_nothing(tmp_path):
    """A twin of a task wrote as well; the commit names one of them."""
    import pyarrow as pa

    out, notes = f"file:{tmp_path}/out", f"file:{tmp_path}/notes"
    writer = export.BookWriter("files", out, notes)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "file_name": ["x", "y"], "data": [b"1", b"2"]})
    first, _ = writer.write(iter([batch])), writer.write(iter([batch]))
    assert [p.name for p in (tmp_path / "out").iterdir()] == [export.UNFINISHED]
    writer.commit([first, None])
    assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == ["x", "y"] and len(list((tmp_path / "notes").rglob("*"))) == 1
    other = export.BookWriter("bundles", out, notes)
    other.write(iter([pa.RecordBatch.from_pydict({"archive": ["b.zip"], "id": [1], "file_name": ["x"], "data": [b"1"]})]))
    other.abort([])
    assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == ["x", "y"]


# --- archives as a data source ----------------------------------------------------------------


def test_filters_reach_the_archives(spark, library):
    texts = {f"{i}.fb2": bytes((i * 37 + j) % 256 for j in range(900)) for i in range(1, 40)}
    write_zip(library / "a.zip", {**texts, "notes.txt": "no document", "77.fb2": ""})
    (library / "broken.zip").write_bytes(b"garbage")
    rows = read_archives(spark, str(library), slice_bytes=2000)
    assert rows.rdd.getNumPartitions() > 5
    read = rows.collect()
    assert {r.entry: bytes(r.content) for r in read if not r.error} == texts
    assert {(r.archive, r.entry) for r in read if r.error} == {("broken.zip", None), ("a.zip", "77.fb2")}
    one = read_archives(spark, str(library), slice_bytes=2000).filter("archive = 'broken.zip'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1
    # The damaged file is not opened: no row tells of it, and no slice of it is planned.
    some = read_archives(spark, str(library), "content").filter("archive in ('a.zip', 'none.zip') and entry in ('3.fb2', '4.fb2') and file_size > 1")
    assert sorted((r.entry, bytes(r.content)) for r in some.collect()) == [(n, texts[n]) for n in ("3.fb2", "4.fb2")]
    assert "Filter" in some._jdf.queryExecution().optimizedPlan().toString() and some.rdd.getNumPartitions() == 1
    assert read_archives(spark, str(library), "text").filter("archive = 'none.zip'").count() == 0


def test_archive_source_without_pushdown(spark, library):
    write_zip(library / "a.zip", {f"{n}.fb2": book(f"T{n}") for n in range(5)})
    write_zip(library / "b.zip", {"9.fb2": book("T9")})
    (library / "c.zip").write_bytes(b"none")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        rows = read_archives(spark, str(library)).filter("archive in ('a.zip', 'none.zip') and entry in ('3.fb2', '4.fb2')")
        assert sorted(r.entry for r in rows.collect()) == ["3.fb2", "4.fb2"]
        assert read_archives(spark, str(library), slice_bytes=64 * 1024 * 1024).rdd.getNumPartitions() == 1
        named = read_archives(spark, str(library), archives=["b.zip"])
        assert [(r.archive, r.entry) for r in named.collect()] == [("b.zip", "9.fb2")]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- work that grows with the rows, not with the bytes alone -----------------------------------


def test_tasks_grow_with_entries_and_archives(spark, library):
    write_zip(library / "a.zip", {f"{n}.fb2": "x" for n in range(500)})
    archives = arc.list_archives(spark, str(library))
    assert arc.entry_partitions(arc.list_entries(archives), 1024 * 1024) >= 7
    assert arc.read_partitions(archives, 64 * 1024) >= 4


def test_exported_files_are_read_where_their_rows_lie(spark, tmp_path):
    paths = []
    for n in range(5):
        (tmp_path / f"{n} [{n}].fb2").write_text(str(n) * n)
        paths.append((n, str(tmp_path / f"{n} [{n}].fb2")))
    rows = export.read_files(spark.createDataFrame(paths, "id long, output_path string"), "output_path")
    assert {r.id: bytes(r.content).decode() for r in rows.collect()} == {n: str(n) * n for n in range(5)}
    with pytest.raises(Exception, match="No such file"):
        export.read_files(spark.createDataFrame([(1, str(tmp_path / "none"))], "id long, output_path string"), "output_path").collect()


def test_listings_need_no_catalog(spark, monkeypatch):
    from shelfmark.plans import stored

    monkeypatch.setattr(stored, "_shelves", {})
    for name in ("s1_s4_archives", "s3_entry_listing", "s5_entry_contents", "s5_archive_source"):
        stored.query.__globals__["REGISTRY"][name][0](spark, "/root/testdata/sf0.001")
    assert not stored._shelves


def test_batches_of_a_stream_are_bounded_by_bytes(catalog, library, tmp_path):
    from shelfmark.streaming.watch import watch_library

    for n in range(1, 4):
        write_zip(library / f"{n}.zip", {f"{n}.fb2": book(f"T{n}")})
    for size, runs in ((1, 3), (1024**3, 1)):
        own = Catalog(catalog.spark, str(library), str(tmp_path / f"w{size}"))
        watch_library(own, str(tmp_path / f"c{size}"), build_index=False, bytes_per_batch=size).awaitTermination()
        assert own.count() == 3 and len(own._books.complete()) == runs


def test_documents_of_a_table_in_one_file_are_written_by_many_tasks(spark):
    from shelfmark.plans.views import TableViews

    docs = TableViews(spark, "/root/testdata/sf0.001").part_documents()
    assert docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_authors_are_expanded_from_one_parse_after_the_documents_are_spread(spark):
    from shelfmark.plans.queries import REGISTRY

    rows = REGISTRY["p10_author_expansion"][0](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1


def test_lists_of_names_are_made_by_more_tasks_than_their_bytes_ask_for(spark):
    from shelfmark.operators import relations
    from shelfmark.plans.views import TableViews

    views = TableViews(spark, "/root/testdata/sf0.001")
    books, links, authors = views.part_books(), views.part_links(), views.part_authors()
    ids = views.table("lineitem").select("l_partkey")
    manifest = relations.export_manifest(books, links, authors, views.part_archives(), ids)
    listed = relations.authors_per_book(links, authors)
    for rows in (manifest, listed):
        assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_every_hit_is_made_once_before_its_sort(spark, capsys):
    rows = spark.createDataFrame([(n, float(n % 3)) for n in range(9)], "id long, score double")
    sorted_rows = search.top_by_score(rows, None)
    assert [(r.score, r.id) for r in sorted_rows.collect()] == [(s, n) for s in (2.0, 1.0, 0.0) for n in range(9) if n % 3 == s]
    sorted_rows.explain()
    assert "hashpartitioning(id" in capsys.readouterr().out
