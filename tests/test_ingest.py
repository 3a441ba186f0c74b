from __future__ import annotations

import zipfile

from builders import book, write_zip
from pyspark.sql import functions as F

from shelfmark.operators.filters import Filters
from shelfmark.plans.catalog import Catalog
from shelfmark.sources import archives as arc
from shelfmark.streaming.watch import watch_library


def titles(frame):
    return sorted(row.title for row in frame.collect())


def statuses(catalog):
    return {row.name: row.status for row in catalog.archive_table().collect()}


def violations(catalog):
    return {row.check: row.violations for row in catalog.check().collect() if row.violations}


def two_archives(library):
    write_zip(library / "a.zip", {"1.fb2": book("War and Peace", "Leo", "Tolstoy", "ru"), "2.fb2": book("Book Two", "Ann", "Lee")})
    write_zip(library / "b.zip", {"3.fb2": book("War Stories", "Bob", "Ray"), "4.fb2": book("Quiet", "Leo", "Tolstoy")})


def test_discovery_and_entries(spark, library):
    write_zip(library / "a.zip", {"1.fb2": "x", "2.FB2": "yy", "notes.txt": "z", "dir/5.fb2": "q", ".fb2": "h"})
    (library / "broken.zip").write_bytes(b"no archive at all")
    (library / "UPPER.ZIP").write_bytes(b"")
    found = arc.list_archives(spark, str(library))
    assert sorted(r.name for r in found.collect()) == ["a.zip", "broken.zip"]
    entries = arc.list_entries(found).collect()
    assert sorted(r.entry for r in entries if r.entry) == ["1.fb2", "2.FB2", "dir/5.fb2"]
    assert [r.archive for r in entries if r.error] == ["broken.zip"]
    counted = {r.archive: r.entries for r in arc.count_entries(found).collect()}
    assert counted == {"a.zip": 3, "broken.zip": 0}


def test_entries_are_split_into_slices_and_read_whole(spark, library):
    texts = {f"{i}.fb2": bytes((i * 37 + j) % 256 for j in range(5000)) for i in range(1, 60)}
    write_zip(library / "stored.zip", texts, zipfile.ZIP_STORED)
    write_zip(library / "bzip.zip", texts, zipfile.ZIP_BZIP2)
    (library / "shifted.zip").write_bytes(b"leading bytes" + (library / "stored.zip").read_bytes())
    entries = arc.list_entries(arc.list_archives(spark, str(library)), slice_bytes=20_000)
    assert entries.filter("archive = 'stored.zip'").select("slice").distinct().count() > 10
    rows = arc.read_entries(entries, "content", 16).collect()
    assert len(rows) == 3 * 59 and all(r.error is None for r in rows)
    assert all(bytes(r.content) == texts[r.entry] for r in rows)


def test_damaged_entries_are_reported(spark, library):
    write_zip(library / "a.zip", {"1.fb2": "x" * 4000, "2.fb2": "fine"}, zipfile.ZIP_STORED)
    raw = bytearray((library / "a.zip").read_bytes())
    raw[500] ^= 0xFF
    (library / "a.zip").write_bytes(raw)
    read = arc.read_entries(arc.list_entries(arc.list_archives(spark, str(library))), "text")
    found = {r.entry: (r.text, r.error) for r in read.collect()}
    assert found == {"1.fb2": (None, "checksum mismatch"), "2.fb2": ("fine", None)}


def test_ingest_search_and_health(catalog, library):
    two_archives(library)
    (library / "broken.zip").write_bytes(b"garbage")
    catalog.ingest("full")
    assert catalog.count() == 4
    assert statuses(catalog) == {"a.zip": "indexed", "b.zip": "indexed"}
    assert titles(catalog.search("War", Filters(lang="ru"))) == ["War and Peace"]
    assert titles(catalog.search("war tolstoy")) == ["Quiet", "War Stories", "War and Peace"]
    assert titles(catalog.search("", Filters(authors="leo"))) == ["Quiet", "War and Peace"]
    first = catalog.search("").first()
    assert (first.title, first.genres, first.sequence, first.score) == ("Book Two", ["travel"], "Coasts 7", 0.0)
    assert first.authors[0].first_name == "Ann"
    health = catalog.health().first()
    assert (health.archives_indexed, health.archives_new, health.total_books) == (2, 1, 4)
    assert health.search_index_valid and health.needs_resume
    assert {r.name: r.status for r in catalog.archives().collect()}["broken.zip"] == "new"
    assert {(r.lang, r["count"]) for r in catalog.facet("lang").collect()} == {("en", 3), ("ru", 1)}
    assert violations(catalog) == {}


def test_incremental_resume_and_replace(catalog, library):
    two_archives(library)
    catalog.ingest("new", build_index=False)
    before = catalog.books().orderBy("id").collect()
    catalog.ingest("new", build_index=False)
    catalog.ingest("full", build_index=False)
    assert catalog.books().orderBy("id").collect() == before
    write_zip(library / "a.zip", {"2.fb2": book("Changed", "Ann", "Lee"), "9.fb2": book("Added")})
    catalog.ingest("new", build_index=False)
    assert "Changed" not in titles(catalog.books())
    catalog.mark(catalog.archive_table().filter("name = 'a.zip'").select("name"), "indexing")
    # While an archive is being redone its former rows stay readable.
    assert catalog.count() == 4 and statuses(catalog)["a.zip"] == "indexing"
    catalog.ingest("new")
    assert titles(catalog.books()) == ["Added", "Changed", "Quiet", "War Stories"]
    assert statuses(catalog) == {"a.zip": "indexed", "b.zip": "indexed"}
    assert violations(catalog) == {}
    assert titles(catalog.search("changed")) == ["Changed"]


def test_half_written_run_is_not_seen(catalog, library, monkeypatch):
    two_archives(library)
    catalog.ingest("new", build_index=False)
    write_zip(library / "a.zip", {"7.fb2": book("Later", "Zed", "Z")})

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(Catalog, "_commit", crash)
    try:
        catalog.ingest("full", build_index=False)
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert catalog.count() == 4 and "Later" not in titles(catalog.books())
    assert set(statuses(catalog).values()) == {"indexing"}
    catalog.ingest("new", build_index=False)
    assert titles(catalog.books()) == ["Later", "Quiet", "War Stories"]
    assert sorted(r.first_name for r in catalog.authors().collect()) == ["Bob", "Leo", "Zed"]


def test_pick_also_reads_unknown_archives_unless_strict(catalog, library):
    two_archives(library)
    catalog.ingest("pick", ["a.zip"], strict=True, build_index=False)
    assert statuses(catalog) == {"a.zip": "indexed"}
    catalog.ingest("pick", ["a.zip"], build_index=False)
    assert statuses(catalog) == {"a.zip": "indexed", "b.zip": "indexed"}
    write_zip(library / "b.zip", {"3.fb2": book("Renamed")})
    catalog.ingest("b.zip", build_index=False)
    assert "Renamed" in titles(catalog.books())


def test_emptied_archive_and_log(catalog, library):
    two_archives(library)
    catalog.ingest("new", build_index=False)
    write_zip(library / "a.zip", {"x.fb2": book("No Id"), "5.fb2": "", "6.fb2": "<description></description>"})
    catalog.ingest("a.zip", build_index=False)
    assert titles(catalog.books()) == ["Quiet", "War Stories"]
    assert statuses(catalog)["a.zip"] == "indexed"
    warned = {(r.entry, r.message) for r in catalog.log().filter("level = 'warn'").collect()}
    assert warned == {
        ("x.fb2", "no book id in the entry name"),
        ("5.fb2", "empty entry"),
        ("6.fb2", "no title-info"),
        (None, "no valid book"),
    }


def test_one_id_in_two_archives(catalog, library):
    write_zip(library / "a.zip", {"1.fb2": book("From A", "Ann", "A"), "2.fb2": book("Only A")})
    catalog.ingest("new", build_index=False)
    write_zip(library / "b.zip", {"1.fb2": book("From B", "Bob", "B")})
    catalog.ingest("new", build_index=False)
    assert titles(catalog.books()) == ["From B", "Only A"]
    assert [r.authors[0].first_name for r in catalog.search("", Filters(title="From B")).collect()] == ["Bob"]
    assert violations(catalog) == {}


def test_given_author_ids_keep_their_first_name(catalog, library):
    given = lambda name: f"<author><first-name>{name}</first-name><id>same</id></author>"
    write_zip(library / "a.zip", {"1.fb2": book("One", extra=given("First"))})
    write_zip(library / "b.zip", {"2.fb2": book("Two", extra=given("Second"))})
    catalog.ingest("pick", ["a.zip"], strict=True, build_index=False)
    catalog.ingest("new", build_index=False)
    names = {r.id: r.first_name for r in catalog.authors().collect()}
    assert names["same"] == "First"
    # Once no other archive links to the id, its next owner names it.
    write_zip(library / "a.zip", {"1.fb2": book("One")})
    catalog.ingest("a.zip", build_index=False)
    catalog.ingest("b.zip", build_index=False)
    assert {r.id: r.first_name for r in catalog.authors().collect()}["same"] == "Second"


def test_stream_indexes_each_archive_once(catalog, library, tmp_path):
    two_archives(library)

    def run():
        stream = watch_library(catalog, str(tmp_path / "checkpoint"), archives_per_batch=1, build_index=False)
        stream.awaitTermination(120)
        assert stream.exception() is None

    run()
    assert catalog.count() == 4
    write_zip(library / "0-early.zip", {"8.fb2": book("Early Name")})
    run()
    assert catalog.count() == 5 and len(catalog.archive_table().filter("status = 'indexed'").collect()) == 3
    assert catalog.archive_table().agg(F.count_distinct("batch")).first()[0] == 3


def test_index_versions_and_validity(catalog, library):
    two_archives(library)
    catalog.ingest("new", build_index=False)
    assert not catalog.health().first().search_index_valid
    # The first query builds the missing index.
    assert titles(catalog.search("quiet")) == ["Quiet"]
    assert catalog.health().first().search_index_valid
    # A newer index that was not finished changes nothing.
    catalog._search_docs.write(catalog.search_docs().filter("id = 1"), 2)
    catalog._postings.write(catalog._postings.read(1).filter("doc_id = 1"), 2)
    assert titles(catalog.search("quiet")) == ["Quiet"] and catalog.search_docs().count() == 4
    write_zip(library / "b.zip", {"3.fb2": book("Loud")})
    catalog.ingest("b.zip", build_index=False)
    assert not catalog.health().first().search_index_valid
    catalog.ingest("search")
    assert titles(catalog.search("quiet")) == [] and titles(catalog.search("loud")) == ["Loud"]
    assert catalog.health().first().search_index_valid


def test_search_of_an_empty_catalog(catalog, library):
    catalog.ingest("new")
    assert catalog.count() == 0 and catalog.search("").collect() == [] and catalog.search("word").collect() == []
    health = catalog.health().first()
    assert health.search_index_valid and not health.needs_resume and catalog.facet("lang").collect() == []


def test_one_archive_with_most_books(spark, catalog, library, monkeypatch):
    """A hot archive is split into slices and counts stay whole."""
    monkeypatch.setattr(arc, "SLICE_BYTES", 4096)
    write_zip(library / "hot.zip", {f"{i}.fb2": book(f"Hot {i}", "Same", "Author") for i in range(1, 301)})
    write_zip(library / "cold.zip", {"900.fb2": book("Cold", "Same", "Author")})
    assert arc.list_entries(arc.list_archives(spark, str(library)), 4096).select("slice").distinct().count() > 5
    catalog.ingest("new", build_index=False)
    assert catalog.count() == 301 and catalog.links().count() == 301
    assert titles(catalog.search("", Filters(title="=Hot 7"))) == ["Hot 7"]


def test_storage_faults_keep_an_archive_and_its_turn(catalog, library, monkeypatch):
    two_archives(library)
    catalog.ingest("full")
    before = titles(catalog.search(""))
    listing = arc.list_entries

    def vanished(*args, **kwargs):
        gone = F.when((F.col("archive") == "a.zip") | (F.col("entry") == "3.fb2"), F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
        return listing(*args, **kwargs).withColumn("path", gone)

    monkeypatch.setattr(arc, "list_entries", vanished)
    catalog.ingest("full")
    assert titles(catalog.search("")) == before and len(before) == 4
    assert statuses(catalog) == {"a.zip": "indexing", "b.zip": "indexing"}
    monkeypatch.undo()
    catalog.ingest("new")
    assert titles(catalog.search("")) == before and statuses(catalog) == {"a.zip": "indexed", "b.zip": "indexed"}
