from __future__ import annotations

import zipfile
from pathlib import Path

from builders import book, write_zip

from shelfmark.operators.filters import Filters
from shelfmark.sources.synthetic import synthetic_books, write_synthetic_archives

COVER = (
    '<binary id="other" content-type="image/gif">QUJD</binary>'
    '<binary id="c.png" content-type="image/png">\n SGVs\n bG8=\n</binary>'
)


def filled(catalog, library):
    extra = '<coverpage><image l:href="#c.png"/></coverpage><annotation><p>First <b>one</b></p><p> </p><p>Second</p></annotation>'
    write_zip(library / "a.zip", {"1.fb2": book("With Cover", "Ann", "Lee", extra=extra, tail=COVER), "2.fb2": book("Plain")})
    write_zip(library / "b.zip", {"3.fb2": book("A/B", "Bob", "Ray")})
    catalog.ingest("full", build_index=False)


def test_covers_and_annotations(catalog, library):
    filled(catalog, library)
    assert [(r.id, r.cover_type, bytes(r.cover_data)) for r in catalog.covers().collect()] == [(1, "image/png", b"Hello")]
    assert [(r.id, r.annotation) for r in catalog.annotations([1, 2]).collect()] == [(1, "First one\n\nSecond")]


def test_export_writes_files_and_manifest(catalog, library, tmp_path):
    filled(catalog, library)
    out = tmp_path / "out"
    manifest = {r.id: r for r in catalog.export([1, 3, 99], str(out)).collect()}
    assert sorted(manifest) == [1, 3]
    assert sorted(p.name for p in out.iterdir()) == ["Ann Lee - With Cover [1].fb2", "Bob Ray - A_B [3].fb2"]
    assert Path(manifest[3].output_path).read_text() == book("A/B", "Bob", "Ray")
    assert (manifest[3].title, manifest[3].author) == ("A/B", "Bob Ray")
    assert catalog.export([], str(out)).count() == 0


def test_export_skips_what_is_gone(catalog, library, tmp_path):
    filled(catalog, library)
    (library / "b.zip").unlink()
    write_zip(library / "a.zip", {"2.fb2": book("Plain")})
    assert [r.id for r in catalog.contents().collect()] == [2]


def test_bundles_hold_every_book(catalog, library, tmp_path):
    filled(catalog, library)
    rows = catalog.export_bundles([1, 2, 3], str(tmp_path / "bundles"), per_bundle=1).collect()
    assert sorted(r.id for r in rows) == [1, 2, 3]
    inside = {(p.name, n) for p in (tmp_path / "bundles").glob("*.zip") for n in zipfile.ZipFile(p).namelist()}
    assert inside == {(Path(r.bundle).name, r.file_name) for r in rows}


def test_synthetic_library(spark, catalog, library):
    write_synthetic_archives(spark, str(library), 3, 40, seed=7).count()
    catalog.ingest("new")
    assert catalog.count() == 120
    made = {r.id: r for r in synthetic_books(spark, 3, 40, seed=7).collect()}
    read = {r.id: r for r in catalog.search("", limit=200).collect()}
    assert sorted(read) == list(range(1, 121))
    for number, row in read.items():
        source = made[number]
        assert (row.title, row.genres, row.date) == (source.title, [source.genre], source.date)
        assert [(a.first_name, a.last_name) for a in row.authors] == [(a.first_name, a.last_name) for a in source.authors]
        assert row.sequence == (f"{source.series.name} {source.series.number}" if source.series else "")
    again = {r.id: r for r in synthetic_books(spark, 3, 40, seed=7).collect()}
    assert again == made
    noun = made[1].title.split()[-1]
    expected = sum(noun in row.title.split() for row in made.values())
    assert catalog.search(noun.upper(), Filters(title=noun)).count() == expected
