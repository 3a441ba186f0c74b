from __future__ import annotations

import pytest
from builders import book
from pyspark.sql import functions as F

from shelfmark.functions import fields, markup, naming, text
from shelfmark.operators import filters as flt
from shelfmark.operators import search
from shelfmark.plans import ingest
from shelfmark.sources import decode
from shelfmark.sources.archives import UnknownStore, _description, _open

DOCUMENT_DATE = "<document-info><date>15.03.2020</date></document-info>"
YEAR = "<publish-info><year>2020</year></publish-info>"


def info(body: str) -> str:
    return f"<title-info><genre>science</genre>{body}</title-info>"


# name -> (document text, expected title, date, sequence, authors, reason)
DOCUMENTS = {
    "stray text between names": (
        "<description>" + info("<author><first-name>Ada</first-name>stray<last-name>Lee</last-name></author><book-title>T</book-title>")
        + DOCUMENT_DATE + "</description><body><p>open",
        "T", "15.03.2020", "", [("Ada", "Lee")], None,
    ),
    "several first names": (
        "<description>" + info(
            "<author><first-name>A</first-name><last-name>X</last-name><first-name>B</first-name></author>"
            "<author><first-name></first-name><first-name> C </first-name><last-name>Y</last-name></author><book-title>T</book-title>"
        ) + DOCUMENT_DATE + "</description>",
        "T", "15.03.2020", "", [("A", "X"), ("B", None), ("C", "Y")], None,
    ),
    "two titles apart, second title-info": (
        "<description>" + info("<book-title>One</book-title><lang>en</lang><book-title>Two</book-title>")
        + "<title-info><book-title>Wrong</book-title></title-info>" + DOCUMENT_DATE + YEAR + "</description>",
        "One Two", "2020", "", [], None,
    ),
    "second title-info without title": (
        "<description>" + info("<book-title>One</book-title>") + "<title-info><lang>ru</lang></title-info></description>",
        "One", "", "", [], None,
    ),
    "title date beats the others": (
        "<description>" + info("<book-title lang='x'>T &amp; U</book-title><date>1999</date><date>2001</date>") + YEAR + "</description>",
        "T & U", "2001", "", [], None,
    ),
    "empty last title date": (
        "<description>" + info("<book-title>T</book-title><date>1999</date><date/>") + YEAR + DOCUMENT_DATE + "</description>",
        "T", "2020", "", [], None,
    ),
    "nested series": (
        "<description>" + info(
            "<book-title>T</book-title><sequence name='Parent' number='1'><sequence name='Child' number='2'/></sequence><sequence name='Other'/>"
        ) + "</description>",
        "T", "", "Parent 1, Child 2, Other", [], None,
    ),
    "deep series": (
        "<description>" + info(
            "<book-title>T</book-title><!-- <sequence name='no'/> --><sequence name='A &amp; &#1041;' number='1'><sequence number='2' name=\"it's > C\">"
            "<sequence name='D'><sequence name='E'><sequence name='F' number='5' /></sequence></sequence></sequence></sequence>"
        ) + "<title-info><book-title>x</book-title><sequence name='late'/></title-info></description>",
        "T", "", "A & Б 1, it's > C 2, D, E, F 5", [], None,
    ),
    "nameless author": ("<description>" + info("<author><id>7</id></author><book-title>T</book-title>") + "</description>", "T", "", "", [(None, None)], None),
    "no description": ("<FictionBook><body/></FictionBook>", "Unknown", "", "", [], None),
    "unclosed description": ("<FictionBook><description><title-info><book-title>B</book-title></title-info>", "Unknown", "", "", [], None),
    "empty description": ("<description></description>", None, None, None, None, "no title-info"),
    "no title at all": ("<description><title-info><lang>en</lang></title-info></description>", None, None, None, None, "no title-info has a book-title"),
    "broken markup": ("<description><title-info><book-title>T</title-info></description>", None, None, None, None, "malformed metadata"),
}


def test_documents_become_books(spark):
    frame = spark.createDataFrame([(name, case[0]) for name, case in DOCUMENTS.items()], "name string, text string")
    parsed = frame.select("name", fields.description_slice(F.col("text")).alias("block")).withColumn("d", fields.parse_description(F.col("block")))
    columns = [column.alias(name) for name, column in fields.book_columns(F.col("d"), F.col("block")).items()]
    for row in parsed.select("name", *columns, fields.reject_reason(F.col("d")).alias("reason")).collect():
        _, title, date, sequence, authors, reason = DOCUMENTS[row.name]
        assert row.reason == reason, row.name
        if reason is None:
            people = [(a.first_name, a.last_name) for a in row.authors]
            assert (row.title, row.date, row.sequence, people) == (title, date, sequence, authors), row.name


def test_series_are_cut_as_written_and_only_blocks_with_comments_are_rewritten(spark):
    cases = {
        r'<sequence name="A $1 \\1" number="2"/><sequence name="B"/>': r"A $1 \\1 2, B",
        '<!-- <sequence name="no"/> --><sequence name="C" number="$2"/>': "C $2",
        '<![CDATA[<sequence name="no"/>]]><sequence name="D &amp; E"/>': "D & E",
    }
    blocks = [(f"<description><title-info>{tags}</title-info></description>", want) for tags, want in cases.items()]
    rows = spark.createDataFrame(blocks, "block string, want string").select(fields.sequence_text(F.col("block")).alias("got"), "want")
    assert all(row.got == row.want for row in rows.collect())
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN Contains(block" in plan


@pytest.mark.parametrize(
    "raw",
    [
        b"\xef\xbb\xbf" + "Тест é".encode(),
        b"\xff\xfe" + "Тест é".encode("utf-16-le"),
        b"\xfe\xff" + "Тест é".encode("utf-16-be"),
        "Тест é".encode(),
    ],
)
def test_unicode_encodings(raw):
    assert decode.to_text(raw) == "Тест é"


def test_legacy_encodings():
    assert decode.to_text("Тест".encode("cp1251")) == "Тест"
    declared = '<?xml version="1.0" encoding="koi8-r"?><a>Тест</a>'
    assert decode.to_text(declared.encode("koi8-r")) == declared
    assert decode.to_text(b"") == "" and decode.to_text(b"plain") == "plain"
    late = b"a" * 5000 + "é".encode() * 3000 + b"\xff"
    assert decode.to_text(late[4000:]).endswith("�") and decode.to_text(late)[5000:5003] == "ééé"
    assert decode.to_text(("Тест, ещё" * 600).encode("cp1251")) == "Тест, ещё" * 600
    legacy = '<?xml version="1.0" encoding="windows-1251"?><FictionBook><description>Тест</description>'.encode("cp1251")
    assert _description(iter([legacy[:40], legacy[40:]])) == "<description>Тест</description>"
    wide = b"\xff\xfe" + "<FictionBook><description>Тест</description>".encode("utf-16-le")
    assert _description(iter([wide])) == "<description>Тест</description>"


def test_stores(tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "c #1%.zip").write_bytes(b"x")
    for path in (f"file:{tmp_path}/a b/c #1%.zip", f"{tmp_path}/a b/c #1%.zip"):
        with _open(path) as file:
            assert file.read() == b"x"
    with pytest.raises(UnknownStore):
        _open("nowhere://host/a b.zip")


def test_russian_stems(spark):
    """Pairs published with the algorithm."""
    pairs = {
        "вагон": "вагон", "вагона": "вагон", "вагонами": "вагон", "важнейшими": "важн", "валил": "вал",
        "валившись": "вал", "вальяжность": "вальяжн", "варенья": "варен", "вдохновенно": "вдохновен",
        "падают": "пада", "палочки": "палочк", "памятью": "памят", "пальмовых": "пальмов", "панталоны": "панталон",
        "books": "books", "ёлка": "елк", "впрск": "впрск",
    }
    frame = spark.createDataFrame([(word, word) for word in pairs], "word string, stem string")
    got = {row.word: row.stem for row in text.stem_russian(frame, "stem").collect()}
    assert got == pairs


def test_file_names(spark):
    authors = ["", "Джек Джон", "Ann, Lee", "Очень Длинный, " * 31, "x" * 300]
    titles = ["T", "Название книги", "Название, длинное название, " * 12, "y" * 243, "y" * 244, "y" * 600, "жы" * 61, "z" * 238, "z" * 239]
    rows = [(a, t, i) for i, (a, t) in enumerate((a, t) for a in authors for t in titles)]
    frame = spark.createDataFrame(rows, "author string, title string, id long")
    named = naming.with_file_name(frame, F.col("author"), F.col("title"), F.col("id"))
    for row in named.collect():
        suffix = f" [{row.id}].fb2"
        assert len(row.file_name.encode()) <= 255 and row.file_name.endswith(suffix)
        stem = row.file_name.removesuffix(suffix)
        whole = f"{row.author} - {row.title}" if row.author else row.title
        if len((whole + suffix).encode()) <= 255:
            assert stem == whole
            continue
        # What was cut is a beginning with dots, and no further character fits.
        author, mark, title = stem.rpartition(" - ")
        for part, full in ((author, row.author), (title, row.title)):
            assert full.startswith(part.removesuffix("...")) and (part in ("", full) or part.endswith("..."))
        assert len(row.file_name.encode()) > 255 - 8 or title == row.title
        if mark and author != row.author and title != row.title:
            assert abs(len(author.encode()) - len(title.encode())) < 12
    odd = spark.createDataFrame([(" A ,B ",), (None,)], "a string").select(naming.normalized_author(F.col("a")).alias("a"))
    assert [r.a for r in odd.collect()] == ["A, B", ""]


def test_markup(spark):
    cases = {
        "<annotation lang='en'>\n<p>On <em>maps</em>.</p>x<p style='a'> On seas. </p></annotation><annotation><p>no</p></annotation>": "On maps.\n\nOn seas.",
        "<annotation>Half a <strong>line</strong>\n</annotation>": "Half a line",
        "<annotation><p> </p>left<p/></annotation>": "left",
        "<annotation>\t</annotation>": None,
        "<annotation><p>open": None,
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.a for r in frame.select("t", markup.annotation(F.col("t")).alias("a")).collect()}
    assert got == cases
    page = '<coverpage><image href = "#{0}"/></coverpage>'
    blocks = '<binary id="a" content-type="image/png">AQ\nID</binary><binary id="b" content-type="x">!!!</binary>'
    texts = [page.format("a") + blocks, page.format("b") + blocks, page.format("c") + blocks, blocks]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    block = markup.cover_block(F.col("t"), markup.cover_reference(F.col("t")))
    rows = frame.select("i", markup.cover_data(block).alias("d")).orderBy("i").collect()
    assert [r.d and bytes(r.d) for r in rows] == [b"\x01\x02\x03", None, None, None]
    other = "<coverpage><image l:href='#z'/></coverpage><binary id='y' content-type='i/q'>AAAA</binary><binary\ncontent-type='i/p' id='z'>AQID</binary>"
    one = spark.createDataFrame([(other,)], "t string").select(block.alias("b"))
    got = one.select(markup.cover_type(F.col("b")).alias("c"), markup.cover_data(F.col("b")).alias("d")).first()
    assert (got.c, bytes(got.d)) == ("i/p", b"\x01\x02\x03")


def test_filter_grammar():
    assert flt.parse_value("  =War ") == (True, "War") and flt.parse_value("=") == (True, "") and flt.parse_value(None) == (False, "")
    sizes = {
        ">=3 Mb": (">=", 3145728), "<2GB": ("<", 2147483648), ">40k": (">", 40960), "<=0.25m": ("<=", 262144),
        "17": None, "<5tb": None, "<=": None, ">1.2.3": None, " ": None, "< 7 B": ("<", 7), ">.5K": (">", 512), ">=9e9": None,
    }
    assert {raw: flt.parse_size(raw) for raw in sizes} == sizes
    assert flt.Filters(title=" ").is_empty() and flt.column_condition(flt.Filters(title="=", lang=" ")) is None


def test_filters_with_special_characters(spark):
    frame = spark.createDataFrame([("a\\b", ""), ("100%", "en"), ("a_b", "ru"), ("axb", "EN")], "title string, lang string")
    hits = lambda **f: sorted(r.title for r in flt.apply_filters(frame, flt.Filters(**f)).collect())
    assert hits(title="a\\b") == ["a\\b"]
    assert hits(title="=a_b") == ["a\\b", "a_b", "axb"]
    assert hits(lang="en|") == ["100%", "a\\b", "axb"] and hits(lang="|") == ["a\\b"]
    assert hits(title=" ", lang="=RU") == ["a_b"]


def test_modes(spark):
    disk = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    known = spark.createDataFrame([("a", "indexed"), ("b", "indexing")], "name string, status string")
    chosen = lambda *args, **kw: sorted(r.name for r in ingest.choose_archives(disk, known, *args, **kw).collect())
    assert chosen("full") == ["a", "b", "c"] and chosen("new") == ["b", "c"]
    assert chosen("pick", ["a"]) == ["a", "c"] and chosen("a") == ["a", "c"] and chosen("pick", ["a"], strict=True) == ["a"]


def test_scores_by_hand(spark):
    import math

    docs = {1: "red red fox", 2: "fox den", 3: "blue", 4: "Красные книги"}
    frame = spark.createDataFrame(list(docs.items()), "id long, text string")
    lengths = {i: len(t.split()) for i, t in docs.items()}
    average = sum(lengths.values()) / 4

    def score(i: int, words: list[str]) -> float:
        total = 0.0
        for word in words:
            tf, df = docs[i].split().count(word), sum(word in t.split() for t in docs.values())
            total += math.log10((4 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[i] / average))
        return total

    for rank in (search.rank_documents, search.rank_by_scan):
        got = {r.id: r.score for r in rank(frame, ["red", "fox"], ["text"]).collect()}
        assert got == pytest.approx({1: score(1, ["red", "fox"]), 2: score(2, ["fox"])})
    terms = search.query_terms(spark, "Книга красная", stem=True)
    assert [r.id for r in search.rank_documents(frame, terms, ["text"], stem=True).collect()] == [4]


def test_fixture_builder_is_valid(spark):
    parsed = spark.createDataFrame([(book("T", "A", "B"),)], "t string").select(
        fields.parse_description(fields.description_slice(F.col("t"))).alias("d")
    )
    assert parsed.select(fields.reject_reason(F.col("d")).alias("r")).first().r is None


def test_legacy_charsets_are_told_by_their_pairs_of_bytes():
    russian = ("Привет, мир!", "Война и мир. Том первый", "ЁЛКА И ЕЖ", "Ещё раз: Анна Каренина, часть 2")
    for text_ in russian:
        for charset in ("cp1251", "koi8_r", "cp866"):
            assert decode.to_text(text_.encode(charset)) == text_, charset
    for text_ in ("Grüße aus Köln", "le café à côté", "El niño y la señora"):
        assert decode.to_text(text_.encode("cp1252")) == text_
    # The whole buffer counts, not its head; a declaration goes before a guess.
    late = "plain ascii, " * 5000 + "Анна Каренина"
    assert decode.to_text(late.encode("koi8_r")) == late and decode.detect(late.encode("cp866")) == "cp866"
    assert decode.to_text('<?xml version="1.0" encoding="windows-1251"?>ТЁЩ'.encode("cp1251")).endswith("ТЁЩ")


def test_legacy_charsets_of_capitals_and_of_repeated_accents():
    capitals = "ИТЕНЕР!! ЕРРОЕРОТ!! НТЫСЕОА!! НТТЕ.!! ОВИТУРСЕ!! ТЕСР!! УНЕР!! ЕРСЕ!!"
    assert decode.to_text(capitals.encode("cp1251")) == capitals
    for accents in ("Et de le que " * 20 + "è " * 400, "Anaieux éé èçou éç.", "La é le de de.", "Èêenvi ç un queon ouou èèêé."):
        assert decode.to_text(accents.encode("cp1252")) == accents


def test_capitals_keep_the_number_of_characters(spark):
    words = ["Straße ﬁn", "plain", "", "ᾀ ǰ", None]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in frame.select(text.upper(F.col("w"))).collect()] == ["STRAẞE ﬁN", "PLAIN", "", "ᾈ ǰ", None]
