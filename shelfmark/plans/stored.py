"""Named queries through a stored library: archives are written from the tables, ingested, searched and exported."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import fields
from shelfmark.operators.filters import Filters
from shelfmark.plans.catalog import Catalog
from shelfmark.plans.queries import RELATIONS, query
from shelfmark.plans.views import TableViews
from shelfmark.sources import archives as arc
from shelfmark.sources import export
from shelfmark.sources.reader import read_archives
from shelfmark.streaming.watch import watch_library

# Books of an archive at most.
PER_ARCHIVE = 500

# The documents of the views, with the archive each lies in, as SQL.
_TITLE = "array_to_string(string_split(p_name, ' ')[1:2], ' ')"
RELATIONS["part_docs"] = """SELECT p_partkey AS id, replace(p_brand, '#', '-') || '-' || (p_partkey // 500) || '.zip' AS archive,
    '<?xml version="1.0"?><FictionBook xmlns:l="x"><description><title-info><genre>' || p_type || '</genre><genre>' || split_part(p_name, ' ', 1)
    || '</genre><genre>' || p_type || '</genre>'
    || CASE WHEN p_size % 5 <> 0 THEN '<author><first-name> ' || split_part(p_name, ' ', 1) || '</first-name><first-name></first-name><first-name>'
        || split_part(p_name, ' ', 2) || '</first-name><last-name>' || p_brand || '</last-name></author>' ELSE '' END
    || CASE WHEN p_size % 4 = 0 THEN '<author><nickname>' || p_type || '</nickname><id>' || p_type || '</id></author>' ELSE '' END
    || '<book-title>' || split_part(p_name, ' ', 1) || '</book-title>' || CASE WHEN p_size % 3 = 0 THEN '<date>' || (p_size + 1950) || '</date>' ELSE '' END
    || '<lang>' || lower(p_type) || '</lang><book-title>' || split_part(p_name, ' ', 2) || '</book-title><sequence name="' || p_brand || '" number="' || p_size
    || '"><sequence name="' || p_type || '"><sequence number="3" name="Third"><sequence name="Fourth"><sequence name="A &amp; &#x42;" number="5"/>'
    || '</sequence></sequence></sequence></sequence><coverpage><image l:href="#img' || (p_partkey % 2) || '"/></coverpage></title-info>'
    || CASE WHEN p_size % 2 = 0 THEN '<publish-info><year>' || (p_size + 1900) || '</year></publish-info>' ELSE '' END
    || CASE WHEN p_size % 7 <> 0 THEN '<document-info><date>01.02.' || p_size || '</date></document-info>' ELSE '' END
    || '</description><body><p>text</p></body><binary id="img0" content-type="image/x0">' || chr(10) || '  ' || base64(encode(p_name)) || chr(10)
    || '</binary><binary id="img1" content-type="image/x1">' || chr(10) || '  ' || CASE WHEN p_size % 11 = 0 THEN '!bad' ELSE base64(encode(p_name)) END
    || chr(10) || '</binary></FictionBook>' AS text FROM part"""
# Every fiftieth book has a twin that is none: one without an id in its name, or without metadata.
RELATIONS["all_docs"] = """SELECT archive, id || '.fb2' AS entry, text FROM part_docs
    UNION ALL SELECT archive, CASE WHEN id % 100 = 0 THEN 'copy of ' || id || '.fb2' ELSE (id + 100000000) || '.fb2' END,
    CASE WHEN id % 100 = 0 THEN text ELSE '<description></description>' END FROM part_docs WHERE id % 50 = 0"""
RELATIONS["stored_books"] = f"""SELECT p_partkey AS id, {_TITLE} AS title,
    CASE WHEN p_type = split_part(p_name, ' ', 1) THEN p_type ELSE p_type || '|' || split_part(p_name, ' ', 1) END AS genres,
    CASE WHEN p_size % 3 = 0 THEN CAST(1950 + p_size AS VARCHAR) WHEN p_size % 2 = 0 THEN CAST(1900 + p_size AS VARCHAR)
        WHEN p_size % 7 <> 0 THEN '01.02.' || p_size ELSE '' END AS date, lower(p_type) AS lang, strlen(text)::BIGINT AS file_size,
    p_brand || ' ' || p_size || ', ' || p_type || ', Third 3, Fourth, A & B 5' AS sequence, archive,
    nullif(array_to_string(CASE WHEN p_size % 5 <> 0 THEN [split_part(p_name, ' ', 1) || ' ' || p_brand || ' ', split_part(p_name, ' ', 2) || ' '] ELSE [] END
        || CASE WHEN p_size % 4 = 0 THEN [' (' || p_type || ')'] ELSE [] END, ','), '') AS authors_text
    FROM part JOIN part_docs ON id = p_partkey"""
_NAMED = """SELECT stored_books.id, title, replace(trim(coalesce(authors_text, '')), ' ,', ', ') AS author, archive,
    CASE WHEN authors_text IS NULL THEN '' ELSE replace(trim(authors_text), ' ,', ', ') || ' - ' END || title || ' [' || stored_books.id || '].fb2' AS file_name
    FROM stored_books"""
_USED = "part_docs all_docs stored_books"


@dataclass
class Shelf:
    """A library folder with its catalog, how its archives stood after the first of two runs, and that run's number."""

    library: str
    catalog: Catalog
    between: DataFrame
    first: int


_libraries: dict[tuple[str, str], str] = {}
_shelves: dict[tuple[str, str], Shelf] = {}


def _work(spark: SparkSession) -> str:
    """A new folder in `spark.checkpoint.dir`, or of this machine on a local master without one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return f"{given.rstrip('/')}/shelfmark/{uuid.uuid4().hex}" if given else tempfile.mkdtemp(prefix="shelfmark-")


def write_library(spark: SparkSession, folder: str, library: str) -> None:
    """The documents of the parts as archives of PER_ARCHIVE books at most, with some entries that are no books."""
    archive = F.concat(
        F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("-"), F.floor(F.col("p_partkey") / PER_ARCHIVE).cast("string"), F.lit(".zip")
    )
    docs = TableViews(spark, folder).part_documents(archive.alias("archive"))
    name = F.concat(F.col("id").cast("string"), F.lit(".fb2"))
    nameless = F.col("id") % 100 == 0
    twins = F.when(
        F.col("id") % 50 == 0,
        F.struct(
            F.when(nameless, F.concat(F.lit("copy of "), name)).otherwise(F.concat((F.col("id") + 100_000_000).cast("string"), F.lit(".fb2"))).alias("file_name"),
            F.when(nameless, F.col("text")).otherwise(F.lit("<description></description>")).alias("text"),
        ),
    )
    each = docs.select("archive", "id", F.explode(F.array_compact(F.array(F.struct(name.alias("file_name"), "text"), twins))).alias("e"))
    entries = each.select("archive", "id", "e.file_name", F.encode("e.text", "UTF-8").alias("data"))
    export.write_archives(entries.repartition("archive").sortWithinPartitions("archive", "id"), library, f"{library}/_manifest")


def stored_library(spark: SparkSession, folder: str) -> str:
    """The archives of a folder of tables, made once for each session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _libraries:
        library = f"{_work(spark)}/library"
        write_library(spark, folder, library)
        _libraries[key] = library
    return _libraries[key]


def shelf(spark: SparkSession, folder: str) -> Shelf:
    """The catalog of a stored library, made once for each session: a first run of some archives, then the rest; not indexed."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _shelves:
        place, library = _work(spark), stored_library(spark, folder)
        catalog = Catalog(spark, library, f"{place}/warehouse")
        odd = F.split("name", "-")[1].cast("int") % 2 == 1
        catalog.ingest("pick", arc.list_archives(spark, library).select("name").filter(odd), strict=True, build_index=False)
        at = f"{place}/between"
        catalog.archives().write.parquet(at)
        first = catalog.archive_table().agg(F.max("content")).first()[0]
        catalog.ingest("new", build_index=False)
        _shelves[key] = Shelf(library, catalog, spark.read.parquet(at), first)
    return _shelves[key]


def indexed(spark: SparkSession, folder: str) -> Catalog:
    """The catalog with its index: a segment of each run, if it has none yet."""
    own = shelf(spark, folder)
    if own.catalog.search_docs() is None:
        own.catalog.build_search_index(upto=own.first)
        own.catalog.build_search_index()
    return own.catalog


def _digest(column: str = "content"):
    return F.md5(F.col(column)).alias("digest")


@query("s1_s4_archives", _USED, "SELECT archive, count(*) AS entries FROM all_docs GROUP BY archive")
def _(spark, folder):
    """Discovery and entry counts of the library's archives."""
    return arc.count_entries(arc.list_archives(spark, stored_library(spark, folder)))


@query("s3_entry_listing", _USED, "SELECT archive, entry, strlen(text)::BIGINT AS file_size FROM all_docs")
def _(spark, folder):
    return arc.list_entries(arc.list_archives(spark, stored_library(spark, folder))).select("archive", "entry", "file_size")


@query("s5_entry_contents", _USED, "SELECT archive, entry, md5(text) AS digest FROM all_docs")
def _(spark, folder):
    entries = arc.list_entries(arc.list_archives(spark, stored_library(spark, folder)))
    return arc.read_entries(entries, "content").filter("error is null").select("archive", "entry", _digest())


@query("s5_archive_source", _USED, "SELECT archive, entry, md5(text) AS digest FROM all_docs WHERE archive IN ('Brand-11-0.zip', 'Brand-23-0.zip')")
def _(spark, folder):
    """The same through the data source; the other archives stay closed."""
    rows = read_archives(spark, stored_library(spark, folder), archives=["Brand-11-0.zip", "Brand-23-0.zip"])
    return rows.select("archive", "entry", _digest())


@query("s6_k12_contents", _USED, f"SELECT id, file_name, md5(text) AS digest FROM ({_NAMED}) JOIN part_docs USING (id)")
def _(spark, folder):
    """Every book looked up by the kept directories."""
    return shelf(spark, folder).catalog.contents(None).select("id", "file_name", _digest("data"))


@query(
    "k9_u4_archive_states", _USED,
    "SELECT DISTINCT archive AS name, CASE WHEN CAST(split_part(archive, '-', 2) AS INT) % 2 = 1 THEN 'indexed' ELSE 'new' END AS status FROM all_docs",
)
def _(spark, folder):
    """Between the two runs."""
    return shelf(spark, folder).between


@query("k10_index_documents", _USED, "SELECT id, title, replace(genres, '|', ', ') AS genres_text, authors_text, sequence FROM stored_books")
def _(spark, folder):
    """The search documents that both segments serve."""
    return indexed(spark, folder).search_docs().select("id", "title", "genres_text", "authors_text", "sequence")


@query("k11_exported_files", _USED, f"SELECT id, title, author, file_name, md5(text) AS digest FROM ({_NAMED}) JOIN part_docs USING (id)")
def _(spark, folder):
    """The manifest of an export of every book, with the files read back by the tasks; the driver lists none of them."""
    manifest = shelf(spark, folder).catalog.export(None, f"{_work(spark)}/files")
    name = F.element_at(F.split(F.col("output_path"), "/"), -1)
    files = export.read_files(manifest, "output_path")
    return files.select("id", "title", "author", name.alias("file_name"), _digest())


@query("k13_bundled_files", _USED, f"SELECT file_name, md5(text) AS digest FROM ({_NAMED}) JOIN part_docs USING (id)")
def _(spark, folder):
    """Bundles of every book, with their entries read back."""
    out = f"{_work(spark)}/bundles"
    shelf(spark, folder).catalog.export_bundles(None, out, per_bundle=100)
    entries = arc.list_entries(arc.list_archives(spark, out))
    return arc.read_entries(entries, "content").select(F.col("entry").alias("file_name"), _digest())


@query(
    "k14_ingest_log", _USED,
    """SELECT archive, entry, 'warn' AS level, CASE WHEN entry LIKE 'copy%' THEN 'no book id in the entry name' ELSE 'no title-info' END AS message
        FROM all_docs WHERE entry LIKE 'copy%' OR text = '<description></description>'
    UNION ALL SELECT archive, NULL, 'info', 'loaded ' || count(*) || ' books' FROM part_docs GROUP BY archive""",
)
def _(spark, folder):
    return shelf(spark, folder).catalog.log().select("archive", "entry", "level", "message")


@query("i1_ingested_books", _USED, "SELECT id, title, genres, date, lang, file_size, sequence, archive FROM stored_books")
def _(spark, folder):
    """What two runs made of the archives."""
    books = shelf(spark, folder).catalog.books().withColumn("genres", F.array_join("genres", "|"))
    return books.select("id", "title", "genres", "date", "lang", "file_size", "sequence", "archive")


@query("p23_stored_authors", _USED, "SELECT id, coalesce(authors_text, '') AS authors FROM stored_books")
def _(spark, folder):
    """Authors as each book carries them."""
    books = shelf(spark, folder).catalog.books()
    return books.select("id", F.coalesce(fields.authors_text(F.col("authors")), F.lit("")).alias("authors"))


@query("i2_streamed_books", _USED, "SELECT id, title, archive FROM stored_books")
def _(spark, folder):
    """The same library indexed by the stream of its archives."""
    catalog = Catalog(spark, stored_library(spark, folder), f"{_work(spark)}/warehouse")
    stream = watch_library(catalog, f"{_work(spark)}/checkpoint", build_index=False)
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()
    return catalog.books().select("id", "title", "archive")


def _found_sql(words: str, condition: str, limit: str = "") -> str:
    return f"""WITH whole AS (SELECT *, list_filter(string_split(regexp_replace(lower(concat_ws(' ', title, authors_text, sequence)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '),
        lambda t: t <> '') AS terms FROM stored_books),
    found AS (SELECT id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT id, unnest(terms) AS term, len(terms) AS len FROM whole) GROUP BY id, term),
    corpus AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM whole),
    scored AS (SELECT id, sum(log10((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score
        FROM found JOIN (SELECT term, count(*) AS df FROM found GROUP BY term) USING (term), corpus WHERE term IN ({words}) GROUP BY id)
    SELECT id, title, genres, date, lang, file_size, sequence, round(score, 6) AS score FROM whole JOIN scored USING (id) WHERE {condition} {limit}"""


def _page(rows: DataFrame) -> DataFrame:
    return rows.select("id", "title", F.array_join("genres", "|").alias("genres"), "date", "lang", "file_size", "sequence", F.round("score", 6).alias("score"))


@query("t7_stored_search", _USED, f"SELECT * FROM ({_found_sql("'blue', '7', 'steel'", "date ILIKE '%19%'")})")
def _(spark, folder):
    """Every hit through the stored segments, with a filter."""
    return _page(indexed(spark, folder).search("Blue, steel 7", Filters(date="19"), limit=None))


@query(
    "t4_stored_page", _USED,
    f"SELECT * FROM ({_found_sql("'blue', 'third', '11'", 'true', 'ORDER BY round(score, 9) DESC, id LIMIT 100')})",
)
def _(spark, folder):
    """A page of the best hits; ties go to the smaller id."""
    return _page(indexed(spark, folder).search("blue third 11", limit=100))


@query("t8_rebuilt_search", _USED, f"SELECT * FROM ({_found_sql("'red', 'widget', '5'", 'true')})")
def _(spark, folder):
    """Every hit of an index made anew, in one segment."""
    catalog = shelf(spark, folder).catalog
    catalog.build_search_index(whole=True)
    return _page(catalog.search("Red widget 5", limit=None))
