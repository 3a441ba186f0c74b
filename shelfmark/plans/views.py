"""Catalog-shaped views over general tables, so that every operator has data.

`documents` become books whose archive is their source; `part`, `supplier` and
`lineitem` become books, authors and the links between them; `events` become an
ingest log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.relations import spread
from shelfmark.schema import STATUS_INDEXED, STATUS_INDEXING


class TableViews:
    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    # documents as books

    def doc_books(self, unspecified: str | None = None) -> DataFrame:
        """`unspecified` names a language to blank out."""
        lang = F.col("lang")
        if unspecified:
            lang = F.when(lang == unspecified, F.lit("")).otherwise(lang)
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.array().cast("array<string>").alias("genres"),
            F.lit("").alias("date"),
            lang.alias("lang"),
            F.col("n_chars").alias("file_size"),
            F.col("source").alias("sequence"),
            F.col("source").alias("archive"),
        )

    def doc_texts(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), "text")

    def doc_archives(self) -> DataFrame:
        suffix = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
        status = F.when(suffix % 2 == 0, F.lit(STATUS_INDEXED)).otherwise(F.lit(STATUS_INDEXING))
        return self.table("documents").select(F.col("source").alias("name"), status.alias("status")).distinct()

    # parts as books

    def part_books(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("title"),
            F.array("p_type", F.substring_index("p_name", " ", 1)).alias("genres"),
            (F.col("p_size") + 1950).cast("string").alias("date"),
            F.lit("").alias("lang"),
            (F.col("p_size") * 1024).cast("bigint").alias("file_size"),
            F.col("p_brand").alias("sequence"),
            F.col("p_brand").alias("archive"),
        )

    def part_authors(self) -> DataFrame:
        nations = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        return self.table("supplier").join(nations, "s_nationkey", "left").select(
            F.col("s_suppkey").cast("string").alias("id"),
            F.col("n_name").alias("first_name"),
            F.lit(None).cast("string").alias("middle_name"),
            F.col("s_name").alias("last_name"),
            F.lit(None).cast("string").alias("nickname"),
        )

    def part_links(self) -> DataFrame:
        """Every link, to the part after its own: the first part has no authors
        and the last links have no book."""
        kept = self.table("part")
        lines = self.table("lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
        # Moved once, by the part: nearly all pairs differ, so counting them where they are read saves nothing.
        return (
            spread(lines, "l_partkey")
            .groupBy("l_partkey", "l_suppkey")
            .agg(F.min("l_linenumber").alias("pos"))
            .join(
                kept.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("archive")), "l_partkey"
            )
            .select(
                (F.col("l_partkey") + 1).alias("book_id"),
                F.col("l_suppkey").cast("string").alias("author_id"),
                "pos",
                "archive",
            )
        )

    def part_archives(self) -> DataFrame:
        return self.table("part").select(F.col("p_brand").alias("name")).distinct()

    def part_documents(self, *also: Column) -> DataFrame:
        """(id, text): each part written as a marked-up book document; `also` adds columns of the part."""

        def tag(name: str, value: Column) -> Column:
            return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

        words = F.split("p_name", " ")
        size = F.col("p_size")
        none = F.lit("")
        author = F.concat(
            F.lit("<author>"),
            tag("first-name", F.concat(F.lit(" "), words[0])),
            tag("first-name", none),
            tag("first-name", words[1]),
            tag("last-name", F.col("p_brand")),
            F.lit("</author>"),
        )
        given = F.concat(F.lit("<author>"), tag("nickname", F.col("p_type")), tag("id", F.col("p_type")), F.lit("</author>"))
        sequence = F.concat(
            F.lit('<sequence name="'), F.col("p_brand"), F.lit('" number="'), size.cast("string"),
            F.lit('"><sequence name="'), F.col("p_type"),
            F.lit('"><sequence number="3" name="Third"><sequence name="Fourth"><sequence name="A &amp; &#x42;" number="5"/></sequence></sequence></sequence></sequence>'),
        )
        info = F.concat(
            F.lit("<title-info>"),
            tag("genre", F.col("p_type")), tag("genre", words[0]), tag("genre", F.col("p_type")),
            F.when(size % 5 != 0, author).otherwise(none),
            F.when(size % 4 == 0, given).otherwise(none),
            tag("book-title", words[0]),
            F.when(size % 3 == 0, tag("date", (size + 1950).cast("string"))).otherwise(none),
            tag("lang", F.lower("p_type")), tag("book-title", words[1]), sequence,
            F.lit('<coverpage><image l:href="#img'), (F.col("p_partkey") % 2).cast("string"),
            F.lit('"/></coverpage></title-info>'),
        )
        publish = F.when(size % 2 == 0, F.concat(F.lit("<publish-info>"), tag("year", (size + 1900).cast("string")), F.lit("</publish-info>")))
        document = F.when(size % 7 != 0, F.concat(F.lit("<document-info>"), tag("date", F.concat(F.lit("01.02."), size.cast("string"))), F.lit("</document-info>")))
        payload = F.base64(F.encode(F.col("p_name"), "UTF-8"))
        binary = lambda n, data: F.concat(
            F.lit(f'<binary id="img{n}" content-type="image/x{n}">\n  '), data, F.lit("\n</binary>")
        )
        text = F.concat(
            F.lit('<?xml version="1.0"?><FictionBook xmlns:l="x"><description>'),
            info, F.coalesce(publish, none), F.coalesce(document, none),
            F.lit("</description><body><p>text</p></body>"),
            binary(0, payload), binary(1, F.when(size % 11 == 0, F.lit("!bad")).otherwise(payload)),
            F.lit("</FictionBook>"),
        )
        return spread(self.table("part"), "p_partkey").select(F.col("p_partkey").alias("id"), text.alias("text"), *also)

    # events as a log

    def log(self) -> DataFrame:
        level = (
            F.when(F.col("event_type") == "error", F.lit("error"))
            .when(F.col("event_type") == "signup", F.lit("warn"))
            .otherwise(F.lit("info"))
        )
        return self.table("events").select(
            F.col("event_id").alias("id"), level.alias("level"), F.col("event_type").alias("source"), F.col("props").alias("message")
        )
