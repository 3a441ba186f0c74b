"""From archives to parsed book rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fields
from shelfmark.operators import merge
from shelfmark.sources import archives as arc

MODES = ("full", "new", "search", "pick")


def choose_archives(
    on_disk: DataFrame, known: DataFrame, mode: str, picked: list[str] | DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Archives a mode reads; any other mode text names one archive. `picked`: names, as a list or rows (name)."""
    if mode == "full":
        return on_disk
    if mode == "new":
        return merge.archives_to_read(on_disk, merge.indexed_names(known))
    if isinstance(picked, DataFrame):
        chosen = picked.select("name")
    else:
        names = (picked or []) if mode == "pick" else [mode]
        chosen = on_disk.sparkSession.createDataFrame([(name,) for name in names], "name string")
    return merge.archives_to_read(on_disk, merge.unpicked_names(known, chosen), chosen if strict else None)


def list_archives_of(todo: DataFrame) -> DataFrame:
    """The directories of a run's archives, clustered by archive and entry, as they are kept."""
    listed = arc.list_entries(todo.repartition(arc.read_partitions(todo), "path"))
    return listed.repartitionByRange("archive", "entry").sortWithinPartitions("archive", "entry")


def parse_archives(listed: DataFrame) -> DataFrame:
    """One row per document entry: the nested book, or `reason` why there is none.

    An archive that cannot be read gives one row without `entry`. No filter
    follows the parse, so each document is parsed once.
    """
    partitions = arc.entry_partitions(listed)
    number = fields.book_id(F.col("entry"))
    problem = F.when(F.col("entry").isNotNull() & number.isNull(), F.lit("no book id in the entry name"))
    entries = listed.withColumn("id", number).withColumn("error", F.coalesce("error", problem))
    read = arc.read_entries(entries, "description", partitions)
    parsed = read.withColumn("d", fields.parse_description(F.col("description")))
    columns = [column.alias(name) for name, column in fields.book_columns(F.col("d"), F.col("description")).items()]
    reason = F.coalesce("error", fields.reject_reason(F.col("d")))
    return parsed.select("archive", "entry", "entry_index", "id", "file_size", *columns, reason.alias("reason"))


def outcomes(todo: DataFrame, parsed: DataFrame, known: DataFrame) -> DataFrame:
    """(name, books, rejected, readable, known, io_failed) per archive of the run.

    An archive of which the storage did not give every byte is not readable,
    whatever could be read of it.
    """
    found = parsed.groupBy(F.col("archive").alias("name")).agg(
        F.count_if(F.col("reason").isNull()).alias("books"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
        F.count_if(F.col("entry").isNull()).alias("_unreadable"),
        F.count_if(F.col("reason").startswith(arc.IO_ERROR)).alias("_io"),
    )
    marked = known.select("name", F.lit(True).alias("_known"))
    joined = todo.select("name").join(found, "name", "left").join(marked, "name", "left")
    return joined.select(
        "name",
        F.coalesce("books", F.lit(0)).alias("books"),
        F.coalesce("rejected", F.lit(0)).alias("rejected"),
        (F.coalesce("_unreadable", F.lit(0)) + F.coalesce("_io", F.lit(0)) == 0).alias("readable"),
        F.coalesce("_known", F.lit(False)).alias("known"),
        (F.coalesce("_io", F.lit(0)) > 0).alias("io_failed"),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    """Nested books; of two entries with one id in an archive the later counts.

    Repeated ids are looked for among keys alone and are few, so whole rows
    are not shuffled.
    """
    valid = parsed.filter(F.col("reason").isNull())
    repeated = (
        valid.groupBy("archive", "id")
        .agg(F.count("*").alias("n"), F.max("entry_index").alias("newest"))
        .filter(F.col("n") > 1)
        .select("archive", "id", "newest")
    )
    kept = valid.join(repeated, ["archive", "id"], "left").filter(
        F.col("newest").isNull() | (F.col("newest") == F.col("entry_index"))
    )
    return kept.drop("newest", "entry", "entry_index", "reason")


def log_rows(parsed: DataFrame, results: DataFrame) -> DataFrame:
    """A warning per rejected entry or archive, an info row per archive."""
    rejected = parsed.filter(F.col("reason").isNotNull()).select(
        "archive", "entry", F.lit("warn").alias("level"), F.col("reason").alias("message")
    )
    none = F.lit(None).cast("string")
    loaded = F.concat(F.lit("loaded "), F.col("books").cast("string"), F.lit(" books"))
    summary = results.filter("readable").select(
        F.col("name").alias("archive"),
        none.alias("entry"),
        F.when(F.col("books") > 0, F.lit("info")).otherwise(F.lit("warn")).alias("level"),
        F.when(F.col("books") > 0, loaded).otherwise(F.lit("no valid book")).alias("message"),
    )
    return rejected.unionByName(summary)
