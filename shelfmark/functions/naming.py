"""Names of exported files: at most 255 bytes, cut at character boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.fields import trim_space

# Fixed values of the naming rule.
MAX_NAME_BYTES = 255
CUT_MARK = "..."
SEPARATOR = " - "
EXTENSION = ".fb2"

# A UTF-8 character takes up to four bytes, so backing off three finds its start.
_MAX_BACK_OFF = 3


def normalized_author(author: Column) -> Column:
    return F.replace(trim_space(F.coalesce(author, F.lit(""))), F.lit(" ,"), F.lit(", "))


def path_safe(name: Column) -> Column:
    """Path separators and control characters would break or hide the file."""
    return F.regexp_replace(name, r"[/\\\x00-\x1f\x7f]", "_")


def _prefix(text: Column, size: Column) -> Column:
    """Longest prefix of `text` that takes at most `size` bytes."""
    raw = F.encode(text, "UTF-8")
    cuts = [
        F.try_validate_utf8(F.substring(raw, F.lit(1), size - back).cast("string"))
        for back in range(_MAX_BACK_OFF + 1)
    ]
    return F.coalesce(*cuts, F.lit(""))


def _fit(text: Column, size: Column) -> Column:
    room = size - len(CUT_MARK)
    cut = F.concat(F.regexp_replace(_prefix(text, room), r"[ ,]+\z", ""), F.lit(CUT_MARK))
    return F.when(F.octet_length(text) <= size, text).when(room < 0, F.lit("")).otherwise(cut)


def with_file_name(
    frame: DataFrame, author: Column, title: Column, book_id: Column, name: str = "file_name"
) -> DataFrame:
    """Add `{author} - {title} [{id}].fb2`; the title is kept whole when it fits,
    otherwise the author keeps at most half of the room.

    Every stage is a projection of its own: later stages use the earlier cut
    several times and would otherwise repeat its expression.
    """
    suffix = F.concat(F.lit(" ["), book_id.cast("string"), F.lit("]" + EXTENSION))
    out = frame.withColumns({"_author": path_safe(author), "_title": path_safe(title), "_suffix": suffix})

    budget = F.lit(MAX_NAME_BYTES) - F.octet_length("_suffix")
    room = budget - len(SEPARATOR)
    share = F.least(F.octet_length("_author"), F.floor(budget / 2).cast("int"))
    title_room = (
        F.when(F.col("_author") == "", budget).when(F.octet_length("_title") <= room, room).otherwise(room - share)
    )
    out = out.withColumn("_title", _fit(F.col("_title"), title_room))
    out = out.withColumn("_author", _fit(F.col("_author"), room - F.octet_length("_title")))

    stem = F.when(F.col("_author") == "", F.col("_title")).otherwise(
        F.concat(F.col("_author"), F.lit(SEPARATOR), F.col("_title"))
    )
    return out.withColumn(name, F.concat(stem, F.col("_suffix"))).drop("_author", "_title", "_suffix")
