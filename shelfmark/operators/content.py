"""Annotations and covers of many documents at once.

Each costly step is a projection of its own, and rows without a result are
dropped behind a generator: a plain filter would be pushed below the
projection and search every text a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import markup


def present(frame: DataFrame, name: str) -> DataFrame:
    """Rows whose `name` is not NULL, its expression evaluated once."""
    others = [column for column in frame.columns if column != name]
    value = F.explode_outer(F.when(F.col(name).isNotNull(), F.array(name))).alias(name)
    return frame.select(*others, value).filter(F.col(name).isNotNull())


def annotations(documents: DataFrame, text: str = "text", block: str = "annotation", paragraph: str = "p") -> DataFrame:
    """Rows whose document has an annotation, with it; the text itself is dropped."""
    inner = documents.withColumn("_inner", markup.block_text(F.col(text), block)).drop(text)
    split = inner.withColumn("_paragraphs", markup.paragraphs(F.col("_inner"), paragraph))
    joined = split.withColumn("annotation", markup.joined(F.col("_inner"), F.col("_paragraphs")))
    return present(joined.drop("_inner", "_paragraphs"), "annotation")


def covers(documents: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose cover resolves, with `cover_type` and `cover_data`."""
    others = [column for column in documents.columns if column != text]
    block = markup.cover_block(F.col(text), markup.cover_reference(F.col(text)))
    located = present(documents.select(*others, block.alias("_block")), "_block")
    decoded = located.select(
        *others,
        markup.cover_type(F.col("_block")).alias("cover_type"),
        markup.cover_data(F.col("_block")).alias("cover_data"),
    )
    return decoded.filter(F.col("cover_data").isNotNull())
