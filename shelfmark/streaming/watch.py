"""I2 as a stream: archives that appear in the library are indexed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators import merge
from shelfmark.plans.catalog import Catalog
from shelfmark.sources import archives as arc
from shelfmark.streaming.settling import settled

_FILE_ROWS = "path string, modificationTime timestamp, length long, content binary"
# By default a file older than a week beside a new one would never be read.
_ANY_AGE = "36500d"
# Archives of a batch, where their number is not bounded.
BATCH_BYTES = 4 * 1024**3


def watch_library(
    catalog: Catalog,
    checkpoint: str,
    archives_per_batch: int | None = None,
    continuous: bool = False,
    build_index: bool = True,
    every: str = "10 seconds",
    settle_seconds: float | None = None,
    offers: int = 6,
    bytes_per_batch: int = BATCH_BYTES,
) -> StreamingQuery:
    """Index new archives as they come; without `continuous`, those there now.

    `settle_seconds`, for continuous streams: an archive is read when its length
    and time have not changed for so long, so one that is still being copied
    waits, and `offers` times in all, so one that the storage failed on gets
    another turn (see `Settling`).

    A batch has so many archives, or else so many bytes: it costs a look at the
    links of the whole catalog, so small archives come many at a time.

    The file source remembers every archive it has handed out, whatever its
    name or age, and never opens it here (`content` is not selected). A batch
    that is repeated after a crash skips what is indexed and redoes the rest.
    With small and frequent batches, leave `build_index` off and rebuild the
    search index on a schedule: a rebuild reads the whole catalog.
    """
    bound = ("maxBytesPerTrigger", bytes_per_batch) if archives_per_batch is None else ("maxFilesPerTrigger", archives_per_batch)
    found = (
        catalog.spark.readStream.format("binaryFile")
        .schema(_FILE_ROWS)
        .option("pathGlobFilter", "*.zip")
        .option("maxFileAge", _ANY_AGE)
        .option(*bound)
        .load(catalog.library)
    )

    def index(batch: DataFrame, _: int) -> None:
        todo = merge.archives_to_read(batch, merge.indexed_names(catalog.archive_table()))
        catalog.ingest_archives(todo, build_index)

    if settle_seconds is None:
        offered = arc.archive_rows(found)
    elif continuous:
        offered = settled(found.select("path"), settle_seconds, offers)
    else:
        raise ValueError("waiting for copies to finish needs a continuous stream")
    writer = offered.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()
