"""Archives as a data source that takes filters: `spark.read.format("book_archives")`."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from shelfmark.sources import archives as arc
from shelfmark.sources.export import Place, qualified

BATCH_BYTES, BATCH_ROWS = 16 * 1024 * 1024, 1024
FILTERED = ("archive", "entry")


@dataclass
class Slice:
    """The entries of an archive whose place lies within [start, end)."""

    archive: str
    start: int
    end: int


@dataclass
class Slices(InputPartition):
    """What one task reads: a slice of a large archive, or several small archives."""

    slices: list[Slice]


class ArchiveReader(DataSourceReader):
    """One partition for each slice of an archive; its task streams the directory and reads its own entries.

    The driver lists file names and lengths only. `archives` names the ones to open, of all if it is None.
    """

    def __init__(self, address: str, what: str, slice_bytes: int, archives: list[str] | None = None):
        self.address, self.what, self.slice_bytes = address, what, slice_bytes
        self.wanted: dict[str, set[str] | None] = dict.fromkeys(FILTERED)
        if archives is not None:
            self.wanted["archive"] = set(archives)

    def _fits(self, column: str, value: str | None) -> bool:
        wanted = self.wanted[column]
        return wanted is None or value in wanted

    def partitions(self) -> list[InputPartition]:
        found = sorted((name, size) for name, size in Place(self.address).sizes() if name.endswith(".zip") and self._fits("archive", name))
        dealt, held = [], self.slice_bytes
        for name, size in found:
            cost = size + arc.OPENING_BYTES
            for at in range(0, max(size, 1), self.slice_bytes):
                if held + min(cost, self.slice_bytes) > self.slice_bytes:
                    dealt.append(Slices([]))
                    held = 0
                dealt[-1].slices.append(Slice(name, at, at + self.slice_bytes))
                held += min(cost, self.slice_bytes)
        return dealt

    def read(self, partition: Slices | None) -> Iterator[pa.RecordBatch]:
        for part in partition.slices if partition else ():  # nothing to read at all
            yield from self._read(part)

    def _read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        reader, _, arrow_type = arc.READERS[self.what]
        schema = pa.schema([("archive", pa.string()), ("entry", pa.string()), ("entry_index", pa.int64()), ("file_size", pa.int64()), (self.what, arrow_type), ("error", pa.string())])
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        def failed(problem: Exception) -> str:
            return f"{arc.IO_ERROR}{problem}" if isinstance(problem, arc.StorageFault) else str(problem)

        problems = (arc.StorageFault, OSError, ValueError, EOFError, zlib.error, struct.error)
        try:
            held = 0
            with arc._open(f"{self.address}/{partition.archive}") as file:
                own = [e for e in arc.directory_entries(file) if self._belongs(partition, e)]
                for name, index, method, flags, crc, packed, full, offset in sorted(own, key=lambda e: e[-1]):
                    entry = {"method": method, "flags": flags, "crc": crc, "packed_size": packed, "file_size": full, "offset": offset}
                    value, error = None, None if full else "empty entry"
                    if error is None:
                        try:
                            value = reader(arc.inflate(file, entry))
                        except problems as problem:
                            error = failed(problem)
                    rows.append((partition.archive, name, index, full, value, error))
                    held += len(value or "")
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield flush()
                        held = 0
        except problems as problem:
            # One row for the archive, from its first slice.
            if partition.start == 0 and self._fits("entry", None):
                rows.append((partition.archive, None, None, None, None, failed(problem)))
        if rows:
            yield flush()

    def _belongs(self, partition: Slice, entry: tuple) -> bool:
        name, offset = entry[0], entry[-1]
        return partition.start <= offset < partition.end and arc.is_document(name) and self._fits("entry", name)


class FilteredArchiveReader(ArchiveReader):
    """Conditions on `archive` leave other files closed, conditions on `entry` leave other entries packed."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            name = condition.attribute[0] if isinstance(condition, (EqualTo, In)) and len(condition.attribute) == 1 else None
            if name not in FILTERED:
                yield condition
                continue
            values = {condition.value} if isinstance(condition, EqualTo) else set(condition.value)
            known = self.wanted[name]
            self.wanted[name] = values if known is None else known & values


class ArchiveSource(DataSource):
    """Options: path (an address), what (content, text or description), slice_bytes, filtered (true or false),
    archives (names as JSON; else all).

    A session without filter pushdown refuses a reader that takes filters, so such a reader is made on demand only.
    """

    @classmethod
    def name(cls) -> str:
        return "book_archives"

    def schema(self) -> T.StructType:
        what = self.options.get("what", "content")
        fields = [("archive", T.StringType()), ("entry", T.StringType()), ("entry_index", T.LongType()), ("file_size", T.LongType()), (what, arc.READERS[what][1]), ("error", T.StringType())]
        return T.StructType([T.StructField(name, kind) for name, kind in fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        made = FilteredArchiveReader if self.options.get("filtered", "false") == "true" else ArchiveReader
        return made(self.options["path"].rstrip("/"), self.options.get("what", "content"), int(self.options.get("slice_bytes", arc.SLICE_BYTES)), json.loads(self.options.get("archives", "null")))


def read_archives(spark: SparkSession, library: str, what: str = "content", slice_bytes: int | None = None, archives: list[str] | None = None) -> DataFrame:
    """(archive, entry, entry_index, file_size, `what`, error) of the documents of a library's archives, or of those named in `archives`.

    Filters on archive and entry reach the files, when the session has
    `spark.sql.python.filterPushdown.enabled`, as `build_session` sets it; else
    Spark applies them to the rows. The setting is to stay until the rows are read.
    """
    spark.dataSource.register(ArchiveSource)
    filtered = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    options = {"path": qualified(spark, library), "what": what, "slice_bytes": slice_bytes or arc.SLICE_BYTES, "filtered": filtered, "archives": json.dumps(archives)}
    return spark.read.format("book_archives").options(**options).load()
