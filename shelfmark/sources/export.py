"""Exported books as a data source that is written to: single files (K11) and bundles."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from shelfmark.sources import archives as arc

# Files of a job that is not committed lie below this folder of the target.
UNFINISHED = "_temporary"
# Files that the commit moves at a time.
MOVES = 16
# Contents of files that a task holds at a time.
BATCH_BYTES = 16 * 1024 * 1024


def qualified(spark: SparkSession, folder: str) -> str:
    """The address of a folder as Hadoop resolves it: a plain name lies on the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def shown(address: str) -> str:
    """An address as users open it: files of the machine by their plain path."""
    return "/" + address[len("file:") :].lstrip("/") if address.startswith("file:") else address


class Place:
    """A folder on any file system that Arrow knows; its files may be named anything."""

    def __init__(self, address: str):
        self.address = address.rstrip("/")
        self._fs, self._folder = arc.located(self.address)
        self._fs.create_dir(self._folder, recursive=True)

    def inner(self, name: str) -> Place:
        return Place(f"{self.address}/{name}")

    def open(self, name: str):
        return self._fs.open_output_stream(f"{self._folder}/{name}")

    def sizes(self) -> list[tuple[str, int]]:
        """Names and lengths of the files directly in the folder."""
        from pyarrow import fs

        return [(info.base_name, info.size) for info in self._fs.get_file_info(fs.FileSelector(self._folder)) if info.is_file]

    def move_all(self, to: Place) -> None:
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda name: self._fs.move(f"{self._folder}/{name}", f"{to._folder}/{name}"), (name for name, _ in self.sizes())))

    def remove(self, name: str) -> None:
        from pyarrow import fs

        if self._fs.get_file_info(f"{self._folder}/{name}").type != fs.FileType.NotFound:
            self._fs.delete_dir(f"{self._folder}/{name}")

    def remove_empty(self, name: str) -> None:
        from pyarrow import fs

        if not self._fs.get_file_info(fs.FileSelector(f"{self._folder}/{name}", allow_not_found=True)):
            self.remove(name)


def each_file(batches: Iterator[pa.RecordBatch], target: Place, at: str) -> Iterator[pa.RecordBatch]:
    """Writes books (…, file_name, data) as files; gives the same rows with `output_path` below `at` for `data`."""
    for batch in batches:
        names, data = batch.column("file_name").to_pylist(), batch.column("data")
        for name, content in zip(names, data, strict=True):
            with target.open(name) as stream:
                stream.write(content.as_buffer())
        kept = [name for name in batch.schema.names if name != "data"]
        paths = pa.array([f"{at}/{name}" for name in names], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), paths], names=[*kept, "output_path"])


BUNDLED = pa.schema([("bundle", pa.string()), ("id", pa.int64()), ("file_name", pa.string())])


def each_bundle(batches: Iterator[pa.RecordBatch], target: Place, at: str) -> Iterator[pa.RecordBatch]:
    """Writes entries (archive, id, file_name, data) as one ZIP for each archive; rows of one follow each other.

    Entries are written as they come, never held as a group; gives (bundle, id, file_name).
    """
    current, stream, packed = None, None, None
    try:
        for batch in batches:
            names, data = batch.column("archive").to_pylist(), batch.column("data")
            for name, file_name, content in zip(names, batch.column("file_name").to_pylist(), data, strict=True):
                if name != current:
                    if packed:
                        packed.close(), stream.close()
                    current, stream = name, target.open(name)
                    packed = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                packed.writestr(file_name, content.as_py())
            paths = pa.array([f"{at}/{name}" for name in names], pa.string())
            yield pa.RecordBatch.from_arrays([paths, batch.column("id"), batch.column("file_name")], schema=BUNDLED)
    finally:
        if packed:
            packed.close(), stream.close()


KINDS: dict[str, Callable] = {"files": each_file, "bundles": each_bundle}


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task attempt that succeeded."""

    attempt: str


class BookWriter(DataSourceArrowWriter):
    """Writes below the target's unfinished folder; only what the commit moves from there is seen.

    Each attempt of a task has a folder of its own, which it deletes when it
    fails. The commit names one attempt for each task, so retries and twins of
    a task leave nothing. The manifest of the rows written goes the same way.
    """

    def __init__(self, kind: str, target: str, manifest: str):
        self.kind, self.target, self.manifest = kind, target, manifest
        self.job = uuid.uuid4().hex

    def _attempt(self, name: str) -> str:
        return f"{UNFINISHED}/{self.job}/{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        attempt = uuid.uuid4().hex
        try:
            sheet = None
            files = Place(self.target).inner(self._attempt(attempt))
            notes = Place(self.manifest).inner(self._attempt(attempt))
            for batch in KINDS[self.kind](iterator, files, shown(self.target)):
                if sheet is None:
                    stream = notes.open(f"part-{attempt}.parquet")
                    sheet = pq.ParquetWriter(stream, batch.schema)
                sheet.write_batch(batch)
            if sheet:
                sheet.close(), stream.close()
        except BaseException:
            for place in (self.target, self.manifest):
                Place(place).remove(self._attempt(attempt))
            raise
        return Written(attempt)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for place in (self.target, self.manifest):
            whole = Place(place)
            for message in messages:
                if message:
                    whole.inner(self._attempt(message.attempt)).move_all(whole)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for place in (self.target, self.manifest):
            whole = Place(place)
            whole.remove(f"{UNFINISHED}/{self.job}")
            whole.remove_empty(UNFINISHED)


class BookSink(DataSource):
    """`write.format("book_sink")` with the options kind (files or bundles), target and manifest, both addresses."""

    @classmethod
    def name(cls) -> str:
        return "book_sink"

    def writer(self, schema: T.StructType, overwrite: bool) -> BookWriter:
        return BookWriter(self.options["kind"], self.options["target"], self.options["manifest"])


def _write(rows: DataFrame, kind: str, out_dir: str, manifest: str, schema: T.StructType) -> DataFrame:
    spark = rows.sparkSession
    spark.dataSource.register(BookSink)
    options = {"kind": kind, "target": qualified(spark, out_dir), "manifest": qualified(spark, manifest)}
    Place(options["manifest"])
    rows.write.format("book_sink").mode("append").options(**options).save()
    return spark.read.schema(schema).parquet(options["manifest"])


def write_files(books: DataFrame, out_dir: str, manifest: str) -> DataFrame:
    """Books (…, file_name, data) -> the same rows with `output_path` for `data`, once all files are there.

    Two books of one file name are one file, the last. `manifest` is a new
    folder for the rows that are returned.
    """
    kept = [f for f in books.schema.fields if f.name != "data"]
    return _write(books, "files", out_dir, manifest, T.StructType([*kept, T.StructField("output_path", T.StringType())]))


def read_files(rows: DataFrame, path: str) -> DataFrame:
    """Rows plus the `content` of the file that each names in column `path`, opened where the row lies.

    No folder is listed; a file that is not there or cannot be read fails the job.
    """
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, done = batch.column(path).to_pylist(), 0
            contents: list[bytes] = []
            held = 0
            for at in paths:
                with arc._open(at) as file:
                    contents.append(file.read())
                held += len(contents[-1])
                if held >= BATCH_BYTES or done + len(contents) == len(paths):
                    part = batch.slice(done, len(contents))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*names, "content"])
                    done, held, contents = done + len(contents), 0, []

    return rows.mapInArrow(read, schema)


def write_archives(entries: DataFrame, out_dir: str, manifest: str) -> DataFrame:
    """Entries (archive, id, file_name, data) -> (bundle, id, file_name), one ZIP for each archive.

    The rows of an archive must lie in one partition and follow each other.
    """
    schema = T.StructType([T.StructField("bundle", T.StringType()), T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType())])
    return _write(entries.select("archive", "id", "file_name", "data"), "bundles", out_dir, manifest, schema)
