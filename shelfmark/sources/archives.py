"""Archives of documents as DataFrames.

Three steps, each a narrow job on the executors: list the archive files, read
their directories into one row per entry, read the bytes of chosen entries.
Entries carry a slice number, so that one archive of any size is read by many
tasks; nothing but file names and sizes passes through the driver.
"""

from __future__ import annotations

import bz2
import re
import struct
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import fields
from shelfmark.sources import decode

SLICE_BYTES = 64 * 1024 * 1024
# What opening an archive and what handling an entry cost, in bytes read.
OPENING_BYTES, HANDLING_BYTES = 256 * 1024, 16 * 1024
_CHUNK = 1024 * 1024
_BATCH_BYTES = 16 * 1024 * 1024
_BATCH_ROWS = 4096

# Fixed values of the ZIP format.
_END, _END64_LOCATOR, _END64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_ENTRY_HEAD, _LOCAL_HEAD, _END_HEAD = 46, 30, 22
_STORED, _DEFLATED, _BZIP2 = 0, 8, 12
_ENCRYPTED, _UTF8_NAME = 0x1, 0x800

ARCHIVES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("modified", T.TimestampType()),
    ]
)
ENTRIES = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("entry", T.StringType()),
        T.StructField("entry_index", T.LongType()),
        T.StructField("method", T.IntegerType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("crc", T.LongType()),
        T.StructField("packed_size", T.LongType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("slice", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)
_ENTRIES_ARROW = pa.schema(
    [
        ("archive", pa.string()), ("path", pa.string()), ("entry", pa.string()), ("entry_index", pa.int64()),
        ("method", pa.int32()), ("flags", pa.int32()), ("crc", pa.int64()), ("packed_size", pa.int64()),
        ("file_size", pa.int64()), ("offset", pa.int64()), ("slice", pa.int64()), ("error", pa.string()),
    ]
)


def list_archives(spark: SparkSession, library: str) -> DataFrame:
    """(name, path, length, modified) of the `*.zip` files directly in a
    folder. The listing never opens a file: `content` is not selected."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(library)
    return archive_rows(found)


def archive_rows(found: DataFrame) -> DataFrame:
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "path",
        "length",
        F.col("modificationTime").alias("modified"),
    )


# --- directories ------------------------------------------------------------------


# What an entry's error begins with when the storage failed, not the format.
IO_ERROR = "I/O error: "


# Names that Spark's file systems have beside Arrow's own.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss"}


class UnknownStore(RuntimeError):
    """Arrow has no file system for a path: the job fails, the archive is not to blame."""


def store(scheme: str, place: str):
    """The file system of a scheme and host or bucket, and what its paths begin with."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{place}/")
    except (ValueError, NotImplementedError, OSError) as problem:
        raise UnknownStore(f"no way to read {scheme}://{place}: {problem}") from problem


class StorageFault(Exception):
    """What opening, seeking or reading raised: the storage failed, whatever kind of error it says so by."""


class Stored:
    """A file whose own calls tell faults of the storage from those of the format."""

    def __init__(self, file):
        self._file = file

    def _call(self, name: str, *arguments):
        try:
            return getattr(self._file, name)(*arguments)
        except Exception as problem:
            raise StorageFault(str(problem) or type(problem).__name__) from problem

    def seek(self, *arguments):
        return self._call("seek", *arguments)

    def tell(self) -> int:
        return self._call("tell")

    def read(self, *arguments) -> bytes:
        return self._call("read", *arguments)

    def close(self) -> None:
        self._file.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(/.*)", re.DOTALL)


def located(path: str):
    """The file system of a path and its name there.

    Only scheme and host are read as an address; the rest is a plain name,
    whatever blanks or signs it has.
    """
    import os

    from pyarrow import fs

    found = SCHEME.fullmatch(path)
    scheme, rest = found.groups() if found else ("file", os.path.abspath(path))
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    place, _, inner = rest[2:].partition("/") if rest.startswith("//") else ("", "", rest[1:])
    system, base = store(scheme, place)
    return system, f"{base.rstrip('/')}/{inner}"


def _open(path: str) -> Stored:
    """Random access to a file of any file system that Arrow knows."""
    from pyarrow import fs

    system, name = located(path)
    try:
        return Stored(open(name, "rb") if isinstance(system, fs.LocalFileSystem) else system.open_input_file(name))
    except Exception as problem:
        raise StorageFault(str(problem) or type(problem).__name__) from problem


def _read_at(file, offset: int, size: int) -> bytes:
    file.seek(offset)
    data = file.read(size)
    if len(data) < size:
        raise ValueError("archive ends early")
    return data


def _directory_bounds(file) -> tuple[int, int, int]:
    """(start, size, shift) of the directory; `shift` is what precedes the archive."""
    file.seek(0, 2)
    length = file.tell()
    tail_size = min(length, _END_HEAD + 0xFFFF)
    tail = _read_at(file, length - tail_size, tail_size)
    at = tail.rfind(_END)
    if at < 0 or len(tail) - at < _END_HEAD:
        raise ValueError("no end of archive found")
    size, start = struct.unpack("<LL", tail[at + 12 : at + 20])
    end = length - tail_size + at
    locator = end - 20
    if locator >= 0 and _read_at(file, locator, 4) == _END64_LOCATOR:
        (end64,) = struct.unpack("<Q", _read_at(file, locator + 8, 8))
        head = _read_at(file, end64, 56)
        if head[:4] != _END64:
            raise ValueError("damaged end of archive")
        size, start = struct.unpack("<QQ", head[40:56])
        end = end64
    shift = end - size - start
    if shift < 0:
        raise ValueError("damaged end of archive")
    return start + shift, size, shift


def _wide_sizes(extra: bytes, sizes: list[int]) -> list[int]:
    """Replace 32-bit place holders by the values of the 64-bit extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack("<HH", extra[at : at + 4])
        if kind == 1:
            wide = iter(struct.unpack(f"<{length // 8}Q", extra[at + 4 : at + 4 + length // 8 * 8]))
            return [next(wide, value) if value == 0xFFFFFFFF else value for value in sizes]
        at += 4 + length
    return sizes


def directory_entries(file) -> Iterator[tuple]:
    """(name, index, method, flags, crc, packed size, size, offset), streamed."""
    start, size, shift = _directory_bounds(file)
    file.seek(start)
    buffer, left, index = b"", size, 0
    while left or buffer:
        if len(buffer) < _CHUNK and left:
            more = file.read(min(_CHUNK, left))
            if not more:
                raise ValueError("directory ends early")
            left -= len(more)
            buffer += more
        at = 0
        while len(buffer) - at >= _ENTRY_HEAD:
            if buffer[at : at + 4] != _ENTRY:
                raise ValueError("damaged directory")
            flags, method = struct.unpack("<HH", buffer[at + 8 : at + 12])
            crc, packed, full, name_size, extra_size, note_size = struct.unpack("<LLLHHH", buffer[at + 16 : at + 34])
            (offset,) = struct.unpack("<L", buffer[at + 42 : at + 46])
            end = at + _ENTRY_HEAD + name_size + extra_size + note_size
            if end > len(buffer):
                break
            raw_name = buffer[at + _ENTRY_HEAD : at + _ENTRY_HEAD + name_size]
            extra = buffer[at + _ENTRY_HEAD + name_size : end - note_size]
            full, packed, offset = _wide_sizes(extra, [full, packed, offset])
            name = raw_name.decode("utf-8" if flags & _UTF8_NAME else "cp437", errors="replace")
            yield name, index, method, flags, crc, packed, full, offset + shift
            index += 1
            at = end
        if at == 0 and not left:
            raise ValueError("damaged directory")
        buffer = buffer[at:]


def is_document(name: str) -> bool:
    stem, dot, extension = name.rsplit("/", 1)[-1].rpartition(".")
    return bool(stem and dot) and extension.lower() == "fb2"


def list_entries(archives: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """S3: one row per `fb2` entry of each archive, plus one row with `error`
    for an archive that cannot be read. Directories are streamed, never held."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(_ENTRIES_ARROW)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(columns, _ENTRIES_ARROW, strict=True)],
                schema=_ENTRIES_ARROW,
            )
            rows.clear()
            return batch

        for batch in batches:
            for archive in batch.to_pylist():
                name, path, done = archive["name"], archive["path"], 0
                try:
                    with _open(path) as file:
                        for entry, index, method, flags, crc, packed, full, offset in directory_entries(file):
                            if not is_document(entry):
                                continue
                            rows.append(
                                (name, path, entry, index, method, flags, crc, packed, full, offset, done // slice_bytes, None)
                            )
                            done += packed + _LOCAL_HEAD
                            if len(rows) >= _BATCH_ROWS:
                                yield flush()
                except StorageFault as fault:
                    rows.append((name, path, *[None] * 9, f"{IO_ERROR}{fault}"))
                except (OSError, ValueError, struct.error) as error:
                    rows.append((name, path, *[None] * 9, f"cannot read archive: {error}"))
        if rows:
            yield flush()

    return archives.select("name", "path").mapInArrow(scan, ENTRIES)


def count_entries(archives: DataFrame) -> DataFrame:
    """(archive, entries); an unreadable archive counts 0."""
    return list_entries(archives).groupBy("archive").agg(F.count("entry").alias("entries"))


# --- contents ---------------------------------------------------------------------


def inflate(file, row: dict) -> Iterator[bytes]:
    """Uncompressed chunks of one entry; size and checksum are verified at the end."""
    if row["flags"] & _ENCRYPTED:
        raise ValueError("encrypted entry")
    head = _read_at(file, row["offset"], _LOCAL_HEAD)
    if head[:4] != _LOCAL:
        raise ValueError("damaged entry header")
    name_size, extra_size = struct.unpack("<HH", head[26:30])
    file.seek(row["offset"] + _LOCAL_HEAD + name_size + extra_size)
    method = row["method"]
    if method == _DEFLATED:
        engine = zlib.decompressobj(-15)
    elif method == _BZIP2:
        engine = bz2.BZ2Decompressor()
    elif method == _STORED:
        engine = None
    else:
        raise ValueError(f"unsupported compression method {method}")
    left, size, crc = row["packed_size"], 0, 0
    while left:
        packed = file.read(min(_CHUNK, left))
        if not packed:
            raise ValueError("archive ends early")
        left -= len(packed)
        data = engine.decompress(packed) if engine else packed
        size += len(data)
        crc = zlib.crc32(data, crc)
        yield data
    if method == _DEFLATED:
        data = engine.flush()
        size += len(data)
        crc = zlib.crc32(data, crc)
        yield data
    if size != row["file_size"] or crc != row["crc"]:
        raise ValueError("checksum mismatch")


_OPEN_TAG, _CLOSE_TAG = b"<description", b"</description>"
_BLOCK = re.compile(r"<description[^>]*>.*?</description>", re.DOTALL)


def _content(chunks: Iterator[bytes]) -> bytes:
    return b"".join(chunks)


def _text(chunks: Iterator[bytes]) -> str:
    return decode.to_text(b"".join(chunks))


def _description(chunks: Iterator[bytes]) -> str:
    """P3 at the source: only the metadata block is kept and decoded; the body
    is inflated for its checksum and dropped chunk by chunk."""
    kept, start = bytearray(), -1
    for chunk in chunks:
        seen = len(kept)
        kept += chunk
        if start < 0:
            start = kept.find(_OPEN_TAG, max(0, seen - len(_OPEN_TAG)))
        if start >= 0:
            end = kept.find(_CLOSE_TAG, max(start + len(_OPEN_TAG), seen - len(_CLOSE_TAG)))
            if end >= 0:
                block = bytes(kept[start : end + len(_CLOSE_TAG)])
                declared = decode.declared_encoding(bytes(kept[: decode.SAMPLE]))
                for _ in chunks:
                    pass
                return decode.to_text(block, declared)
    found = _BLOCK.search(decode.to_text(bytes(kept)))
    return found.group(0) if found else fields.UNKNOWN_DESCRIPTION


READERS = {"content": (_content, T.BinaryType(), pa.binary()), "text": (_text, T.StringType(), pa.string()), "description": (_description, T.StringType(), pa.string())}


def _tasks(spark: SparkSession, total: int, things: int, slice_bytes: int) -> int:
    """One task for each slice of bytes, counted with what each thing costs beside; a small job is spread as well."""
    return int(max(-(-total // slice_bytes), min(spark.sparkContext.defaultParallelism, things), 1))


def read_partitions(archives: DataFrame, slice_bytes: int = SLICE_BYTES) -> int:
    """How many tasks should list these archives, from their number and total size."""
    total, things = archives.agg(F.coalesce(F.sum(F.col("length") + OPENING_BYTES), F.lit(0)), F.count("*")).first()
    return _tasks(archives.sparkSession, total, things, slice_bytes)


def entry_partitions(entries: DataFrame, slice_bytes: int = SLICE_BYTES) -> int:
    """How many tasks should read these entries, from their number and packed size."""
    size = F.coalesce("packed_size", F.lit(0)) + HANDLING_BYTES
    total, things = entries.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    return _tasks(entries.sparkSession, total, things, slice_bytes)


def read_entries(entries: DataFrame, what: str = "content", partitions: int | None = None, by: str | None = None) -> DataFrame:
    """Entry rows plus `content`, `text` or `description`.

    Rows are spread by (archive, slice), or by column `by` whose rows then follow
    each other, with a fixed number of partitions: they are small, what they
    stand for is not, so run-time coalescing by row size must not merge them. A
    failing entry gets an `error`, not an abort.
    """
    reader, spark_type, arrow_type = READERS[what]
    keep = [name for name in entries.columns if name != "error"]
    out_fields = [f for f in entries.schema.fields if f.name != "error"]
    schema = T.StructType(
        [*out_fields, T.StructField(what, spark_type), T.StructField("error", T.StringType())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        rows: list[dict] = []
        contents: list = []
        errors: list[str | None] = []
        held = 0

        def flush(like: pa.Schema) -> pa.RecordBatch:
            known = pa.Table.from_pylist(rows, schema=like).to_batches()[0] if rows else None
            arrays = [known.column(name) for name in keep]
            batch = pa.RecordBatch.from_arrays(
                [*arrays, pa.array(contents, arrow_type), pa.array(errors, pa.string())],
                names=[*keep, what, "error"],
            )
            rows.clear(), contents.clear(), errors.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                value, error = None, row["error"]
                if error is None:
                    try:
                        if row["path"] != path:
                            if file:
                                file.close()
                            path, file = None, None
                            file = _open(row["path"])
                            path = row["path"]
                        if row["file_size"] == 0:
                            raise ValueError("empty entry")
                        value = reader(inflate(file, row))
                    except StorageFault as fault:
                        error = f"{IO_ERROR}{fault}"
                    except (OSError, ValueError, EOFError, zlib.error, struct.error) as problem:
                        error = str(problem)
                rows.append(row)
                contents.append(value)
                errors.append(error)
                held += len(value) if value else 0
                if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield flush(batch.schema)
                    held = 0
            if rows:
                yield flush(batch.schema)
                held = 0
        if file:
            file.close()

    count = partitions or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [by] if by else ["archive", "slice"]
    spread = entries.repartition(count, *keys).sortWithinPartitions(*([by] if by else []), "path", "offset")
    return spread.mapInArrow(read, schema)


def _unless_stored_badly(error: Column) -> Column:
    """Whether a row has no error; a fault of the storage fails the job, as rows left out would look like missing ones."""
    return F.when(error.startswith(IO_ERROR), F.raise_error(error).cast("boolean")).otherwise(error.isNull())


def lookup(
    archives: DataFrame, wanted: DataFrame, what: str = "content", partitions: int | None = None,
    directory: tuple[DataFrame, DataFrame] | None = None, by: str | None = None, most: int | None = None,
) -> DataFrame:
    """The entries `{id}.fb2` of `wanted` (archive, id, …) with their bytes.

    `directory` holds what earlier runs listed: archives (archive, length,
    modified) and their entries. An archive that still has the length and time
    of its listing is opened at the wanted entries' offsets only; others are
    listed again. Missing archives, damaged archives and missing entries give
    no row; a fault of the storage fails the job. `most` bounds the number of
    tasks, as there are not more values of `by`.
    """
    named = archives.join(wanted.select(F.col("archive").alias("name")).distinct(), "name", "left_semi")
    names = wanted.withColumn("entry", F.concat(F.col("id").cast("string"), F.lit(".fb2")))
    fresh = named
    if directory is not None:
        listed, known = directory
        same = named.join(listed.withColumnRenamed("archive", "name"), ["name", "length", "modified"], "left_semi").select("name", F.col("path").alias("_path"))
        fresh = named.join(same.select("name"), "name", "left_anti")
    found = list_entries(fresh).filter(_unless_stored_badly(F.col("error"))).join(names, ["archive", "entry"])
    if directory is not None:
        kept = known.join(names, ["archive", "entry"]).join(same.withColumnRenamed("name", "archive"), "archive")
        found = found.unionByName(kept.withColumn("path", F.col("_path")).select(*found.columns))
    # Two entries of one name: the later one counts.
    rest = [name for name in found.columns if name not in ("archive", "entry")]
    newest = F.max_by(F.struct(*rest), F.col("entry_index")).alias("_row")
    entries = found.groupBy("archive", "entry").agg(newest).select("archive", "entry", "_row.*")
    if partitions is None:
        partitions = min(entry_partitions(entries), most or sys.maxsize)
    others = [name for name in names.columns if name not in ("archive", "entry")]
    read = read_entries(entries.select(*ENTRIES.names, *others), what, partitions, by)
    return read.filter(_unless_stored_badly(F.col("error"))).select(*wanted.columns, what)
