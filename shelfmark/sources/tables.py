"""Catalog tables as folders of Parquet: batches that are only added, and
small tables that are rewritten as numbered versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Folder:
    """File-system calls for any path that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, inner: str = "") -> bool:
        return self._fs.exists(self._path(f"{self.path}/{inner}" if inner else self.path))

    def children(self) -> list[str]:
        if not self.exists():
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(self._path(self.path)))

    def delete(self, inner: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{inner}"), True)

    def size(self, inner: str) -> int:
        """Bytes of all files below `inner`."""
        return self._fs.getContentSummary(self._path(f"{self.path}/{inner}")).getLength()


class VersionedTable:
    """Each write is a new folder; the latest complete one is the table."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self._spark, self._folder, self._schema = spark, Folder(spark, path), schema

    def _versions(self, complete: bool) -> list[int]:
        found = [name for name in self._folder.children() if name.startswith("v=")]
        if complete:
            found = [name for name in found if self._folder.exists(f"{name}/_SUCCESS")]
        return [int(name[2:]) for name in found]

    def latest(self) -> int | None:
        return max(self._versions(complete=True), default=None)

    def next_number(self) -> int:
        return max(self._versions(complete=False), default=0) + 1

    def write(self, frame: DataFrame, number: int | None = None) -> int:
        number = self.next_number() if number is None else number
        frame.select(*self._schema.names).write.parquet(self.location(number))
        return number

    def location(self, number: int) -> str:
        return f"{self._folder.path}/v={number:09d}"

    def read(self, number: int | None = None) -> DataFrame:
        number = self.latest() if number is None else number
        if number is None:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(self.location(number))

    def read_all(self, numbers: list[int]) -> DataFrame:
        """Rows of several versions together."""
        if not numbers:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(*[self.location(number) for number in numbers])

    def size(self, number: int) -> int:
        return self._folder.size(f"v={number:09d}")

    def remove(self, kept: set[int]) -> None:
        """Deletes every version but `kept`."""
        for number in set(self._versions(complete=False)) - kept:
            self._folder.delete(f"v={number:09d}")


class BatchTable:
    """Rows of every ingest run in a folder of their own, never rewritten."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self._spark, self._path, self._schema = spark, path.rstrip("/"), schema

    def complete(self) -> list[int]:
        """Numbers of the runs whose rows are all written."""
        folder = Folder(self._spark, self._path)
        found = [name for name in folder.children() if name.startswith("batch=")]
        return [int(name[6:]) for name in found if folder.exists(f"{name}/_SUCCESS")]

    def location(self, batch: int) -> str:
        return f"{self._path}/batch={batch}"

    def write(self, frame: DataFrame, batch: int) -> None:
        # A run that failed half-way may have left files of the same number.
        frame.select(*self._schema.names).write.mode("overwrite").parquet(self.location(batch))

    def size(self, batch: int) -> int:
        return Folder(self._spark, self._path).size(f"batch={batch}")

    def remove(self, kept: set[int]) -> None:
        """Deletes the rows of every run but `kept`."""
        folder = Folder(self._spark, self._path)
        for name in folder.children():
            if name.startswith("batch=") and int(name[6:]) not in kept:
                folder.delete(name)

    def read(self, batches: list[int]) -> DataFrame:
        """Rows of the given runs plus their number as `batch`."""
        schema = T.StructType([*self._schema.fields, T.StructField("batch", T.LongType())])
        if not batches:
            return self._spark.createDataFrame([], schema)
        return self._reader(schema).parquet(*[self.location(batch) for batch in batches])

    def read_files(self, files: list[tuple[int, str]]) -> DataFrame:
        """Rows of some files (run, file name) only."""
        schema = T.StructType([*self._schema.fields, T.StructField("batch", T.LongType())])
        if not files:
            return self._spark.createDataFrame([], schema)
        return self._reader(schema).parquet(*[f"{self.location(batch)}/{name}" for batch, name in files])

    def _reader(self, schema: T.StructType):
        return self._spark.read.schema(schema).option("basePath", self._path)
