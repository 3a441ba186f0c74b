"""Helpers shared by the operators: kept tables, column expressions over texts, running sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WHITE = " \t\n\x0b\f\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
BLOCK = 256


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="shelfmark-")


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, which all executors see; a folder of this process only where it is unset, on a local master."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return given or _own_folder()


# Tables that a stage has kept and that its result still reads; see `stage_tables`.
_LENT: list = []
_LENDING: list[bool] = [False]


def keep(frame: DataFrame, name: str) -> DataFrame:
    """`frame`, written to the shared folder and read back: later steps neither repeat its work nor its lineage.

    The files go when the application ends, those of a stage when the next one begins.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/shelfmark/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(place)
    if _LENDING[0]:
        _LENT.append((system, place))
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def stage_tables() -> Iterator[None]:
    """Deletes what the stage before kept, as its result has been written since, and notes what this one keeps."""
    while _LENT:
        system, place = _LENT.pop()
        system.delete(place, True)
    _LENDING[0] = True
    try:
        yield
    finally:
        _LENDING[0] = False


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often the body and its lambdas use it."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


MATCH = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("value", T.StringType()),
        T.StructField("before", T.StringType()),
        T.StructField("after", T.StringType()),
    ]
)


def matches_of(text: Column, pattern: str, around: int = 0) -> Column:
    """array<struct<start, end, value, before, after>>: leftmost non-overlapping matches.

    Places are in code points, end exclusive. `before` and `after` hold up to
    `around` characters between the match and its neighbours.

    Splitting and extracting walk the same matches, so the lengths of what lies
    between and of the matches add up to positions. They are added in blocks,
    as an array that grows by one is copied each time. Matches are not empty.
    """
    many = T.ArrayType(MATCH)
    none = F.array().cast(many)

    def start(kind: T.DataType) -> Callable[[Column], Column]:
        return lambda at: F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

    def placed(x: Column) -> Column:
        def block(state: Column, number: Column) -> Column:
            first = number * BLOCK

            def one(inner: Column, value: Column) -> Column:
                place = first + F.size(inner["out"])
                left, right = F.get(x["between"], place), F.get(x["between"], place + 1)
                begin = inner["at"] + F.length(left)
                end = begin + F.length(value)
                sides = (F.right(left, F.lit(around)), F.left(right, F.lit(around))) if around else (F.lit(""), F.lit(""))
                match = F.struct(
                    begin.alias("start"), end.alias("end"), value.alias("value"), sides[0].alias("before"), sides[1].alias("after")
                )
                return F.struct(end.alias("at"), F.concat(inner["out"], F.array(match)).alias("out"))

            done = F.aggregate(F.slice(x["found"], first + 1, BLOCK), start(many)(state["at"]), one)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(d["out"])).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(x["found"]) - 1) / BLOCK).cast("int"))
        return F.aggregate(blocks, start(T.ArrayType(many))(F.lit(0).cast("long")), block, lambda state: F.flatten(state["out"]))

    pieces = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), let(pieces, placed)).otherwise(none)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def running_start(frame: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the same `key` that come earlier in `order`.

    `key` is not NULL; `order` is a string of hex digits, evenly spread (ties:
    the smaller value first). Its first four digits make two levels of 256
    groups, so a key with any share of the rows is summed in parallel: sums per
    group first, then a running sum within each small group.
    """

    def before(*keys: str, by: tuple[str, ...], what: str) -> Column:
        window = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(window), F.lit(0).cast("long"))

    rows = frame.withColumns({"_first": F.substring(order, 1, 2), "_second": F.substring(order, 3, 2)})
    seconds = rows.groupBy(key, "_first", "_second").agg(F.sum(value).alias("_sum"))
    firsts = seconds.groupBy(key, "_first").agg(F.sum("_sum").alias("_sum"))
    tops = firsts.select(key, "_first", before(key, by=("_first",), what="_sum").alias("_top"))
    subs = seconds.select(key, "_first", "_second", before(key, "_first", by=("_second",), what="_sum").alias("_sub"))
    offsets = subs.join(tops, [key, "_first"])
    local = rows.withColumn("_local", before(key, "_first", "_second", by=(order, value), what=value))
    joined = local.join(offsets, [key, "_first", "_second"])
    return joined.select(*frame.columns, (F.col("_top") + F.col("_sub") + F.col("_local")).alias(name))
