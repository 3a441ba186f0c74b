"""A curriculum over archives whose weights change during training.

Each archive has a weight at some points of the training; between them it is
linear. Its integral is the archive's share of the words, bounded by how often a
book may be read. The books of an archive are laid end to end in a fixed random
order, again for each reading; where the archive's cumulative demand reaches a
book is the book's position in the training, and books are sorted by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import keep, let, running_start, text_of, word_count

WORDS_SHARE = 1.5
MOST_READINGS = 2


def integrated(schedule: DataFrame) -> DataFrame:
    """archive, knots (time, rate and area so far, by time) and weight, the whole area, of each archive.

    `schedule` has archive, at (0 to 1) and weight. Before the first and after
    the last time a weight stays what it is there.
    """
    order = Window.partitionBy("archive").orderBy("at")
    clean = schedule.filter(F.col("at").between(0, 1) & (F.col("weight") >= 0)).groupBy("archive", "at").agg(F.max("weight").alias("weight"))
    clean = clean.withColumns({"_first": F.row_number().over(order) == 1, "_last": F.lead("at").over(order).isNull()})
    first, last = F.col("_first"), F.col("_last")
    edges = F.array_compact(
        F.array(
            F.when(first & (F.col("at") > 0), F.struct(F.lit(0.0).alias("at"), F.col("weight"))),
            F.struct(F.col("at").cast("double").alias("at"), F.col("weight")),
            F.when(last & (F.col("at") < 1), F.struct(F.lit(1.0).alias("at"), F.col("weight"))),
        )
    )
    points = clean.select("archive", F.explode(edges).alias("_p")).select("archive", "_p.at", F.col("_p.weight").cast("double").alias("rate"))
    before = lambda name: F.lag(name).over(order)
    step = F.coalesce((F.col("at") - before("at")) * (F.col("rate") + before("rate")) / 2, F.lit(0.0))
    areas = points.withColumn("_step", step).withColumn("area", F.sum("_step").over(order))
    knots = F.array_sort(F.collect_list(F.struct("at", "rate", "area"))).alias("knots")
    return areas.groupBy("archive").agg(knots, F.max("area").alias("weight"))


def time_of(knots: Column, area: Column) -> Column:
    """The time at which the area under a schedule reaches `area`: the inverse of the cumulative demand."""

    def within(i: Column) -> Column:
        left, right = F.get(knots, i - 1), F.get(knots, i)
        rest, width = area - left["area"], right["at"] - left["at"]
        slope = (right["rate"] - left["rate"]) / width
        # rate * t + slope * t^2 / 2 = rest, in the form that also holds for slope 0.
        root = F.sqrt(F.greatest(left["rate"] * left["rate"] + 2 * slope * rest, F.lit(0.0)))
        moved = F.when(left["rate"] + root > 0, 2 * rest / (left["rate"] + root)).otherwise(F.lit(0.0))
        return F.least(left["at"] + moved, right["at"])

    later = F.filter(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: (F.get(knots, i)["area"] >= area) & (F.get(knots, i)["area"] > F.get(knots, i - 1)["area"]))
    return let(F.coalesce(F.get(later, F.lit(0)), F.size(knots) - 1), within)


def targets(sizes: DataFrame, share: float = WORDS_SHARE, most_readings: int = MOST_READINGS) -> DataFrame:
    """Adds `target`: weights share `share` of all words; beyond `most_readings` times its size an archive stops.

    The excess goes to the others by weight. The level rises until no further
    archive stops; a pass over the archives gives three sums.
    """
    limit = F.lit(float(most_readings)) * F.col("archive_size")
    level, stopped = 0.0, -1
    total = sizes.agg(F.sum("archive_size")).first()[0] or 0
    while True:
        over = F.lit(level) * F.col("weight") >= limit
        row = sizes.agg(
            F.sum(F.when(over, F.col("archive_size"))), F.sum(F.when(over, 1).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        if not row[2] or row[1] == stopped:
            break
        stopped = row[1]
        level = (share * total - most_readings * (row[0] or 0)) / row[2]
    return sizes.withColumn("target", F.least(F.lit(level) * F.col("weight"), limit))


def plan(books: DataFrame, schedule: DataFrame, share: float = WORDS_SHARE, most_readings: int = MOST_READINGS) -> DataFrame:
    """One row for each row of `books` (id, text, archive; others ignored), sorted by first position.

    Columns: id, archive, size (words of the whole text), archive_size, target
    (words of its archive that the mix takes), taken (size times the readings)
    and positions (of its readings, from 0 to 1, in order). An archive's books
    are read in the order of a digest of their ids, so reruns agree. A book is
    read when the middle of its words lies before the target: an archive's sum
    is off by half a book at most, and no book is read more than `most_readings`
    times. `schedule` has archive, at and weight; NULL is an archive like any
    other. An archive without schedule or weight has target 0. Books without
    words (NULL or empty text) take nothing and are read where they lie; ties of
    the digest go to the smaller size; repeated rows are books of their own; no
    books give no rows. Every archive is summed in parallel, whatever its share.
    """
    counted = keep(
        books.select("id", "archive", word_count(text_of()).alias("size"), F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("_order")), "sizes"
    )
    per_archive = counted.groupBy("archive").agg(F.sum("size").alias("archive_size"))
    areas = integrated(schedule).withColumnRenamed("archive", "_archive")
    with_weights = per_archive.join(areas, F.col("archive").eqNullSafe(F.col("_archive")), "left").drop("_archive")
    filled = with_weights.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("_key", F.sha2(F.coalesce(F.concat(F.lit("="), "archive"), F.lit("")), 256))
    aimed = targets(keep(filled, "archives"), share, most_readings)
    keyed = counted.withColumn("_key", F.sha2(F.coalesce(F.concat(F.lit("="), "archive"), F.lit("")), 256))
    laid = running_start(keyed, "_key", "_order", "size", "_start")
    joined = laid.join(aimed.select("_key", "archive_size", "weight", "target", "knots"), "_key")
    middle = lambda reading: reading * F.col("archive_size") + F.col("_start") + F.col("size") / 2
    readings = F.filter(F.sequence(F.lit(0), F.lit(most_readings - 1)), lambda reading: middle(reading) < F.col("target"))
    positions = F.transform(readings, lambda reading: time_of(F.col("knots"), middle(reading) / F.col("target") * F.col("weight")))
    placed = joined.select(
        "id", "archive", "size", "archive_size", F.col("target"), (F.size(readings) * F.col("size")).cast("long").alias("taken"), positions.alias("positions")
    )
    return placed.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "id")


def curriculum(plan: DataFrame) -> DataFrame:
    """The readings of a plan, one row each (id, reading from 0, position), sorted by position, then id."""
    return plan.select("id", F.posexplode("positions").alias("reading", "position")).orderBy("position", "id")
