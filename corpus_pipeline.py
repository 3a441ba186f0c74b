"""From documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, in
the columns of `documents`; the last returns the pieces of the packing. A
stage's result is written before the next stage is called.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm import copies, grades, mixing, packing, personal
from shelfmark.llm.common import keep, stage_tables, text_of, word_count
from shelfmark.llm.queries_free import LEAST_GRADE, ratings, tokenizer_path, weights_by_archive

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _books(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("archive"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade the classifier accepts, judged beside their texts, without a join."""
    model = grades.fit(_books(docs), ratings(spark, sf_dir))
    if model is None:
        return docs.select(*COLUMNS)
    scored = docs.select(*COLUMNS).mapInArrow(grades.grader(model, LEAST_GRADE, given=COLUMNS), SCHEMA + ", expected_grade double, tail double")
    return scored.filter(F.col("tail") >= grades.LEAST_TAIL).select(*COLUMNS)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id; rows of one id are one document."""
    found = copies.near_copies(_books(docs))
    gone = keep(found.filter("component <> id").select(F.col("id").alias("doc_id")).distinct(), "copies")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each span of personal data replaced by its kind in angle brackets."""
    return personal.mask(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it, in the order of the training."""
    books = _books(docs)
    plan = mixing.plan(books, weights_by_archive(books))
    # Rows of one id are told apart by size; of equal sizes any will do.
    nth = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("size"))
    planned = keep(plan.select("id", "size", "positions"), "plan").withColumn("_nth", nth("id")).select(F.col("id").alias("_id"), "_nth", "positions")
    sized = docs.select(*COLUMNS, word_count(text_of()).alias("size")).withColumn("_n", nth("doc_id"))
    joined = sized.join(planned.filter(F.size("positions") > 0), F.col("doc_id").eqNullSafe(F.col("_id"))).filter("_n = _nth")
    read = joined.select(*COLUMNS, F.explode("positions").alias("_position"))
    return read.orderBy("_position", "doc_id").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in training sequences."""
    return packing.pack(_books(docs), tokenizer_path()).withColumnRenamed("id", "doc_id")


def _alone(stage):
    """`stage`, called once the result of the one before is written: what that one kept on disk goes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_tables():
            return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", _alone(quality_stage)),
    ("n-gram Jaccard join", _alone(copies_stage)),
    ("personal data", _alone(personal_stage)),
    ("mixing to target weights", _alone(mixing_stage)),
    ("best-fit packing", _alone(packing_stage)),
]

# A trained classifier and a tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
