"""Queries of the operators that mix built-in functions with numpy in tasks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm import copies, grades, mixing, neighbours, packing, urls
from shelfmark.llm.queries_native import documents_as_books

WEIGHTS = (3, 1, 2)
# A weight starts at 1 + tilt and ends at 1 - tilt times its mean.
TILTS = (0.5, 0.0, -0.5)
TOKENIZER = "word_bpe_49k.json"


def weights_by_archive(archives: DataFrame) -> DataFrame:
    """The schedule of the mix (archive, at, weight): 3, 1, 2, repeating, by name; one row for each archive is ordered."""
    number = F.row_number().over(Window.orderBy(F.col("archive").asc_nulls_last())) - 1
    numbered = archives.select("archive").distinct().select("archive", (number % 3).alias("_n"))
    pick = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("_n"))
    ends = F.array(
        F.struct(F.lit(0.0).alias("at"), (pick(WEIGHTS) * (1 + pick(TILTS))).alias("weight")),
        F.struct(F.lit(1.0).alias("at"), (pick(WEIGHTS) * (1 - pick(TILTS))).alias("weight")),
    )
    return numbered.select("archive", F.explode(ends).alias("_e")).select("archive", "_e.at", "_e.weight")


def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    books = documents_as_books(spark, folder)
    plan = mixing.plan(books, weights_by_archive(books))
    return plan.select(
        F.col("id").alias("doc_id"), "size", F.col("archive_size").alias("source_size"), F.round("target", 3).alias("target"), "taken",
        F.round(F.get("positions", F.lit(0)), 9).alias("position"),
    )


OP2_SQL = r"""WITH sized AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS s, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS n FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][n + 1]::DOUBLE AS w, [0.5, 0.0, -0.5][n + 1]::DOUBLE AS tilt FROM sources),
filling AS (SELECT *, (1.5 * (SELECT sum(s) FROM sources) - coalesce(sum(2 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM weighed WINDOW o AS (ORDER BY 2 * s / w, source)),
level AS (SELECT arg_min(l, 2 * s / w) FILTER (2 * s / w >= l) AS l FROM filling),
aimed AS (SELECT source, s, least(level.l * w, 2.0 * s) AS target, w, w * (1 + tilt) AS r0, w * (1 - tilt) AS r1 FROM weighed, level),
laid AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM sized),
placed AS (SELECT doc_id, size, s, target, size * ((b + size / 2 < target)::INT + (s + b + size / 2 < target)::INT) AS taken,
    (b + size / 2) / target * w AS area, r0, r1 - r0 AS slope, b + size / 2 < target AS read FROM laid JOIN aimed ON laid.source IS NOT DISTINCT FROM aimed.source)
SELECT doc_id, size, s AS source_size, round(target, 3) AS target, taken::BIGINT AS taken,
    CASE WHEN read THEN round(least(2 * area / (r0 + sqrt(greatest(r0 * r0 + 2 * slope * area, 0))), 1), 9) END AS position FROM placed"""


def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = copies.near_copies(documents_as_books(spark, folder))
    return found.select(F.col("id").alias("doc_id"), F.col("n_grams").alias("n_shingles"), F.col("component").alias("component_id"))


OP5_SQL = r"""WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ 	-
]+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM grams a JOIN grams b USING (g) GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * i >= 90 * (s.n + t.n - i)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)"""


def op6_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0)


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Grades of labelled documents: 0 junk, 1 sound but toxic, 2 good."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").alias("id"), grade.alias("grade"))


# Books of this grade or better are kept.
LEAST_GRADE = 1


def op7_quality_grades(spark: SparkSession, folder: str) -> DataFrame:
    books = documents_as_books(spark, folder)
    found = grades.grade(books, grades.fit(books, ratings(spark, folder)), LEAST_GRADE)
    return found.select(F.col("id").alias("doc_id"), F.round("expected_grade", 6).alias("expected_grade"), F.round("tail", 6).alias("tail"), "kept")


URL_RULES = (
    urls.Rule("allow", "com"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The addresses that a rule covers are the labelled ones."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select(F.col("page_id").alias("id"), "url")
    rule = urls.longest_rule(URL_RULES, *urls.parts(F.col("url")))
    labelled = pages.select("url", (rule["verdict"] == urls.BLOCK).alias("blocked")).filter("blocked is not null")
    found = urls.judge(pages, URL_RULES, labelled)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("blocked", 6).alias("blocked"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(documents_as_books(spark, folder), tokenizer_path())
    return packed.withColumnRenamed("id", "doc_id")


QUERIES = {
    "op2_source_mix": (op2_source_mix, OP2_SQL),
    "op5_ngram_jaccard": (op5_ngram_jaccard, OP5_SQL),
    "op6_nearest_vectors": (op6_nearest_vectors, None),
    "op7_quality_grades": (op7_quality_grades, None),
    "op8_best_fit_packing": (op8_best_fit_packing, None),
    "op10_url_filter": (op10_url_filter, None),
}
