"""Queries of the operators that score passages, mine vectors and audit archives, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import audit, negatives, toxicity
from shelfmark.llm.queries_native import documents_as_books


LEAST_TOXIC = 0.3


def op11_toxic_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the rows held out are not read."""
    held_out = lambda column: F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    books = documents_as_books(spark, folder)
    model = toxicity.fit(books, labels.filter(~held_out("doc_id")).select(F.col("doc_id").alias("id"), "toxic"))
    found = toxicity.find(books, model)
    return found.select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= LEAST_TOXIC).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
        F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"))), ",").alias("passages"),
    )


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh row has its label changed first."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, F.col("id") % 50 == 0, label)


OP12_SQL = """WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM rows),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, sum(a.x * b.x)::BIGINT AS s
    FROM parts a JOIN parts b ON a.i = b.i WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
positives AS (SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id)::INT AS rank,
    vec_id AS negative_id, positive_score, s AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score
QUALIFY rank <= 3"""


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit.divergence(documents_as_books(spark, folder)).withColumnRenamed("archive", "source")


OP13_SQL = r"""WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (SELECT row, lang, source, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::BIGINT AS n FROM found GROUP BY ALL HAVING count(DISTINCT row) >= 3),
used AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(term)::BIGINT AS v, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
groups AS (SELECT lang, source, v, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM docs) JOIN langs USING (lang)
    LEFT JOIN used USING (lang, source) GROUP BY ALL),
shares AS (SELECT g.lang, source, term, coalesce(u.n, 0) AS n, 1 + 1000000000 * (coalesce(u.n, 0) + 1) // (g.total + v) AS p
    FROM groups g JOIN kept k USING (lang) LEFT JOIN used u USING (lang, source, term)),
whole AS (SELECT lang, term, 1 + 1000000000 * (n + 1) // (total + v) AS q FROM kept JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
    FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b USING (lang)
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source WHERE a.source <> b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM every QUALIFY part = 'pair' OR rank <= 200"""


QUERIES = {
    "op11_toxic_passages": (op11_toxic_passages, None),
    "op12_hard_negatives": (op12_hard_negatives, OP12_SQL),
    "op13_source_divergence": (op13_source_divergence, OP13_SQL),
}
