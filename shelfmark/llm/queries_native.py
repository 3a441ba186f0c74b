"""Queries of the operators that use built-in functions only, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import licences, personal, quality, secrets
from shelfmark.llm.common import span_text


def documents_as_books(spark: SparkSession, folder: str) -> DataFrame:
    """`documents` as books with text: the source is the archive."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return documents.select(F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("archive"))


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(documents_as_books(spark, folder))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed", ",").alias("failed"),
    )


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.find(documents_as_books(spark, folder))
    return found.select(F.col("id").alias("doc_id"), "n_notices", "licence", "dice", F.array_join("licences", ",").alias("licences"))


def _digest(spans: Column) -> Column:
    return F.sha2(span_text(spans), 256)


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.find(documents_as_books(spark, folder))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *[count(kind) for kind in personal.KINDS], _digest(base).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    books = documents_as_books(spark, folder)
    entries = books.select("archive", F.col("id").alias("entry"), "text")
    found, _ = secrets.scan(entries)
    kinds = [rule[0] for rule in secrets.BASE_RULES]
    base = F.filter("findings", lambda s: s["kind"].isin(kinds))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("entry").alias("doc_id"), *[count(kind) for kind in kinds], _digest(base).alias("base_sha256"), span_text(F.col("findings")).alias("spans")
    )


_WHITE = r"[\x20\x09-\x0D]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op1_sql() -> str:
    measures = {
        "word_length": "CASE WHEN n_words > 0 THEN word_chars / n_words END",
        "symbol_share": "CASE WHEN word_chars > 0 THEN n_symbols / word_chars END",
        "line_repeats": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines END",
        "word_repeats": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words END",
    }
    quartiles = lambda keys, name: f"""{name} AS (SELECT {keys}measure, max(a) AS books, min(CASE WHEN u >= 0.25 * a THEN v END) AS low,
        min(CASE WHEN u >= 0.5 * a THEN v END) AS mid, min(CASE WHEN u >= 0.75 * a THEN v END) AS high FROM (
        SELECT {keys}measure, sum(n) OVER (PARTITION BY {keys}measure ORDER BY bucket NULLS FIRST) AS u, sum(n) OVER (PARTITION BY {keys}measure) AS a,
        CASE WHEN bucket IS NULL THEN 0.0 ELSE 2 * pow({quality.WIDTH}::DOUBLE, bucket) / (1 + {quality.WIDTH}::DOUBLE) END AS v
        FROM (SELECT {keys}measure, bucket, sum(books) AS n FROM sketch GROUP BY ALL)) GROUP BY {keys}measure)"""  # noqa: E731
    room = " ".join(f"WHEN '{name}' THEN {share}" for name, share in quality.MEASURES.items())
    tolerated = " ".join(f"WHEN '{name}' THEN {share}" for name, share in quality.TOLERATED.items())
    failed = ", ".join(
        f"CASE WHEN {measure} > most_{name}" + (f" OR {measure} < least_{name}" if name == "word_length" else "") + f" THEN '{name}' END"
        for name, measure in measures.items()
    )
    return f"""WITH RECURSIVE texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    split AS (SELECT *, list_filter(string_split_regex(text, '{_WHITE}+'), lambda w: w <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM texts),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split)),
    twice AS (SELECT doc_id, i FROM windows JOIN (SELECT doc_id, k FROM windows GROUP BY ALL HAVING count(*) > 1) USING (doc_id, k)),
    covered AS (SELECT doc_id, count(DISTINCT i + s) AS n FROM twice, range(5) r(s) GROUP BY doc_id),
    counted AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words FROM split LEFT JOIN covered USING (doc_id)),
    sketch AS (SELECT lang, source, measure, CASE WHEN v > 0 THEN ceil(ln(v) / {math.log(quality.WIDTH)!r}::DOUBLE)::INT END AS bucket, count(*) AS books FROM (
        {" UNION ALL ".join(f"SELECT lang, source, '{name}' AS measure, {measure} AS v FROM counted" for name, measure in measures.items())})
        WHERE v IS NOT NULL GROUP BY ALL),
    {quartiles("lang, source, ", "own")}, {quartiles("lang, ", "by_lang")}, {quartiles("", "whole")},
    picked AS (SELECT own.lang, own.source, own.measure, CASE WHEN own.books >= {quality.LEAST_BOOKS} THEN {{'l': own.low, 'm': own.mid, 'h': own.high}}
        WHEN by_lang.books >= {quality.LEAST_BOOKS} THEN {{'l': by_lang.low, 'm': by_lang.mid, 'h': by_lang.high}} ELSE {{'l': whole.low, 'm': whole.mid, 'h': whole.high}} END AS q
        FROM own JOIN by_lang ON own.lang IS NOT DISTINCT FROM by_lang.lang AND own.measure = by_lang.measure JOIN whole ON own.measure = whole.measure),
    bounds AS (SELECT lang, source, measure, q.m - greatest({quality.SPREADS} * (q.m - q.l), CASE measure {room} END * q.m) AS least,
        greatest(q.m + greatest({quality.SPREADS} * (q.h - q.m), CASE measure {room} END * q.m), CASE measure {tolerated} ELSE 0 END) AS most FROM picked),
    limits AS (SELECT lang AS _lang, source AS _source, max(CASE WHEN measure = 'word_length' THEN least END) AS least_word_length,
        {", ".join(f"max(CASE WHEN measure = '{name}' THEN most END) AS most_{name}" for name in measures)} FROM bounds GROUP BY ALL),
    judged AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed, concat_ws(',', {failed}) AS failed
        FROM counted LEFT JOIN limits ON lang IS NOT DISTINCT FROM _lang AND source IS NOT DISTINCT FROM _source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM judged"""


def _op3_sql() -> str:
    templates = ", ".join(f"({_quoted(name)}, {_quoted(notice)})" for name, notice in licences.TEMPLATES.items())
    plain = lambda c: rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    pairs = lambda c: f"list_distinct(list_transform(range(1, len(string_split({c}, ' '))), lambda i: string_split({c}, ' ')[i] || ' ' || string_split({c}, ' ')[i + 1]))"
    t = licences.LEAST_DICE
    return rf"""WITH templates(name, notice) AS (VALUES {templates}),
    known AS (SELECT name, {pairs("p")} AS b FROM (SELECT name, {plain("notice")} AS p FROM templates)),
    units AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n[\x20\x09-\x0D]*\n'))) AS u
        FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    short AS (SELECT doc_id, u, {plain("u")} AS p FROM units WHERE length(u) < 2000),
    sets AS (SELECT doc_id, u, {pairs("p")} AS a FROM short WHERE len(string_split(p, ' ')) BETWEEN 2 AND 200),
    matched AS (SELECT doc_id, u, name, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM sets, known
        WHERE len(a) BETWEEN len(b) * {t} / (2 - {t}) - 1e-6 AND len(b) * (2 - {t}) / {t} + 1e-6),
    good AS (SELECT * FROM matched WHERE dice >= {t}),
    per AS (SELECT doc_id, count(DISTINCT u) AS n, arg_min(name, (-dice, name)) AS licence, max(dice) AS dice,
        string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM good GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_notices, licence, round(dice, 6) AS dice, coalesce(licences, '') AS licences FROM documents LEFT JOIN per USING (doc_id)"""


def _op9_sql() -> str:
    parts = []
    for rank, (kind, pattern, least, group) in enumerate(secrets.RULES):
        p = _quoted(pattern)
        size = f"length(regexp_extract(v, {p}, {group}))" if group else "length(v)"
        parts.append(f"""SELECT doc_id, {rank} AS r, '{kind}' AS kind, s, s + length(v) AS e FROM (
            SELECT doc_id, unnest(found) AS v, unnest(list_transform(range(1, len(found) + 1), lambda i: list_sum(list_transform(between[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0)))::BIGINT AS s FROM (
            SELECT doc_id, string_split_regex(text, {p}) AS between, regexp_extract_all(text, {p}) AS found FROM texts WHERE regexp_matches(text, {p}))) WHERE {size} >= {least}""")
    base = "r < 3"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    spans AS ({" UNION ALL ".join(parts)}),
    per AS (SELECT doc_id, count(*) FILTER (r = 0) AS a, count(*) FILTER (r = 1) AS k, count(*) FILTER (r = 2) AS h,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER ({base}) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) AS spans FROM spans GROUP BY doc_id)
    SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
        coalesce(spans, '') AS spans FROM documents LEFT JOIN per USING (doc_id)"""


QUERIES = {
    "op1_quality_rules": (op1_quality_rules, _op1_sql()),
    "op3_license_scan": (op3_license_scan, _op3_sql()),
    "op4_personal_data": (op4_personal_data, None),
    "op9_secret_scan": (op9_secret_scan, _op9_sql()),
}
