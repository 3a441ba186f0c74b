"""Secrets in book archives, by a ledger of scanned contents.

An entry of an archive may have many historical versions, and many entries may
hold the same bytes. Each content is addressed by its digest; a (content, rule
version) pair that the ledger already knows is not scanned again, and findings
are joined back to every entry that holds the content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import keep, matches_of, text_of

# Kind, pattern, least length, group whose length counts.
BASE_RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]{16,}", 16, 0),
)
# Kinds that the rule set adds to the base ones.
ADDED_RULES = (
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1, 0),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 1, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 1, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, 0),
    ("payment", r"[sr]k_live_[A-Za-z0-9]{16,}", 1, 0),
    ("map", r"AIza[A-Za-z0-9_-]{35}", 1, 0),
)
RULES = BASE_RULES + ADDED_RULES
RULE_VERSION = 1

FINDINGS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
)
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule_version", T.IntegerType()), T.StructField("findings", FINDINGS)])


def findings_of(text: Column) -> Column:
    """Matches of every rule, by start, then kind as listed."""

    def of(rank: int, kind: str, pattern: str, least: int, group: int) -> Column:
        found = matches_of(text, pattern)
        if group:
            found = F.filter(found, lambda m: F.length(F.regexp_extract(m["value"], pattern, group)) >= least)
        else:
            found = F.filter(found, lambda m: m["end"] - m["start"] >= least)
        return F.transform(
            found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))
        )

    return F.array_sort(F.concat(*[of(rank, *rule) for rank, rule in enumerate(RULES)])).cast(FINDINGS)


def scan(entries: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings per entry, ledger after the run).

    `entries` has archive, entry and text: one row per historical version, its
    content whole; other columns are ignored. `ledger` holds what former runs
    scanned (blob, rule_version, findings). The first result has archive, entry,
    blob and findings, one row for each row of `entries`; the second is the
    ledger with the contents scanned now.

    A NULL text counts as empty; an empty text is content like any other and
    has no findings. Repeated rows each get the content's findings; NULL archive
    or entry pass through. Texts are read whole, and no entries give no rows.
    Entries of one content may make up any share: contents are counted before a
    shuffle, and adaptive execution splits their join with the findings.
    """
    spark = entries.sparkSession
    known = spark.createDataFrame([], LEDGER) if ledger is None else ledger.select(*LEDGER.fieldNames())
    current = known.filter(F.col("rule_version") == rule_version)
    versions = entries.select("archive", "entry", F.sha2(text_of(), 256).alias("blob"), text_of().alias("text"))
    # Grouped first: a content is sent once by each task, however many entries hold it.
    contents = versions.groupBy("blob").agg(F.first("text").alias("text")).join(current.select("blob"), "blob", "left_anti")
    scanned = keep(
        contents.select("blob", F.lit(rule_version).alias("rule_version"), findings_of(F.col("text")).alias("findings")), "scanned"
    )
    found = current.unionByName(scanned).filter(F.size("findings") > 0).select("blob", "findings")
    joined = versions.drop("text").join(found, "blob", "left")
    nothing = F.array().cast(FINDINGS)
    per_entry = joined.select("archive", "entry", "blob", F.coalesce("findings", nothing).alias("findings"))
    return per_entry, known.unionByName(scanned)
