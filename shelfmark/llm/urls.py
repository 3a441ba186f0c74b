"""Filters on addresses: rules of hosts and paths, and a model for what no rule covers.

The library keeps no addresses, so this operator is general: it works on any
table with a url column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import keep

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM_SIZES = (3, 4)
FEATURES = 1 << 14
# Labelled addresses that the model is fitted on at most, by a digest of the address.
MOST_LABELLED = 20_000
ITERATIONS, PENALTY = 60, 1e-4


@dataclass(frozen=True)
class Rule:
    """`verdict` for a host, its subdomains, and paths that begin with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path of an address; both empty without `://`."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substr(url, place + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """struct<length, host, rule, verdict> of the longest fitting rule, ties to the longer host; NULL if none fits."""
    if not rules:
        return F.lit(None).cast("struct<length:int,host:int,rule:string,verdict:string>")
    known = F.array(
        *[
            F.struct(
                F.lit(len(r.name)).alias("length"), F.lit(len(r.host)).alias("host"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"),
                F.lit(r.host).alias("own"), F.lit("." + r.host).alias("under"), F.lit(r.path).alias("path"),
            )
            for r in rules
        ]
    )
    fits = F.filter(known, lambda r: ((host == r["own"]) | F.endswith(host, r["under"])) & F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(*[r[c].alias(c) for c in ("length", "host", "rule", "verdict")])))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked by where they are from; digits count alike."""

    def of(mark: str, text: Column) -> list[Column]:
        padded = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]", "0"), F.lit("$"))
        return [
            F.when(F.length(padded) < n, F.array().cast("array<string>")).otherwise(
                F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), _piece(mark, padded, n))
            )
            for n in GRAM_SIZES
        ]

    return F.concat(*of("h ", host), *of("p ", path))


def _piece(mark: str, text: Column, size: int):
    return lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(size)))


def judge(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """One row for each row of `pages` (id, url; others ignored): id, host, path, rule, verdict and blocked.

    The longest rule that fits gives `rule` and `verdict`; else rule is NULL and
    the verdict is the model's. `blocked` is its probability for every address.
    The model is a logistic regression on hashed character n-grams of host and
    path, fitted on `labelled` (url, blocked boolean), of which at most
    `most_labelled` addresses are used, each once, the first by a digest of them. A NULL
    address or one without `://` has empty parts and gets the model's verdict on
    these. Labels of one kind, or none, give that verdict, or allow. Repeated
    rows are judged each; no pages give no rows. `rules` is a list kept by hand;
    each address meets it in its own row, without a shuffle.
    """
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True)
    host, path = parts(F.col("url"))
    known = labelled.filter("blocked is not null").select(*[c.alias(n) for n, c in zip(("_host", "_path"), parts(F.col("url")), strict=True)], F.col("blocked").cast("double").alias("_label"))
    # An address counts once: copies of one would else fill the sample.
    first = known.distinct().orderBy(F.xxhash64("_host", "_path"), "_host", "_path", "_label").limit(most_labelled)
    sample = keep(first.select("_label", grams(F.col("_host"), F.col("_path")).alias("_grams")), "addresses")
    kinds = sorted(row["_label"] for row in sample.select("_label").distinct().collect())
    model = None
    if len(kinds) == 2:
        model = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=ITERATIONS, regParam=PENALTY).fit(hashing.transform(sample))
    plain = pages.select("id", host.alias("host"), path.alias("path"))
    if model is None:
        scored = plain.withColumn("blocked", F.lit(kinds[0] if kinds else 0.0))
    else:
        model.setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("")
        featured = hashing.transform(plain.withColumn("_grams", grams(F.col("host"), F.col("path"))))
        scored = model.transform(featured).withColumn("blocked", vector_to_array("_p")[1])
    found = scored.withColumn("_rule", longest_rule(rules, F.col("host"), F.col("path")))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("blocked") >= 0.5, BLOCK).otherwise(ALLOW))
    return found.select("id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "blocked")
