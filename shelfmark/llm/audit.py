"""How far the archives of a language use its words differently: exact divergences of smoothed shares.

An archive's share of a word is counted in parts of `SCALE`, one added to each
count. For two archives the squared difference of the shares over the second
one's is summed over all words of the language. Most words occur in few
archives, so the sum is that of two archives without any word, plus what the
words of either change alone, plus what words of both change together. Only the
last needs pairs: a word's archives and shares, in the order of the archives,
are a path of a frequent-pattern tree. Words of one path count once with their
number, paths that begin alike share nodes, and a node meets each of its
ancestors once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import keep
from shelfmark.llm.tokens import LETTER, LOWER, buffers, chunks

SCALE = 1_000_000_000
LEAST_BOOKS = 3
MOST_TERMS = 200
# Places of the paths that are held at a time, and slices that a language's words are spread over.
PLACES = 1 << 20
SLICES = 16
_TERM = LETTER | (np.arange(256) >= 128)


def _terms(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Every term of some texts (letters A-Z and all beyond ASCII, A-Z folded) and the number of its text."""
    raw, bounds = buffers(texts)
    solid = _TERM[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = bounds[:-1]
    edges = edges[edges < len(raw)]
    begins[edges] = solid[edges]
    kept = np.flatnonzero(solid)
    start = np.flatnonzero(begins)
    offsets = np.append(np.searchsorted(kept, start), len(kept)).astype(np.int64)
    data = LOWER[raw[kept]]
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return found.dictionary_encode(), np.searchsorted(bounds, start, side="right") - 1


COUNTS = pa.schema([("lang", pa.string()), ("archive", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("books", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, archive, text) to the counts of each group's terms, added up chunk by chunk."""
    for batch in batches:
        groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], names=["lang", "archive"])
        pairs = list(dict.fromkeys((g["lang"], g["archive"]) for g in groups.to_pylist()))
        number = {pair: i for i, pair in enumerate(pairs)}
        group_of = np.array([number[g["lang"], g["archive"]] for g in groups.to_pylist()], np.int64)
        for at, part in chunks(batch.column(2)):
            terms, text = _terms(part)
            width = max(len(terms.dictionary), 1)
            code = terms.indices.to_numpy().astype(np.int64)
            in_text, times = np.unique(text * width + code, return_counts=True)
            key, inverse = np.unique(group_of[at + in_text // width] * width + in_text % width, return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, inverse, times)
            which = key // width
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([pairs[i][0] for i in which.tolist()], pa.string()),
                    pa.array([pairs[i][1] for i in which.tolist()], pa.string()),
                    terms.dictionary.take(pa.array(key % width)).cast(pa.string()),
                    pa.array(n),
                    pa.array(np.bincount(inverse, minlength=len(key)).astype(np.int64)),
                ],
                schema=COUNTS,
            )


def distance(p: Column, q: Column) -> Column:
    """Whole part of (p - q)^2 / q; both are at most SCALE + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def share(n: Column, total: Column, words: Column) -> Column:
    """1 + SCALE * (n + 1) / (total + words), whole; in decimals, as the product may pass 64 bits."""
    whole = lambda x: x.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole(n + 1) * F.lit(SCALE).cast("decimal(10,0)"), whole(total + words))


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def tree_pairs(paths: list[np.ndarray], words: np.ndarray, number: np.ndarray, p: np.ndarray, base: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
    """(archive, other, value) of each node and ancestor in the tree of the sorted `paths`, depth by depth.

    Path i has the places first[i]:first[i + 1] of `number` (its archives),
    `p` and `base`; `words[i]` words have it. A node is a run of paths that
    agree up to its place. The values, what words of both archives change
    together, are whole numbers of 64 bits.
    """
    sizes = np.diff(first)
    agree = np.zeros(len(sizes), np.int64)
    for i in range(1, len(sizes)):
        a, b = paths[i - 1], paths[i]
        upto = min(len(a), len(b))
        differ = np.flatnonzero((a[:upto] != b[:upto]).any(axis=1))
        agree[i] = differ[0] if len(differ) else upto
    for depth in range(1, int(sizes.max(initial=0))):
        deep = np.flatnonzero(sizes > depth)
        # Shallower paths between two deep ones end their agreement there.
        new = np.minimum.reduceat(agree[: deep[-1] + 1], np.append(0, deep[:-1] + 1)) <= depth
        new[0] = True
        starts = np.flatnonzero(new)
        times = np.add.reduceat(words[deep], starts)
        node = first[deep[starts]] + depth
        above = (node - depth)[:, None] + np.arange(depth)[None, :]
        here = np.broadcast_to(node[:, None], above.shape)
        pa_, ba, pb, bb = p[above], base[above], p[here], base[here]
        both = times[:, None]
        one = both * (_distances(pa_, pb) - _distances(pa_, bb) - _distances(ba, pb) + _distances(ba, bb))
        two = both * (_distances(pb, pa_) - _distances(pb, ba) - _distances(bb, pa_) + _distances(bb, ba))
        yield number[above].ravel(), number[here].ravel(), one.ravel()
        yield number[here].ravel(), number[above].ravel(), two.ravel()


PAIRS = pa.schema([("lang", pa.string()), ("archive_no", pa.int64()), ("other_no", pa.int64()), ("value", pa.int64())])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, path, words), sorted, to the sums of each pair of archives; a batch is cut into trees of PLACES places."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        path = batch.column(1)
        first = path.offsets.to_numpy().astype(np.int64)
        inner = path.values
        number, p, base = (inner.field(name).to_numpy(zero_copy_only=False) for name in ("no", "p", "base"))
        number, p, base = (x[first[0] : first[-1]] for x in (number, p, base))
        first = first - first[0]
        words = batch.column(2).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(langs):
            upto = at + 1
            while upto < len(langs) and langs[upto] == langs[at] and first[upto + 1] - first[at] <= PLACES:
                upto += 1
            rows = np.column_stack([number, p])
            found = tree_pairs([rows[first[i] : first[i + 1]] for i in range(at, upto)], words[at:upto], number, p, base, first[at : upto + 1])
            sums: dict[tuple[int, int], int] = {}
            for one, two, value in found:
                width = int(two.max()) + 1
                key, inverse = np.unique(one * width + two, return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, inverse, value)
                for k, v in zip(key.tolist(), total.tolist(), strict=True):
                    sums[k // width, k % width] = sums.get((k // width, k % width), 0) + v
            columns = [[langs[at]] * len(sums), [a for a, _ in sums], [b for _, b in sums], list(sums.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PAIRS, strict=True)], schema=PAIRS)
            at = upto


def divergence(books: DataFrame, least_books: int = LEAST_BOOKS, most_terms: int = MOST_TERMS) -> DataFrame:
    """How each archive of a language differs from the others and from the language as a whole.

    `books` has lang, archive and text (others ignored); NULLs are ''. A term is
    a run of letters A-Z and characters beyond ASCII, A-Z folded to lower case.
    A language keeps the terms that at least `least_books` of its books hold; a
    group (lang, archive) gives each the `share` of its count there.

    Columns: lang, archive, part, item, value, rank. Part `pair`: item is each
    other archive of the language, value the `distance` of the shares, summed
    over all kept terms. Part `term`: item is a kept term of the group whose
    share there passes the language's, value its distance, the first
    `most_terms`. Ranks follow value, then item by bytes. Every group occurs in
    part `pair`, also one without terms; a language with no kept term has 0
    there, one with a single archive has no pair. Repeated rows are books of
    their own; no books give no rows. All arithmetic is exact within 64 bits.
    """
    whole = books.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "archive", "text")])
    # Added up by chunk in the tasks; what is left is spread by the word, so a
    # language or archive with much of the text is no more than its words.
    raw = whole.mapInArrow(_counted, "lang string, archive string, term string, n long, books long").repartition("lang", "term")
    per_archive = raw.groupBy("lang", "term", "archive").agg(F.sum("n").alias("n"), F.sum("books").alias("books"))
    rows = per_archive.groupBy("lang", "term").agg(
        F.sum("books").alias("books"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("archive", "n")).alias("uses")
    )
    kept = keep(rows.filter(F.col("books") >= least_books).drop("books"), "terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("words"), F.sum("lang_n").alias("lang_total"))
    uses = kept.select("lang", "term", "lang_n", F.explode("uses").alias("u")).select("lang", "term", "lang_n", "u.archive", "u.n")
    totals = uses.groupBy("lang", "archive").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    zero = F.lit(0).cast("long")
    groups = whole.select("lang", "archive").distinct().join(totals, ["lang", "archive"], "left").join(langs, "lang", "left").fillna(0, ["total", "own", "words", "lang_total"])
    # Archives of many words come first, so that paths begin alike.
    order = Window.partitionBy("lang").orderBy(F.col("own").desc(), "archive")
    base = F.when(F.col("words") > 0, share(zero, F.col("total"), F.col("words"))).otherwise(F.lit(1).cast("long"))
    groups = keep(groups.withColumns({"no": F.row_number().over(order).cast("long"), "base": base}).drop("own"), "groups")

    priced = keep(
        uses.join(groups, ["lang", "archive"]).select(
            "lang", "archive", "term", "no", "n", "base",
            share(F.col("n"), F.col("total"), F.col("words")).alias("p"),
            share(F.col("lang_n"), F.col("lang_total"), F.col("words")).alias("q"),
        ),
        "shares",
    )
    by_value = Window.partitionBy("lang", "archive").orderBy(F.col("value").desc(), "item")
    terms = priced.filter("p > q").select("lang", "archive", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= most_terms)

    one = groups.select("lang", F.col("no").alias("archive_no"), F.col("base").alias("base_a"), "words")
    two = groups.select("lang", F.col("no").alias("other_no"), F.col("base").alias("base_b"))
    pairs = one.join(two, "lang").filter("archive_no <> other_no")
    empty = pairs.select("lang", "archive_no", "other_no", (F.col("words") * distance(F.col("base_a"), F.col("base_b"))).alias("value"))
    # What the words of one archive change, however many share a count.
    alike = priced.groupBy("lang", "no", "p", "base").agg(F.count("*").alias("times")).withColumn("_slice", F.pmod(F.xxhash64("no", "p"), F.lit(SLICES)))
    facing = two.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))))
    met = alike.join(facing, ["lang", "_slice"]).filter("no <> other_no")
    change = lambda a, b: F.col("times") * (distance(F.col("p") if a else F.col("base_b"), F.col("base_b") if a else F.col("p")) - b)
    alone = met.select(
        "lang",
        F.inline(
            F.array(
                F.struct(F.col("no").alias("archive_no"), F.col("other_no").alias("other_no"), change(True, distance(F.col("base"), F.col("base_b"))).alias("value")),
                F.struct(F.col("other_no").alias("archive_no"), F.col("no").alias("other_no"), change(False, distance(F.col("base_b"), F.col("base"))).alias("value")),
            )
        ),
    )
    paths = priced.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("no", "p", "base"))).alias("path")).filter(F.size("path") > 1)
    counted = paths.groupBy("lang", "path").agg(F.count("*").alias("words"))
    sorted_paths = counted.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    together = sorted_paths.mapInArrow(_walk, "lang string, archive_no long, other_no long, value long")
    sums = empty.unionByName(alone).unionByName(together).groupBy("lang", "archive_no", "other_no").agg(F.sum("value").alias("value"))
    named = lambda name: groups.select("lang", F.col("archive").alias("archive" if name == "archive_no" else "item"), F.col("no").alias(name))
    found = sums.join(named("archive_no"), ["lang", "archive_no"]).join(named("other_no"), ["lang", "other_no"])
    found = found.select("lang", "archive", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return found.unionByName(terms)
