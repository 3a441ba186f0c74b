"""Near copies of books: a Jaccard join of word n-grams over count-vector R-trees.

A book is the set of its n-grams. N-grams are hashed into groups; the counts by
group are the book's point, and two sets share at most the sum of the smaller
count of each group. Points are indexed in R-trees of one level, whose leaves keep the largest
count of each group; a pair of leaves, then of points, is passed over when the
bound falls short of what the Jaccard coefficient needs. All surviving pairs are
verified on their sets.

One tree over all books would put everything in one place, so books are first
routed into families. Linked sets differ in at most D n-grams; if the groups are
cut into D + 2 bands, they agree on at least two bands in full. Books that agree
on a band belong to one family: no link crosses families, each has its own
tree, and what is shuffled for routing are digests of bands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import keep
from shelfmark.llm.graph import components, forest
from shelfmark.llm.tokens import chunks, mixed, words

NGRAM = 3
PERCENT = 90
GROUPS = 128
LEAF_BOOKS, LEAF_GRAMS = 128, 100_000
# Band digests of about so many bytes meet in one task.
BUCKET_BYTES = 4_000_000

PROFILE = "id long, n long, hi long, lo long"
POINT = "family long, id long, n long, hi long, lo long, counts binary, grams binary"
LEAF = "family long, leaf long, least long, most long, top array<int>, ids binary, keys binary, sizes binary, counts binary, grams binary"
BLOBS = ("ids", "keys", "sizes", "counts", "grams")
# Columns of an incidence matrix that are multiplied at once.
BLOCK_GRAMS = 8192


def gram_sets(texts: pa.Array, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit n-grams of each text, one after another, and their boundaries.

    A text of fewer words has one gram, the whole sequence; without words none.
    """
    found = words(texts)
    counts = np.diff(found.first)
    total = len(found.hash)
    grams = np.zeros(total, np.uint64)
    factors = mixed(np.arange(1, ngram + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(ngram):
        grams[: max(total - k, 0)] += mixed(found.hash[k:] + factors[k]) * factors[k]
    grams = mixed(grams)
    sizes = np.where(counts >= ngram, counts - ngram + 1, np.minimum(counts, 1))
    for i in np.flatnonzero((counts > 0) & (counts < ngram)).tolist():
        part = found.hash[found.of(i)]
        own = np.uint64(len(part))
        for k, h in enumerate(part):
            own = mixed(np.array([own ^ h]) + factors[k])[0]
        grams[found.first[i]] = own
    bounds = np.append(0, sizes.cumsum())
    out = np.empty(bounds[-1], np.uint64)
    for i, (start, size) in enumerate(zip(found.first[:-1].tolist(), sizes.tolist(), strict=True)):
        own = grams[start : start + size]
        own.sort()
        out[bounds[i] : bounds[i + 1]] = own
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][sizes > 0]] = True
    distinct = np.append(0, new.cumsum())
    return out[new], distinct[bounds]


def set_keys(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, whatever the order of their grams."""
    filled = np.diff(bounds) > 0
    keys = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        key = np.zeros(len(bounds) - 1, np.uint64)
        if filled.any():
            key[filled] = np.add.reduceat(mixed(grams ^ np.uint64(salt)), bounds[:-1][filled])
        keys.append(mixed(key + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return keys[0], keys[1]


def profiler(ngram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch.column(1)):
                grams, bounds = gram_sets(part, ngram)
                hi, lo = set_keys(grams, bounds)
                ids = batch.column(0).slice(at, len(part))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), pa.array(hi), pa.array(lo)], names=["id", "n", "hi", "lo"])

    return run


def size_classes(largest: int, percent: int = PERCENT) -> np.ndarray:
    """Upper ends of size classes: linked sets lie in the same class or in neighbours."""
    ends, start = [], 1
    while start <= largest:
        ends.append(start * 100 // percent)
        start = ends[-1] + 1
    return np.array(ends, dtype=np.int64)


def bands(grams: np.ndarray, bounds: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the bands of each set, and the number of the set, for its own size class and the next.

    Sets a and b link if their difference is at most (a + b) (1 - j) / (1 + j).
    Two such sets agree on two of D + 2 bands at least. A set with one empty
    band leaves it out, as the other agreement is enough; one with more empty
    bands shows them too.
    """
    sizes = np.diff(bounds)
    ends = size_classes(int(sizes.max(initial=0)) * 2 + 2, percent)
    own = np.searchsorted(ends, sizes)
    keys, sets = [], []
    for step in (0, 1):
        level = own + step
        allowed = 2 * ends[level] * (100 - percent) // (100 + percent)
        used = np.flatnonzero((sizes > 0) & (allowed > 0))
        if not len(used):
            continue
        number = allowed[used] + 2
        each = sizes[used]
        index = np.repeat(bounds[:-1][used] - np.append(0, each.cumsum())[:-1], each) + np.arange(each.sum())
        part = grams[index]
        owner = np.repeat(np.arange(len(used)), each)
        band = ((part >> np.uint64(32)) * number[owner].astype(np.uint64)) >> np.uint64(32)
        change = np.ones(len(part), bool)
        change[1:] = (band[1:] != band[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(change)
        sums = np.add.reduceat(mixed(part), starts)
        of, at = owner[starts], band[starts]
        salt = mixed(level[used].astype(np.uint64) + np.uint64(0xA4093822299F31D0))
        keys.append(mixed(mixed(sums) + salt[of] + at * np.uint64(0x9E3779B97F4A7C15)))
        sets.append(used[of])
        for i in np.flatnonzero(number - np.bincount(of, minlength=len(used)) > 1).tolist():
            empty = np.setdiff1d(np.arange(number[i], dtype=np.uint64), at[of == i])
            keys.append(mixed(salt[i] + empty * np.uint64(0x9E3779B97F4A7C15)))
            sets.append(np.full(len(empty), used[i]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(sets)


def stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each key its least node, and edges that connect the nodes of equal keys, at most one for each node."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(first)
    centre = np.repeat(nodes[starts], np.diff(np.append(starts, len(keys))))
    apart = nodes != centre
    return keys[starts], nodes[starts], *forest(nodes[apart], centre[apart])


def router(ngram: int, percent: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, text) to (bucket, left, right): digests and sets by digest; from `buckets` on, edges.

    Within a batch a digest is sent once. Further sets that have it are tied to
    that one by an edge, so a digest of very many books is few rows.
    """

    def blobs(offset: int, place: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list, list, list]:
        order = np.argsort(place, kind="stable")
        place, left, right = place[order], left[order], right[order]
        cuts = np.flatnonzero(np.diff(place)) + 1
        return (
            [int(p[0]) + offset for p in np.split(place, cuts) if len(p)],
            [x.tobytes() for x in np.split(left, cuts) if len(x)],
            [x.tobytes() for x in np.split(right, cuts) if len(x)],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, part in chunks(batch.column(1)):
                grams, bounds = gram_sets(part, ngram)
                lo = set_keys(grams, bounds)[1]
                found, sets = bands(grams, bounds, percent)
                keys.append(found)
                nodes.append(lo[sets])
            sent, node, a, b = stars(np.concatenate(keys), np.concatenate(nodes))
            place = (sent >> np.uint64(40)).astype(np.int64) % buckets
            out = [blobs(0, place, sent, node), blobs(buckets, mixed(a.view(np.uint64)).view(np.int64) % buckets, a, b)]
            columns = [pa.array(x + y, kind) for x, y, kind in zip(*out, (pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "left", "right"])

    return run


def joiner(buckets: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Edges of a bucket: digests that several sets have, or edges that batches sent."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iat[0]) if len(frame) else 0
        left, right = b"".join(frame["left"]), b"".join(frame["right"])
        if bucket < buckets:
            _, _, a, b = stars(np.frombuffer(left, np.uint64), np.frombuffer(right, np.int64))
        else:
            a, b = forest(np.frombuffer(left, np.int64), np.frombuffer(right, np.int64))
        return pd.DataFrame({"a": a, "b": b})

    return run


def pointer(ngram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (family, id, hi, lo, text) to points; texts of another set are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family, ids, hi, lo = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for at, part in chunks(batch.column(4)):
                grams, bounds = gram_sets(part, ngram)
                keys = set_keys(grams, bounds)
                rows = []
                for i in range(len(part)):
                    if keys[0][i] == hi[at + i] and keys[1][i] == lo[at + i]:
                        own = grams[bounds[i] : bounds[i + 1]]
                        counts = np.bincount((own & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
                        rows.append((int(family[at + i]), int(ids[at + i]), len(own), int(keys[0][i]), int(keys[1][i]), counts.astype(">u4").tobytes(), own.tobytes()))
                kinds = (*[pa.int64()] * 5, pa.binary(), pa.binary())
                columns = zip(*rows, strict=True) if rows else [()] * 7
                names = ["family", "id", "n", "hi", "lo", "counts", "grams"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted points to R-tree leaves: neighbours of one family, with the largest count of each group.

    A row that repeats the id and the set of the one before is left out.
    """
    number = TaskContext.get().partitionId() << 32
    held: list[dict] = []

    def leaf() -> dict:
        nonlocal number
        number += 1
        counts = np.stack([np.frombuffer(p["counts"], ">u4") for p in held]).astype(np.uint32)
        out = {
            "family": held[0]["family"], "leaf": number, "least": min(p["n"] for p in held), "most": max(p["n"] for p in held),
            "top": counts.max(axis=0).astype(np.int32).tolist(), "ids": np.array([p["id"] for p in held], np.int64).tobytes(),
            "keys": np.array([p["lo"] for p in held], np.int64).tobytes(),
            "sizes": np.array([p["n"] for p in held], np.int64).tobytes(), "counts": counts.tobytes(), "grams": b"".join(p["grams"] for p in held),
        }
        held.clear()
        return out

    schema = pa.schema(
        [(c, pa.int64()) for c in ("family", "leaf", "least", "most")] + [("top", pa.list_(pa.int32()))] + [(c, pa.binary()) for c in BLOBS]
    )
    last = None
    for batch in batches:
        for point in batch.to_pylist():
            key = tuple(point[c] for c in ("family", "id", "hi", "lo"))
            if key == last:
                continue
            last = key
            full = len(held) >= LEAF_BOOKS or sum(p["n"] for p in held) + point["n"] > LEAF_GRAMS
            if held and (full or held[0]["family"] != point["family"]):
                yield pa.RecordBatch.from_pylist([leaf()], schema)
            held.append(point)
    if held:
        yield pa.RecordBatch.from_pylist([leaf()], schema)


class Members:
    """The points of a leaf."""

    def __init__(self, row: dict, suffix: str = ""):
        self.ids = np.frombuffer(row["ids" + suffix], np.int64)
        self.keys = np.frombuffer(row["keys" + suffix], np.int64)
        self.sizes = np.frombuffer(row["sizes" + suffix], np.int64)
        self.counts = np.frombuffer(row["counts" + suffix], np.uint32).reshape(len(self.ids), GROUPS).astype(np.int32)
        self.grams = np.split(np.frombuffer(row["grams" + suffix], np.uint64), self.sizes.cumsum()[:-1])


def shared_grams(one: Members, other: Members, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many grams the sets of each pair share: set by set or, where many pairs meet, by products of incidence matrices."""
    rows, row = np.unique(left, return_inverse=True)
    columns, column = np.unique(right, return_inverse=True)
    mine, theirs = [one.grams[i] for i in rows], [other.grams[j] for j in columns]
    total = sum(map(len, mine)) + sum(map(len, theirs))
    distinct = np.unique(np.concatenate(mine))
    # Rough nanoseconds of either way.
    if 30 * int((one.sizes[left] + other.sizes[right]).sum()) <= 100 * total + 0.2 * len(rows) * len(columns) * len(distinct):
        pairs = zip(left.tolist(), right.tolist(), strict=True)
        return np.array([len(np.intersect1d(one.grams[i], other.grams[j], assume_unique=True)) for i, j in pairs], np.int64)

    def incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        grams = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(distinct, grams), len(distinct) - 1)
        known = distinct[at] == grams
        order = np.argsort(at[known], kind="stable")
        return owner[known][order], at[known][order]

    (a, at_a), (b, at_b) = incidence(mine), incidence(theirs)
    shared = np.zeros((len(rows), len(columns)))
    for start in range(0, len(distinct), BLOCK_GRAMS):
        width = min(BLOCK_GRAMS, len(distinct) - start)
        blocks = []
        for owner, at, size in ((a, at_a, len(rows)), (b, at_b, len(columns))):
            part = slice(*np.searchsorted(at, (start, start + width)))
            block = np.zeros((size, width), np.float32)
            block[owner[part], at[part] - start] = 1
            blocks.append(block)
        shared += blocks[0] @ blocks[1].T
    return shared[row, column].astype(np.int64)


def linked(one: Members, other: Members, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs of two leaves, or of one with itself."""
    left, right = [], []
    for i in range(len(one.ids)):
        start = i + 1 if one is other else 0
        need = -(-percent * (one.sizes[i] + other.sizes[start:]) // (100 + percent))
        bound = np.minimum(one.counts[i], other.counts[start:]).sum(axis=1)
        found = np.flatnonzero(bound >= need) + start
        left.append(np.full(len(found), i))
        right.append(found)
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a):
        return a, b
    good = (100 + percent) * shared_grams(one, other, a, b) >= percent * (one.sizes[a] + other.sizes[b])
    return a[good], b[good]


def _told(one: Members, other: Members, percent: int, every: bool) -> pa.RecordBatch:
    """All linked pairs as (a, b, 1), or fewer rows: edges that connect the same ids as (a, b, 0) and each set's links as (lo, NULL, n)."""
    i, j = linked(one, other, percent)
    a, b = one.ids[i], other.ids[j]
    if every:
        columns = a, b, np.ones(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])
    a, b = forest(a, b)
    keys, counts = np.unique(np.concatenate([one.keys[i], other.keys[j]]), return_counts=True)
    columns = np.append(a, keys), np.append(b, keys), np.append(np.zeros(len(a), np.int64), counts)
    no_end = np.arange(len(a) + len(keys)) >= len(a)
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=no_end), pa.array(columns[2])], names=["a", "b", "n"])


def within(percent: int, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                members = Members(row)
                yield _told(members, members, percent, every)

    return run


def between(percent: int, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _told(Members(row), Members(row, "_2"), percent, every)

    return run


def candidate_families(books: DataFrame, sets: DataFrame, ngram: int, percent: int) -> DataFrame:
    """lo and family of the sets that agree with another on a band."""
    grams = sets.agg(F.sum("n")).first()[0] or 0
    per_gram = 2 * 2 * (100 - percent) / (100 + percent) * 1.1 * 16
    buckets = max(1, round(grams * per_gram / BUCKET_BYTES))
    routed = books.select("id", "text").mapInArrow(router(ngram, percent, buckets), "bucket long, left binary, right binary")
    edges = routed.groupBy("bucket").applyInPandas(joiner(buckets), "a long, b long")
    return components(edges).select(F.col("node").alias("lo"), F.col("label").alias("family"))


def links(books: DataFrame, sets: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, every: bool = True) -> DataFrame:
    """All links (a, b, n = 1) between representatives of different sets.

    Without `every` the same pairs are verified, but a large group of near
    copies is told in fewer rows: edges (a, b, 0) that connect the same ids, and
    (lo, NULL, n) where the set of that digest has n more links.
    """
    members = sets.join(candidate_families(books, sets, ngram, percent), "lo").select("id", "family", "hi", "lo")
    texts = books.select("id", "text").join(members, "id").select("family", "id", "hi", "lo", "text")
    points = keep(texts.mapInArrow(pointer(ngram), POINT), "points")
    order = ["family", "n", "counts", "id", "hi", "lo"]
    sorted_points = points.repartitionByRange(*order).sortWithinPartitions(*order)
    tree = keep(sorted_points.mapInArrow(leaves, LEAF), "leaves")
    inside = tree.select(*BLOBS).mapInArrow(within(percent, every), "a long, b long, n long")
    # Leaves of one family, the smaller sets left: first by size, then by the bound.
    node = tree.select("family", "leaf", "least", "most", "top")
    right = node.select("family", *[F.col(c).alias(f"{c}_2") for c in ("leaf", "least", "most", "top")])
    shared = F.aggregate(F.zip_with("top", "top_2", lambda x, y: F.least(x, y).cast("long")), F.lit(0).cast("long"), lambda total, x: total + x)
    near = (F.col("leaf") < F.col("leaf_2")) & (100 * F.col("most") >= percent * F.col("least_2")) & (100 * F.col("most_2") >= percent * F.col("least"))
    reach = (100 + percent) * shared >= percent * (F.col("least") + F.col("least_2"))
    pairs = node.join(right, "family").filter(near).filter(reach).select("leaf", "leaf_2")
    blobs = tree.select("leaf", *BLOBS)
    full = pairs.join(blobs, "leaf").join(blobs.select(*[F.col(c).alias(f"{c}_2") for c in blobs.columns]), "leaf_2")
    across = full.drop("leaf", "leaf_2").mapInArrow(between(percent, every), "a long, b long, n long")
    return inside.unionByName(across)


def near_copies(books: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row for each row of `books` (id, text; others ignored): id, n_grams, component and n_links.

    n_grams is the size of the set of word n-grams of the whole text (A-Z in
    lower case; a shorter text is one gram). Books link when 100 times the shared
    grams reach `percent` times all grams of both; component is the least id
    reachable by links, itself included. NULL and empty texts have no grams and
    are linked with nothing. A row without id bridges nothing; it gets the
    component of rows with the same set, else NULL. Repeated rows and equal sets
    are one set until the end. n_links counts the different sets that a book's
    set links with, its own not among them; books of an equal set have the same
    number. No books give no rows; no link is left out.
    """
    plain = books.select(F.col("id").cast("long").alias("id"), "text")
    profile = keep(plain.mapInArrow(profiler(ngram), PROFILE), "profiles")
    sets = keep(profile.filter("n > 0 and id is not null").groupBy("hi", "lo", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "sets")
    found = keep(links(plain, sets, ngram, percent, every=False), "links")
    classes = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("lo")).agg(F.sum("n").alias("n_links"))
    joined = sets.join(classes.withColumnRenamed("node", "id"), "id", "left").join(counts, "lo", "left")
    linked_sets = joined.filter("copies > 1 or label is not null or n_links is not null")
    merged = keep(linked_sets.select("hi", "lo", F.coalesce("label", "id").alias("component"), "n_links"), "components")
    told = profile.join(merged, ["hi", "lo"], "left")
    return told.select(
        "id", F.col("n").alias("n_grams"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
