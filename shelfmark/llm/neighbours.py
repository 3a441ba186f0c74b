"""Nearest neighbours by inner product: a forest of random-projection trees, then exact reranking.

The library keeps no vectors, so this operator is general: it works on any table
of vec_id and embedding.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import keep

TREES = 6
LEAF_ROWS = 64
# Vectors that the trees are fitted on at most, the first by a digest of vec_id. Every vector is indexed.
SAMPLE_ROWS = 50_000
# A query's leaves are opened until they hold so many rows, and this share of all
# rows; rows of several trees count each time. Vectors without structure need a
# share; for clustered ones it may be 0.
SEARCH_ROWS, SEARCH_SHARE = 8_000, 0.7
# Leaves of a tree are dealt to so many groups at least, of about so many rows.
GROUPS, GROUP_ROWS = 8, 16_384
NEAREST = 20


@dataclass
class Forest:
    """Complete binary trees: the hyperplanes of each level, and how large the longest vector is."""

    normals: np.ndarray  # trees x inner nodes x (dimensions + 1)
    offsets: np.ndarray  # trees x inner nodes
    depth: int
    longest: float

    @property
    def dimensions(self) -> int:
        return self.normals.shape[2] - 1

    def lifted(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Vectors with one more coordinate, by which the largest inner product is the smallest angle."""
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0.0))
        return np.column_stack([vectors, rest]).astype(np.float32)

    def leaves(self, lifted: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.zeros((len(self.normals), len(lifted)), np.int64)
        for tree in range(len(self.normals)):
            node = np.zeros(len(lifted), np.int64)
            for _ in range(self.depth):
                margin = np.einsum("ij,ij->i", lifted, self.normals[tree][node]) - self.offsets[tree][node]
                node = 2 * node + 1 + (margin > 0)
            out[tree] = node - (2**self.depth - 1)
        return out

    def probes(self, lifted: np.ndarray, sizes: np.ndarray, rows: int) -> list[tuple[int, int]]:
        """(tree, leaf) that one query opens: all trees share a queue, the least squares of the margins crossed first."""
        inner = 2**self.depth - 1
        margins = self.normals @ lifted - self.offsets if self.depth else np.zeros((len(self.normals), 0))
        queue = [(0.0, tree, 0) for tree in range(len(self.normals))]
        found, seen = [], 0
        while queue and seen < rows:
            cost, tree, node = heapq.heappop(queue)
            while node < inner:
                margin = margins[tree, node]
                far = 2 * node + 1 + (margin <= 0)
                heapq.heappush(queue, (cost + float(margin) ** 2, tree, int(far)))
                node = 2 * node + 1 + int(margin > 0)
            leaf = node - inner
            if sizes[tree, leaf]:
                found.append((tree, leaf))
                seen += int(sizes[tree, leaf])
        return found


def grow(sample: np.ndarray, longest: float, rows: int, trees: int, leaf_rows: int, seed: int = 7) -> Forest:
    """Trees over a sample: each node is cut at the median along the difference of two of its vectors."""
    dimensions = sample.shape[1]
    depth = max(0, int(np.ceil(np.log2(max(rows, 1) / leaf_rows))))
    depth = min(depth, max(0, int(np.log2(max(len(sample), 1) / 4))))
    forest = Forest(np.zeros((trees, 2**depth - 1, dimensions + 1), np.float32), np.zeros((trees, 2**depth - 1), np.float32), depth, longest)
    lifted = forest.lifted(sample, query=False)
    random = np.random.default_rng(seed)
    for tree in range(trees):
        held = {0: np.arange(len(lifted))}
        for node in range(2**depth - 1):
            own = held.pop(node)
            normal = random.normal(size=dimensions + 1)
            if len(own) > 1:
                a, b = lifted[random.choice(own, 2, replace=False)]
                if np.any(a != b):
                    normal = a - b
            normal = (normal / np.linalg.norm(normal)).astype(np.float32)
            along = lifted[own] @ normal
            offset = np.float32(np.median(along)) if len(own) else np.float32(0)
            forest.normals[tree, node], forest.offsets[tree, node] = normal, offset
            held[2 * node + 1], held[2 * node + 2] = own[along <= offset], own[along > offset]
    return forest


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of rows that take part: with an id, finite components and one that is not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    some = F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    return plain.filter(F.col("vec_id").isNotNull() & F.coalesce(some, F.lit(False)))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dimensions)


@dataclass
class Layout:
    """Where the leaves of a forest are: rows of each leaf, groups of leaves, and parts of each group."""

    sizes: np.ndarray  # trees x leaves

    @property
    def groups(self) -> int:
        leaves = self.sizes.shape[1]
        wanted = max(GROUPS, self.sizes.sum(axis=1).max(initial=0) // GROUP_ROWS)
        return min(leaves, 1 << int(wanted - 1).bit_length())

    @property
    def parts(self) -> np.ndarray:
        """Copies crowd a leaf: a group of more rows than usual is cut, and queries go to each part."""
        rows = self.sizes.reshape(len(self.sizes), self.groups, -1).sum(axis=2)
        return np.maximum(1, -(-rows // (2 * GROUP_ROWS)))

    def group(self, leaf: np.ndarray) -> np.ndarray:
        return leaf // (self.sizes.shape[1] // self.groups)


def counter(forest: Forest) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of vectors to (tree, leaf, n), one row for each leaf and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(forest.normals), 2**forest.depth), np.int64)
        for batch in batches:
            if batch.num_rows:
                for tree, leaf in enumerate(forest.leaves(forest.lifted(_matrix(batch.column(0), forest.dimensions), query=False))):
                    counts[tree] += np.bincount(leaf, minlength=2**forest.depth)
        tree, leaf = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(leaf), pa.array(counts[tree, leaf])], names=["tree", "leaf", "n"])

    return run


SENT = "tree long, group long, part long, node long, leaves binary, vector binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()] * 2
    columns = zip(*rows, strict=True) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tree", "group", "part", "node", "leaves", "vector"])


def indexer(forest: Forest, layout: Layout, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (node, vector) to a row for each tree, with its leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, parts = layout.groups, layout.parts
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, nodes = _matrix(batch.column(1), forest.dimensions), batch.column(0).to_numpy()
            raw = [v.tobytes() for v in vectors.astype(kind)]
            for tree, leaf in enumerate(forest.leaves(forest.lifted(vectors, query=False))):
                group = leaf // (layout.sizes.shape[1] // groups)
                part = nodes % parts[tree][group]
                own = [x.tobytes() for x in leaf.reshape(-1, 1)]
                yield _sent(list(zip([tree] * len(nodes), group.tolist(), part.tolist(), nodes.tolist(), own, raw, strict=True)))

    return run


def prober(forest: Forest, layout: Layout, rows: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (node, vector) of queries to a row for each group they visit, with the leaves they open there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = layout.parts
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(1), forest.dimensions)
            for node, vector, lifted in zip(batch.column(0).to_pylist(), vectors, forest.lifted(vectors, query=True), strict=True):
                found = np.array(forest.probes(lifted, layout.sizes, rows), np.int64).reshape(-1, 2)
                group = layout.group(found[:, 1])
                visited = np.unique(np.stack([found[:, 0], group], axis=1), axis=0)
                out, raw = [], vector.astype(kind).tobytes()
                for tree, g in visited.tolist():
                    leaves = found[(found[:, 0] == tree) & (group == g), 1].tobytes()
                    out += [(tree, g, part, node, leaves, raw) for part in range(parts[tree][g])]
                yield _sent(out)

    return run


def scorer(count: int, kind: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The nearest nodes of each query of a part, by inner product in double precision."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(rows):
            leaf = np.frombuffer(b"".join(rows["leaves"]), np.int64)
            order = np.argsort(leaf, kind="stable")
            leaf, nodes = leaf[order], rows["node"].to_numpy()[order]
            last = int(leaf[-1])
            matrix = np.frombuffer(b"".join(rows["vector"]), kind).reshape(len(rows), -1)[order].astype(np.float64)
            for query, opened, raw in zip(queries["node"].tolist(), queries["leaves"], queries["vector"], strict=True):
                is_open = np.zeros(last + 1, bool)
                opened = np.frombuffer(opened, np.int64)
                is_open[opened[opened <= last]] = True
                own = np.flatnonzero(is_open[leaf])
                # Row by row, so that equal vectors score equal to the last bit.
                scores = (matrix[own] * np.frombuffer(raw, kind).astype(np.float64)).sum(axis=1)
                top = np.lexsort((nodes[own], -scores))[:count]
                out.append((np.full(len(top), query), nodes[own][top], scores[top]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame({"query": columns[0], "node": columns[1], "score": columns[2]})

    return run


def nearest(
    vectors: DataFrame, is_query: Column, count: int = NEAREST, trees: int = TREES, leaf_rows: int = LEAF_ROWS, search_rows: int = SEARCH_ROWS,
    search_share: float = SEARCH_SHARE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the `count` nearest rows found for each query row.

    `vectors` has vec_id and embedding; `is_query`, a condition on vec_id, picks
    the queries; candidates are all rows but those with the query's own id.
    Nearness is the inner product in double precision, ties go to the smaller
    vec_id. Rows without id, and vectors that are NULL, empty, zero or hold NULL
    or non-finite components, take no part; nor do vectors of another length
    than most. Repeated rows of an id and vector are one; fewer candidates than
    `count` are all returned; no rows give no rows.

    Equal vectors are one node with its `count` + 1 least ids, so copies neither
    crowd a leaf nor a result. The trees are fitted on a bounded sample; every
    node is indexed in every tree.
    """
    usable_rows = usable(vectors)
    length = usable_rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return vectors.sparkSession.createDataFrame([], empty)
    rows = keep(
        usable_rows.filter(F.size("vector") == length["n"]).withColumns({"_a": F.xxhash64("vector"), "_b": F.hash("vector")}).distinct(), "vectors"
    )
    least = Window.partitionBy("_a", "_b", "vector").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= count + 1)
    nodes = keep(few.groupBy("_a", "_b", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("node", F.col("ids")[0]), "nodes")
    asked = keep(
        rows.filter(is_query).join(nodes.select("_a", "_b", F.col("vector").alias("_v"), "node"), ["_a", "_b"]).filter("vector = _v").select("vec_id", "node", "vector"), "asked"
    )
    number, longest = nodes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)))).first()
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS).select("vector").toArrow().column("vector").combine_chunks()
    forest = grow(_matrix(sample, length["n"]), float(longest), number, trees, leaf_rows)

    plain = nodes.select("node", "vector")
    sizes = np.zeros((trees, 2**forest.depth), np.int64)
    # One number for each leaf; the sample bounds the leaves.
    for row in plain.select("vector").mapInArrow(counter(forest), "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        sizes[row["tree"], row["leaf"]] = row["n"]
    layout = Layout(sizes)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    opened_rows = max(search_rows, round(search_share * number))
    asking = asked.select("node", "vector").distinct().mapInArrow(prober(forest, layout, opened_rows, kind), SENT)
    keys = ["tree", "group", "part"]
    indexed = plain.mapInArrow(indexer(forest, layout, kind), SENT)
    found = asking.groupBy(*keys).cogroup(indexed.groupBy(*keys)).applyInPandas(scorer(count + 1, kind), "query long, node long, score double")
    per_node = found.groupBy("query", "node").agg(F.max("score").alias("score"))
    order = lambda *by: Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    top_nodes = per_node.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "node"))).filter(F.col("_n") <= count + 1)
    opened = top_nodes.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    top_ids = opened.withColumn("_n", F.row_number().over(order("query"))).filter(F.col("_n") <= count + 1).select("query", "score", "vec_id")
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(top_ids, "query").filter("vec_id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(order("query_id")).cast("int")).filter(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "vec_id", "score")
