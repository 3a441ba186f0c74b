"""Packing of tokenised books into training sequences, best fit decreasing.

What a packing does with a piece depends on its length alone, and lengths are at
most that of a sequence. So the pieces are counted by length, the counts are
packed (whole runs of equal pieces into whole runs of equally full sequences),
and each piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import keep, running_start, text_of
from shelfmark.llm.tokens import chunks, words

CAPACITY = 2048
END_OF_BOOK = 0
PIECES = "row long, id long, piece int, start long, length long, ids_crc32 long"
# Bytes of words and ids that a worker remembers; beyond them it starts anew.
REMEMBERED_BYTES = 24_000_000
TOGETHER = 200


class Encoder:
    """Token ids of texts by a public tokenizer's file, remembering the words it has met.

    The tokenizer cuts at white space and wherever an ASCII letter meets an
    ASCII sign or digit, and its ids of the parts do not depend on each other. So
    each distinct part is encoded once, many parts at a time; the last id of each
    word carries the word-end mark, which gives the ids back to their parts.
    Texts that hold the beginning of a special token are encoded as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        size = self._tokenizer.get_vocab_size()
        ends = (self._tokenizer.id_to_token(i) or "" for i in range(size))
        self._ends = np.fromiter((token.endswith("</w>") for token in ends), dtype=bool, count=size)
        # Fixed value: how the tokenizer's file cuts a text into words.
        self._cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self._forget()

    def _forget(self) -> None:
        self._keys = np.zeros(0, np.uint64)
        self._at = np.zeros(0, np.int64)
        self._size = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _encode(self, parts: list[str]) -> list[np.ndarray]:
        import unicodedata

        groups = [parts[i : i + TOGETHER] for i in range(0, len(parts), TOGETHER)]
        out: list[np.ndarray] = []
        for group, encoded in zip(groups, self._tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, dtype=np.uint32)
            counts = np.array([len(self._cut.findall(unicodedata.normalize("NFC", part).lower())) for part in group])
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == counts.sum() and (not len(ids) or ends[-1] == len(ids)):
                bounds = np.append(0, ends)[np.append(0, counts.cumsum())]
                out += np.split(ids, bounds[1:-1])
            else:
                out += [self.whole(part) for part in group]
        return out

    def _learn(self, keys: np.ndarray, parts: list[str]) -> None:
        """Adds sorted new keys, in their places among those that are there."""
        ids = self._encode(parts)
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        starts = len(self._ids) + np.append(0, sizes.cumsum())[:-1]
        place = np.searchsorted(self._keys, keys)
        self._keys = np.insert(self._keys, place, keys)
        self._at, self._size = np.insert(self._at, place, starts), np.insert(self._size, place, sizes)
        self._ids = np.concatenate([self._ids, *ids])

    def remembered(self) -> int:
        return sum(x.nbytes for x in (self._keys, self._at, self._size, self._ids))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for _, part in chunks(texts):
            yield from self._encode_chunk(part)

    def _encode_chunk(self, texts: pa.Array) -> Iterator[np.ndarray]:
        found = words(texts, split_signs=True)
        unique, where, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
        if self.remembered() > REMEMBERED_BYTES:
            self._forget()
        place = np.searchsorted(self._keys, unique)
        missing = np.flatnonzero((place >= len(self._keys)) | (self._keys[np.minimum(place, max(len(self._keys) - 1, 0))] != unique if len(self._keys) else True))
        if len(missing):
            raw = found.data.tobytes()
            spots = where[missing]
            parts = [raw[s : s + n].decode("utf-8", "replace") for s, n in zip(found.start[spots].tolist(), found.length[spots].tolist(), strict=True)]
            self._learn(unique[missing], parts)
            place = np.searchsorted(self._keys, unique)
        at, size = self._at[place][inverse], self._size[place][inverse]
        upto = np.append(0, size.cumsum())
        flat = self._ids[np.arange(upto[-1]) + np.repeat(at - upto[:-1], size)]
        plain = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        special = pc.match_substring(plain, "<|")
        odd = set(np.flatnonzero(special.fill_null(False).to_numpy(zero_copy_only=False)).tolist())
        bounds = upto[found.first]
        for i in range(len(texts)):
            yield self.whole(texts[i].as_py()) if i in odd else flat[bounds[i] : bounds[i + 1]]


def _encoder(path: str) -> Encoder:
    """One for each Python worker, so that later tasks find the words of earlier ones; it holds REMEMBERED_BYTES at most.

    Code comes anew with each task, so the encoder is held by a module that stays.
    """
    import tokenizers

    held = vars(tokenizers).setdefault("_shelfmark_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def cutter(path: str, capacity: int = CAPACITY) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (row, id, text) to batches of pieces."""
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for (row, key), ids in zip(keys, encoder.encode(batch.column(2)), strict=True):
                ids = np.append(ids, np.uint32(END_OF_BOOK)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((row, key, piece, start, len(own), zlib.crc32(own.tobytes())))
            columns = zip(*rows, strict=True) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, schema.types, strict=True)], schema=schema)

    return run


@dataclass
class Run:
    """`pieces` pieces of one length from rank `rank`: `each` to a sequence, from sequence `first` and offset `offset` on."""

    length: int
    rank: int
    pieces: int
    each: int
    first: int
    offset: int


class OpenBins:
    """Open sequences by the room they have left, in runs of neighbours, with a segment tree over the rooms."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._open = [0] * (2 * self._leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _count(self, room: int, change: int) -> None:
        node = room + self._leaves
        while node:
            self._open[node] += change
            node //= 2

    def add(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs[room].append((first, count))
            self._count(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        self._count(room, -1)
        return self.runs[room].pop()

    def tightest(self, length: int) -> int | None:
        """The least room of at least `length`, in logarithmic time."""
        node = length + self._leaves
        if self._open[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self._open[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self._leaves:
            node = 2 * node if self._open[2 * node] else 2 * node + 1
        return node - self._leaves


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best fit decreasing over piece counts by length.

    The longest pieces come first and each goes to the sequence with the least
    room that holds it, else to a new one. After a piece its sequence is the
    tightest one still, so it takes as many of that length as it holds.
    """
    bins, runs, sequences = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                each = capacity // length
                room, first, count = capacity, sequences, -(-left // each)
                sequences += count
            else:
                each = room // length
                first, count = bins.take(room)
            full = min(count, left // each)
            if full:
                runs.append(Run(length, rank, full * each, each, first, capacity - room))
                bins.add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = count - full
            if rest and left:  # fewer pieces than one sequence takes
                runs.append(Run(length, rank, left, left, first + full, capacity - room))
                bins.add(room - left * length, first + full, 1)
                rank, left, full, rest = rank + left, 0, full + 1, rest - 1
            if rest and room < capacity:
                bins.add(room, first + full, rest)
    return runs


def placer(runs: list[Run]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds sequence_id and offset to batches that end with length and rank."""
    by_length: dict[int, np.ndarray] = {}
    for run in runs:
        by_length.setdefault(run.length, []).append((run.rank, run.each, run.first, run.offset))
    tables = {length: np.array(rows, dtype=np.int64) for length, rows in by_length.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for group in np.split(order, cuts):
                if not len(group):
                    continue
                size = int(length[group[0]])
                table = tables[size]
                run = table[np.searchsorted(table[:, 0], rank[group], side="right") - 1]
                within = rank[group] - run[:, 0]
                sequence[group] = run[:, 2] + within // run[:, 1]
                offset[group] = run[:, 3] + within % run[:, 1] * size
            kept = [batch.column(name) for name in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return place


def pack(books: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of `books` (id, text; others ignored) and their places in sequences of at most `capacity` tokens.

    Columns: id, piece (from 0), start (the book's tokens before it), length,
    ids_crc32 (of its ids as little-endian 32-bit numbers), sequence_id and
    offset. `tokenizer` is the path of a tokenizer file, the same on every
    machine. A book's ids end with 0, so NULL and empty texts make one piece of
    one token; only longer books are cut, into pieces of `capacity` and a last
    one. Repeated rows are books of their own, and so are NULL ids; equal
    lengths are ranked by a digest of row and piece. No books give no rows.

    The driver holds one count for each length (at most `capacity`) and the runs
    of the packing, which depend on the lengths and not on the number of books.
    """
    rows = books.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), text_of().alias("text"))
    pieces = keep(rows.mapInArrow(cutter(tokenizer, capacity), PIECES), "pieces")
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    runs = pack_counts(counts, capacity)
    ordered = pieces.withColumn("_order", F.md5(F.concat_ws(" ", F.col("row").cast("string"), F.col("piece").cast("string")))).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_start(ordered, "length", "_order", "_one", "rank")
    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placer(runs), schema)
