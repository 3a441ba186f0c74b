"""Words of whole Arrow columns of text, found and hashed with numpy.

White space is ASCII, so bytes and characters split alike in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256, dtype=np.uint8)
WHITE = np.isin(_BYTES, np.array([0x20, *range(0x09, 0x0E)], dtype=np.uint8))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
# ASCII signs and digits that never belong to a run of letters.
SIGN = (_BYTES > 0x20) & (_BYTES < 0x7F) & ~LETTER & (_BYTES != ord("'"))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits look independent."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of some texts: `data` in lower case, each word's place, length and 64-bit hash; `first[i]` is text i's first word."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def of(self, text: int) -> slice:
        return slice(int(self.first[text]), int(self.first[text + 1]))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and boundaries (one more than texts) of an Arrow array; NULL is empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(texts: pa.Array, split_signs: bool = False, lower: bool = True) -> Words:
    """Words of each text; with `split_signs` also cut where an ASCII letter meets an ASCII sign or digit.

    `lower` folds A-Z. A word's hash adds up its blocks of 8 bytes, each mixed
    with its place first, so that no rule of arithmetic makes two words meet.
    """
    raw, bounds = buffers(texts)
    data = LOWER[raw] if lower else raw
    solid = ~WHITE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = bounds[:-1]
    edges = edges[edges < len(raw)]
    begins[edges] = solid[edges]
    if split_signs and len(raw):
        letter, sign = LETTER[raw], SIGN[raw]
        begins[1:] |= (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    start = np.flatnonzero(begins)
    if not len(start):
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64))
    kept = np.flatnonzero(solid)
    at = np.searchsorted(kept, start)
    length = np.diff(np.append(at, len(kept)))
    inside = np.arange(len(kept)) - np.repeat(at, length)
    block = np.flatnonzero(inside % 8 == 0)
    bytes8 = np.add.reduceat(data[kept].astype(np.uint64) << (8 * (inside % 8)).astype(np.uint64), block)
    placed = mixed(bytes8 ^ mixed((inside[block] // 8 + 1).astype(np.uint64) * _BASE))
    total = np.add.reduceat(placed, np.searchsorted(block, at))
    return Words(data, start, length, mixed(total + length.astype(np.uint64)), np.searchsorted(start, bounds))


def chunks(texts: pa.Array, most_bytes: int = 1_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(offset, slice) pieces of a column, each of about `most_bytes` or one longer text."""
    raw_bounds = buffers(texts)[1]
    at = 0
    while at < len(texts):
        upto = int(np.searchsorted(raw_bounds, raw_bounds[at] + most_bytes, side="right")) - 1
        upto = max(upto, at + 1)
        yield at, texts.slice(at, upto - at)
        at = upto
