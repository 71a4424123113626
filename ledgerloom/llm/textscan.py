"""Words and rolling hashes of many texts at once, on Arrow's byte buffers with numpy.

Words are the maximal runs outside ``[\\x20\\x09-\\x0D]``. All of these bytes are
ASCII, so UTF-8 texts need no decoding. Hashes are 64-bit polynomial sums that wrap
around, finished by a mixing step; equal words (or windows of words) get equal
hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm.common import CHUNK_BYTES

_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1342543DE82EF95 | 1
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes between terms: ASCII but letters and digits.
NO_TERM = np.arange(256) < 128
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

_seeds = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A value for each byte; the second table folds A-Z to a-z.
EXACT = _seeds.copy()
FOLDED = _seeds.copy()
FOLDED[65:91] = _seeds[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all of its bits depend on all of the input's."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            steps = np.full(n, self.base, np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = self.inverse
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


_byte_powers, _word_powers = _Powers(_BASE), _Powers(_WORD_BASE)


@dataclass
class Words:
    """The words of a chunk of texts; ``first[d]`` to ``first[d + 1]`` are text d's."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and its offsets into them; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text is its own slice."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def words(texts: pa.Array, table: np.ndarray | None = EXACT, gap: np.ndarray = SPACE) -> Words:
    """Find and hash all words; ``table`` gives a value for each byte (None: no hashes), ``gap`` marks bytes between words."""
    data, at = text_bytes(texts)
    n = len(data)
    solid = np.zeros(n + 2, bool)
    np.logical_not(gap[data], out=solid[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    inner = solid[1:]
    begins = inner[:n] & (~solid[:n] | edge[:n])
    ends = inner[:n] & (~solid[2 : n + 2] | edge[1 : n + 1])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    hashed = None
    if table is not None:
        up, down = _byte_powers.get(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * up[:n], out=total[1:])
        hashed = mix((total[end] - total[start]) * down[start])
    return Words(data, start, end, first, hashed)


def window_hashes(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` items; a run may cross from one text into the next."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _word_powers.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    keyed = mix(hashes + np.uint64((salt * 0x9E3779B97F4A7C15 + size) & _MASK)) if salt else hashes
    np.cumsum(keyed * up[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: n - size + 1] + np.uint64(size))


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Indexes of words at which a window of ``size`` words within one text starts."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    skip = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(counts.sum()) + skip


def crc_held_out(ids: list, modulus: int, remainder: int) -> np.ndarray:
    import zlib

    return np.array([i is not None and zlib.crc32(str(i).encode()) % modulus == remainder for i in ids], bool)
