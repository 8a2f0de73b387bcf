"""Words of many texts at once, over the UTF-8 bytes of an Arrow column.

Everything works on slices of a few hundred kilobytes of text, so the working
arrays stay in cache and a task's memory follows the slice or the longest
single text, never the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240607)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: digits, lower-case letters and every byte of a non-ASCII character
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: what is not ASCII white space
SOLID = np.ones(256, dtype=bool)
SOLID[9:14] = SOLID[32] = False

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values; equal values stay equal."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """Some texts as one byte array; text i owns ``data[offs[i]:offs[i + 1]]``."""

    data: np.ndarray
    offs: np.ndarray
    first: int

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    def text(self, i: int) -> str:
        return bytes(self.data[self.offs[i]:self.offs[i + 1]]).decode("utf-8", "replace")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column in slices of at most ``limit`` bytes, or of one longer text; null counts as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(col)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield Texts(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], lo)
        lo = hi


@dataclass
class Words:
    """Words of a slice: byte spans, 64-bit hashes, and per text the range of its words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray

    def prefix_hash(self, length: int) -> np.ndarray:
        """Hash of the first ``length`` bytes of each word (of all, if it has fewer)."""
        end = np.minimum(self.end, self.start + length)
        return mix((self.sums[end] - self.sums[self.start]) * _power("down", BASE_INVERSE, len(self.sums))[self.start])


def words(t: Texts, lower: bool = True, table: np.ndarray = ALNUM) -> Words:
    """Maximal runs of bytes that ``table`` accepts, never across two texts."""
    low = LOWER[t.data] if lower else t.data
    inside = table[low]
    n = len(low)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    cuts = t.offs[(t.offs > 0) & (t.offs < n)]
    before[cuts] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[low] * _power("up", BASE, n), out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * _power("down", BASE_INVERSE, n + 1)[start])
    return Words(start, end, hashed, np.searchsorted(start, t.offs), sums)


def char_starts(data: np.ndarray) -> np.ndarray:
    """For each byte position (and the end) the number of characters that begin before it."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def free_name(taken: list[str], wish: str) -> str:
    """A column name that no given column has, whatever its case."""
    have = {c.lower() for c in taken}
    name = wish
    while name.lower() in have:
        name += "_"
    return name


def give_back() -> None:
    """Hands memory that Arrow and the C library keep for reuse back to the system; Python workers outlive their task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
