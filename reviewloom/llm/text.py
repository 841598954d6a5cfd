"""Array views of a text column: whole UTF-8 texts, words and five-word shingles of many rows at once.

A batch is cut into slabs of about ``SLAB`` bytes (characters) (one long text may be a slab of its own), so memory per task does
not grow with the number of rows. Words are runs of bytes other than space and 0x09-0x0D.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLAB = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        steps = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 16 * SLAB:  # what one very long text needs is not kept
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@dataclass
class Slab:
    first: int  # row of the batch
    offsets: np.ndarray  # n + 1 byte offsets into data
    data: np.ndarray  # uint8

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def slabs(column: pa.Array, limit: int = SLAB) -> Iterator[Slab]:
    """The column's texts as bytes, null as empty, a few rows at a time and every row whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield Slab(start, offsets[start : stop + 1] - offsets[start], raw[offsets[start] : offsets[stop]])
        start = stop


def prefix_hash(data: np.ndarray, folded: bool = False) -> np.ndarray:
    """h[i]: hash of the first i bytes; ``substring_hash`` takes differences of it."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    values = (_FOLDED if folded else _BYTE)[data]
    values *= powers(len(data))
    np.cumsum(values, out=out[1:])
    return out


def substring_hash(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit identity of data[start:stop], wherever it stands."""
    down = powers(int(start.max()) + 1 if len(start) else 1, _INV)
    return mix((h[stop] - h[start]) * down[start] + (stop - start).astype(np.uint64) * _U(0x2545F4914F6CDD1D))


@dataclass
class Words:
    starts: np.ndarray  # byte where each word begins
    ends: np.ndarray
    docs: np.ndarray  # n + 1 offsets of each row's words


def words(slab: Slab) -> Words:
    inside = ~_SPACE[slab.data]
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = slab.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return Words(starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, slab.offsets))


def word_hashes(slab: Slab, w: Words, folded: bool = True) -> np.ndarray:
    return substring_hash(prefix_hash(slab.data, folded), w.starts, w.ends)


def runs_hash(hashes: np.ndarray, length: int) -> np.ndarray:
    """Identity of each run of ``length`` word hashes (one row per start that has room)."""
    n = max(0, len(hashes) - length + 1)
    out = np.full(n, length, dtype=np.uint64)
    for k in range(length):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(out)


def shingles(hashes: np.ndarray, docs: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """Per row, the shingle of each word position; a row of fewer words has its whole sequence as one, an empty row none."""
    every = runs_hash(hashes, size)
    for a, b in zip(docs[:-1].tolist(), docs[1:].tolist()):
        if b - a >= size:
            yield every[a : b - size + 1]
        else:
            yield runs_hash(hashes[a:b], b - a) if b > a else every[:0]


@dataclass
class Chars:
    first: int
    codes: np.ndarray  # code points, lower case; 0 wherever no letter or mark stands, and around each row
    starts: np.ndarray  # of letter runs
    ends: np.ndarray
    docs: np.ndarray  # n + 1 offsets of each row's letter runs
    at: np.ndarray  # where each row begins in codes

    @property
    def n(self) -> int:
        return len(self.docs) - 1


_plane: dict[str, np.ndarray] = {}


def letters() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 65536: lower case, and 3 for a number, 2 for a letter, 1 for a mark, else 0."""
    if not _plane:
        kind = [unicodedata.category(chr(i))[0] for i in range(1 << 16)]
        _plane["lower"] = np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(1 << 16)], dtype=np.uint32)
        _plane["kind"] = np.array([{"M": 1, "L": 2, "N": 3}.get(k, 0) for k in kind], dtype=np.uint8)
    return _plane["lower"], _plane["kind"]


def letter_runs(column: pa.Array, limit: int = SLAB, numbers: bool = False) -> Iterator[Chars]:
    """Rows as code points with their runs of letters (each with one letter at least), a few rows at a time.

    With ``numbers``, runs of letters and numbers.
    """
    lower, kind = letters()
    if not numbers:
        kind = np.where(kind == 3, 0, kind).astype(np.uint8)
    start, part = 0, []
    for i in range(len(column) + 1):
        text = (column[i].as_py() or "") if i < len(column) else ""
        if part and (i == len(column) or size + len(text) > limit):
            yield _letter_runs(part, start, lower, kind)
            start, part = i, []
        if not part:
            size = 0
        part.append(text)
        size += len(text) + 1


def _letter_runs(part: list[str], start: int, lower: np.ndarray, kind: np.ndarray) -> Chars:
    codes = np.frombuffer(("\n" + "\n".join(part) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.cumsum([1] + [len(t) + 1 for t in part])
    low = np.minimum(codes, 65535)
    kinds = kind[low]
    high = np.flatnonzero(codes > 65535)
    if len(high):
        kinds[high] = [2 if chr(c).isalpha() else 0 for c in codes[high].tolist()]
    codes = np.where(kinds > 0, np.where(codes > 65535, codes, lower[low]), 0).astype(np.uint64)
    inside = kinds > 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    if len(starts):
        lettered = np.add.reduceat((kinds >= 2).astype(np.int64), starts)  # marks between runs do not occur
        starts, ends = starts[lettered > 0], ends[lettered > 0]
    return Chars(start, codes, starts, ends, np.searchsorted(starts, at), at)


def grams(codes: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n code points from each place on, and whether they lie in one letter run with its two edges."""
    size = len(codes)
    out = np.full(size, n, dtype=np.uint64)
    inner = np.ones(size, bool)
    inner[max(0, size - n + 1) :] = False
    for k in range(min(n, size)):
        out[: size - k] = out[: size - k] * _U(0x9FB21C651E98DF25) + codes[k:]
        if 0 < k < n - 1:
            inner[: size - k] &= codes[k:] > 0
    out *= _U(0xD6E8FEB86659FD93)
    return (out >> _U(64 - bits)).astype(np.int64), inner
