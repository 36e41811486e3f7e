"""Hashes of words and of word windows, computed for many texts at once with numpy.

Words are maximal runs of bytes outside {0x20, 0x09-0x0D} of the UTF-8 text,
which are the matches of [^\\x20\\x09-\\x0D]+. A text is never cut: a batch is
sliced between rows, so a slice holds at least one whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 16


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOW = _powers(0x5851F42D4C957F2D, _STEP)


class Words(NamedTuple):
    """starts, ends: byte offsets into buf; doc: row of each word; first: index of each row's first word, and the word count at the end; hash: 64 bits a word."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the offsets of its rows."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that do not overlap and ascend."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    pos = np.arange(lens.sum(), dtype=np.int64)
    begin = np.cumsum(lens) - lens
    pos -= np.repeat(begin, lens)
    inside = buf if len(pos) == len(buf) else buf[np.repeat(starts, lens) + pos]
    vals = inside.astype(np.uint64)
    vals += np.uint64(1)
    if lens.max() <= _STEP:
        vals *= _LOW[pos]
    else:
        vals *= _LOW[pos & (_STEP - 1)]
        vals *= mix(_ODD * (pos >> 16).astype(np.uint64)) | np.uint64(1)
    return mix(np.add.reduceat(vals, begin) + _ODD * lens.astype(np.uint64))


def words_of(column: pa.Array) -> Words:
    buf, offsets = utf8(column)
    n = len(buf)
    word = np.empty(n + 1, dtype=bool)
    word[:n] = ~SPACES[buf]
    word[n] = False
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = word[:n]
    starts = np.flatnonzero(word & (~before | edge))
    ends = np.flatnonzero(before & (~word | edge))
    first = np.searchsorted(starts, offsets)
    return Words(buf, starts, ends, first, spans_hash(buf, starts, ends))


def windows(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of the k words from each word on; the last k - 1 of the whole array are left out. Windows over a row's end are the caller's to mask."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = np.uint64((0xBF58476D1CE4E5B9 + 2 * seed * 0x94D049BB133111EB) % 2**64 | 1)
    out = h[:n].copy()
    for j in range(1, k):
        out *= factor
        out += h[j : n + j]
    return mix(out)


def whole(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n windows lie within one row."""
    ok = np.zeros(max(n, 0), dtype=bool)
    if n > 0:
        step = np.zeros(n + 1, dtype=np.int32)
        has = first[1:] - first[:-1] >= k
        np.add.at(step, first[:-1][has], 1)
        np.add.at(step, (first[1:] - k + 1)[has], -1)
        ok = np.cumsum(step[:n]) > 0
    return ok


def slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes of text, one whole row at least."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def sequence_hash(values: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """For each row, a hash of its values in their order; first as in Words. Rows without values get that of nothing."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    has = n > 0
    if has.any():
        pos = np.arange(first[-1] - first[0], dtype=np.int64) - np.repeat(first[:-1] - first[0], n)
        vals = mix(values[first[0] : first[-1]] ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
        vals *= mix(_ODD * (pos.astype(np.uint64) + np.uint64(1))) | np.uint64(1)
        out[has] = np.add.reduceat(vals, (first[:-1] - first[0])[has])
    return mix(out + _ODD * n.astype(np.uint64))


def rolling(f: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """f over each w consecutive values of x."""
    got, out = 1, x
    while got < w:
        step = min(got, w - got)
        out = f(out[: len(out) - step], out[step:])
        got += step
    return out


def member(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def lookup(x: np.ndarray, keys: np.ndarray, values: np.ndarray, otherwise: int) -> np.ndarray:
    """The values of x by sorted keys."""
    out = np.full(len(x), otherwise, dtype=values.dtype)
    if len(keys):
        at = np.searchsorted(keys, x)
        at[at == len(keys)] = 0
        hit = keys[at] == x
        out[hit] = values[at[hit]]
    return out


def slot_of(h: np.ndarray, n: int) -> np.ndarray:
    """One of n slots, by the upper half of each hash; ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal neighbours."""
    if len(x):
        cut = np.flatnonzero(x[1:] != x[:-1]) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), len(x)], strict=True)
