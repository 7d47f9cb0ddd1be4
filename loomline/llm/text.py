"""Words of whole texts as flat numpy arrays: splitting, hashing, rolling hashes and minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PRIME = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece hold about ``most`` bytes; one row is never cut."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < b.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + most, "right")))
            yield b.slice(start, end - start)
            start = end


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than texts) and the flat words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
    if empty.any():
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
        counts = np.where(empty, 0, counts)
    return np.concatenate(([0], counts.cumsum())), flat


def word_lanes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Offsets as of split_words, and two independent 64-bit hashes of each word as a (2, n) array.

    A hash is a polynomial in the word's bytes over random 64-bit values, computed on the flat bytes of all
    texts; ``lower`` reads A-Z as a-z.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    space = _SPACE[data]
    before = np.ones(len(data) + 1, bool)
    before[1:] = space
    before[bounds] = True
    after = np.ones(len(data) + 1, bool)
    after[:-1] = space
    after[bounds] = True
    inside = ~space
    starts = np.flatnonzero(inside & before[:-1])
    offsets = np.searchsorted(starts, bounds)
    if not len(starts):
        return offsets, np.zeros((2, 0), np.uint64)
    lens = np.flatnonzero(inside & after[1:]) + 1 - starts
    first = np.concatenate(([0], lens[:-1].cumsum()))
    power = _powers(int(lens.max()))[:, np.arange(lens.sum()) - np.repeat(first, lens)]
    letters = data[inside]
    values = (_LOWER_VALUES if lower else _VALUES)[:, letters]
    return offsets, mix(np.add.reduceat(values * power, first, axis=1))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 64, (2, 256), np.uint64, endpoint=False)
_LOWER_VALUES = _VALUES.copy()
_LOWER_VALUES[:, 65:91] = _VALUES[:, 97:123]
_BASES = np.array([[0x9E3779B97F4A7C15], [0xD1342543DE82EF95]], np.uint64)
_SHORT: list[np.ndarray] = []


def _powers(n: int) -> np.ndarray:
    if n <= 256 and _SHORT:
        return _SHORT[0]
    table = np.cumprod(np.broadcast_to(_BASES, (2, max(n, 256))), axis=1, dtype=np.uint64)
    if n <= 256:
        _SHORT.append(table)
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(lane: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k consecutive values (n - k + 1 of them), by doubling."""
    if len(lane) < k:
        return np.zeros(0, np.uint64)
    out, length, power = lane, 1, {1: lane}
    while 2 * length <= k:
        out = _concat(out, out[length:], length)
        length *= 2
        power[length] = out
    rest = k - length
    while rest:
        step = 1 << (rest.bit_length() - 1)
        out = _concat(out, power[step][length:], step)
        length, rest = length + step, rest - step
    return mix(out)


def _concat(left: np.ndarray, right: np.ndarray, right_len: int) -> np.ndarray:
    n = min(len(left), len(right))
    return left[:n] * np.uint64(pow(int(_PRIME), right_len, 1 << 64)) + right[:n]


def rolling_min(values: np.ndarray, k: int) -> np.ndarray:
    out, length = values, 1
    while 2 * length <= k:
        out, length = np.minimum(out[: len(out) - length], out[length:]), 2 * length
    if k > length:
        out = np.minimum(out[: len(out) - (k - length)], out[k - length :])
    return out


def starts_within(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions at which k words of one text start, and the text of each."""
    n = np.diff(offsets)
    fit = np.maximum(n - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), fit)
    first = np.repeat(offsets[:-1], fit)
    within = np.arange(fit.sum()) - np.repeat(np.concatenate(([0], fit.cumsum()[:-1])), fit) if len(n) else doc
    return first + within, doc


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))
