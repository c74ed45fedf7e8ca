"""Vectorised text kernels over Arrow string buffers: words, hashes and shingles of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone, whole.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: The white space of the word pattern [^\x20\x09-\x0D]+.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII letters and digits, and every byte of a longer UTF-8 sequence.
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; those of a slice are remembered."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) with about SLICE_BYTES each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def find_words(raw: np.ndarray, offsets: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: runs without white space, or runs of letters and digits."""
    inside = _ALNUM[raw] if alnum else ~_SPACE[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1]
    before[edges[edges < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def _sums(raw: np.ndarray, lower: bool) -> np.ndarray:
    """Prefix sums of the bytes, from 1 on, times the powers of the base."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(((_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)) * power(_BASE, len(raw)), out=total[1:])
    return total


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each word's bytes, lower-cased A-Z on demand; about SLICE_BYTES of text are in hand at once, whatever their length."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, first + SLICE_BYTES, "right")))
        if ends[j - 1] - first <= SLICE_BYTES:
            total = _sums(raw[first : int(ends[j - 1])], lower)
            out[i:j] = (total[ends[i:j] - first] - total[starts[i:j] - first]) * power(_INVERSE, SLICE_BYTES)[starts[i:j] - first]
        else:  # one word that is longer
            value, factor = 0, 1
            for k in range(first, int(ends[i]), SLICE_BYTES):
                part = raw[k : min(k + SLICE_BYTES, int(ends[i]))]
                value = (value + factor * int(_sums(part, lower)[-1])) % (1 << 64)
                factor = factor * pow(_BASE, len(part), 1 << 64) % (1 << 64)
            out[i] = value
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each row's run in the ascending `rows`."""
    return np.searchsorted(rows, np.arange(n + 1))


def fold(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of each run of `width` consecutive hashes; one value for each start."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for k in range(width):
        factor = (factor * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) % (1 << 64) | 1
        out += hashes[k : k + n] * np.uint64(factor)
    return mix(out)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; one for the whole of a shorter one, none without words."""
    starts, ends, rows = find_words(raw, offsets)
    words = hash_words(raw, starts, ends, lower=True)
    n = len(offsets) - 1
    bounds = row_bounds(rows, n)
    every = fold(words, width)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        elif b > a:
            out.append(mix(fold(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
